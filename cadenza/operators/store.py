"""Versioned caches and upserts over plain tables: a new state is a new DataFrame."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_path(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; without one, a temporary folder on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back: what is used many times is made once, and survives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def now() -> Column:
    """Seconds since 1970."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def upsert_latest(rows: DataFrame, key: str, at: list[str]) -> DataFrame:
    """The last write of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in at])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def fresh(rows: DataFrame, at: str, now: float, hours: float) -> DataFrame:
    """Rows not older than ``hours``; equality is fresh."""
    return rows.filter(F.lit(now) - F.col(at) <= hours * 3600)


def with_overrides(detected: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """A manual key wins, with confidence 1; both have ``pitch_class, minor``."""
    o = overrides.select(key, F.col("pitch_class").alias("o_pc"), F.col("minor").alias("o_minor"))
    manual = F.col("o_pc").isNotNull()
    return detected.join(o, key, "left").select(
        key, F.coalesce("o_pc", "pitch_class").alias("pitch_class"), F.coalesce("o_minor", "minor").alias("minor"),
        F.when(manual, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(manual, "manual").otherwise("detected").alias("source"),
    )


def append_once(history: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Append rows; a key that is there already is an error when the result is read."""
    both = history.unionByName(new)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return both.withColumn("_ok", F.when(n > 1, F.raise_error(F.lit("duplicate key"))).otherwise(F.lit(True))).filter("_ok").drop("_ok")
