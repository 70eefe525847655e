"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SALT_ROWS = 4_096
#: Arrow batches hold so many rows and bytes at most, in all operators alike: one text may be very long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def scratch(spark: SparkSession) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``.

    Where the setting is missing (local runs and tests) a temporary folder is
    set as the checkpoint folder, once a session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    ``group_rows``: rows of a row group at most, where rows are large; a task holds a group at a time.
    """
    path = scratch(df.sparkSession)
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores before them until none is a column already; case tells no columns apart."""
    held = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounded Arrow batches; every operator sets the same, so the order of building plans does not matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(rows: Iterator) -> Iterator:
    """The rows; after them, what the task held goes back to the system, since Python workers outlive their tasks."""
    yield from rows
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def running_offsets(counts: DataFrame, key: str, n: str = "n", within: list[str] | None = None, fan: int = 1024) -> DataFrame:
    """``offset``: the sum of ``n`` over smaller ``key``s (long, dense from 0), in two levels.

    ``within`` restarts the sum for each group. No task sees more than ``fan``
    keys of a group, or the group's number of keys divided by ``fan``.
    """
    within = within or []
    c = counts.withColumn("_coarse", F.expr(f"`{key}` div {fan}"))
    coarse = c.groupBy(*within, "_coarse").agg(F.sum(n).alias("_n"))
    w1 = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_base", F.coalesce(F.sum("_n").over(w1), F.lit(0))).drop("_n")
    w2 = Window.partitionBy(*within, "_coarse").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_own", F.coalesce(F.sum(n).over(w2), F.lit(0)))
    return c.join(coarse, [*within, "_coarse"]).select(*within, key, (F.col("_base") + F.col("_own")).cast("long").alias("offset"))


def ranked(df: DataFrame, group: str, order: list[Column], rows: int, out: str = "rank") -> DataFrame:
    """A gapless ``rank`` from 0 within ``group`` without one task for a group.

    Rows are dealt to salts by a hash of their order, counted by (group, salt),
    and numbered inside a salt; salts follow each other.
    """
    n_salts = max(1, -(-rows // SALT_ROWS))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order, F.lit(11)), F.lit(n_salts)))
    counts = salted.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = running_offsets(counts, "_salt", within=[group])
    w = Window.partitionBy(group, "_salt").orderBy(*order)
    numbered = salted.withColumn("_i", F.row_number().over(w) - 1)
    return numbered.join(offsets, [group, "_salt"]).withColumn(out, F.col("offset") + F.col("_i")).drop("_salt", "_i", "offset")
