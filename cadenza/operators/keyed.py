"""A keyed table on shared storage: a write rewrites the buckets it touches, and counts only once it is whole.

Rows lie in folders by a hash of their key. A write puts new folders beside the
old ones, then commits a small table that says which folder holds each bucket;
readers take the last one that is complete. So a write that is killed, or runs
again, leaves what was there. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from cadenza.operators.store import kept

BUCKETS = 64


def commits(spark: SparkSession, path: str, whole: bool = True) -> list[int]:
    """Numbers of the complete commits, in order; with those that were broken off, if not ``whole``."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    place = Path(f"{path}/commits")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.listStatus(place) if fs.exists(place) else []
    return sorted(int(x.getPath().getName()) for x in held if not whole or fs.exists(Path(x.getPath(), "_SUCCESS")))


def folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each bucket that has rows, ``BUCKETS`` or what was chosen at most."""
    numbers = commits(spark, path)
    if not numbers:
        return {}
    return {r["bucket"]: r["folder"] for r in spark.read.schema("bucket int, folder string, buckets int").parquet(f"{path}/commits/{numbers[-1]}").collect()}


def _rows(spark: SparkSession, path: str, held: list[str], schema: StructType) -> DataFrame:
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{x}" for x in held])


def state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that are there; none before the first write."""
    held = StructType([*schema.fields, StructField("_gone", BooleanType())])
    return _rows(spark, path, sorted(folders(spark, path).values()), held).filter("not _gone").drop("_gone")


def merge(path: str, batch: DataFrame, key: list[str], at: list[str], gone: bool = False, buckets: int = BUCKETS) -> None:
    """Write ``batch``: of each key the row with the largest ``at`` stays, the new one of equal ones; with ``gone``, keys are deleted.

    A deleted key keeps a mark, so a write that is older than its deletion does
    not bring it back. The number of buckets is the table's, from its first
    write on. An empty batch writes nothing.
    """
    spark = batch.sparkSession
    numbers, held = commits(spark, path), folders(spark, path)
    if numbers:
        buckets = spark.read.parquet(f"{path}/commits/{numbers[-1]}").select("buckets").first()["buckets"]
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    newest = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in at], F.desc("_new"))
    last = lambda rows: rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    new = kept(last(batch.withColumns({"_gone": F.lit(gone), "_new": F.lit(True)})).drop("_new"))
    touched = sorted(r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect())
    if not touched:
        return
    old = _rows(spark, path, [held[b] for b in touched if b in held], new.schema)
    both = last(old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))).drop("_new")
    write = uuid.uuid4().hex
    both.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows/{write}")
    held |= {b: f"{write}/bucket={b}" for b in touched}
    listed = spark.createDataFrame([(b, f, buckets) for b, f in sorted(held.items())], "bucket int, folder string, buckets int")
    listed.coalesce(1).write.parquet(f"{path}/commits/{max(commits(spark, path, whole=False), default=0) + 1}")
