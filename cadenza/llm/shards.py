"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters records by a seeded hash into buckets that fit a task's
memory; pass two runs a seeded Fisher-Yates shuffle in each bucket. Buckets
follow each other, so a record's place in the whole order is known from the
bucket's offset, and shards are equal ranges of that order: no second shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cadenza.llm.common import running_offsets, small_batches, spare

BUCKET_BYTES, SHARDS, SEED = 8 << 20, 8, 20_260_101


def size_of(text: str = "text"):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Law ``rows``: row counts of shards are at most one apart. Nulls, ties and
    repeated rows are records like all others; rows of equal id and text share
    a bucket, as a record's place follows from its content and the seed alone.
    Columns named like those added are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("shard", "slot")])
    own, bucket, first = spare(docs.columns, "_key", "_bucket", "_first")
    totals = docs.agg(F.sum(size_of()).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_rows, n_buckets = totals["n"], max(1, -(-(totals["bytes"] or 0) // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    scattered = docs.withColumn(own, key).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), own), F.lit(n_buckets)))
    offsets = running_offsets(scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), bucket)
    edges = np.array([n_rows * k // shards for k in range(shards + 1)])
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def fisher_yates(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(own, kind="stable")
        order = np.random.default_rng([seed, int(held[bucket].iloc[0])]).permutation(len(held))
        mixed = held.iloc[order]
        place = int(held[first].iloc[0]) + np.arange(len(mixed))
        shard = np.searchsorted(edges, place, side="right") - 1
        return mixed.drop(columns=[own, bucket, first]).assign(shard=shard, slot=place - edges[shard])

    placed = scattered.join(offsets.withColumnRenamed("offset", first), bucket)
    return placed.groupBy(bucket).applyInPandas(fisher_yates, schema)


def write(shuffled: DataFrame, path: str) -> None:
    """One folder a shard; each bucket's task writes its own range, ordered by slot."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
