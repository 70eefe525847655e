"""Approximate nearest neighbours in a hash-prefix forest.

Each tree gives a vector a long bit string (signs of random projections) and
keeps the strings of a segment as a sorted array. Segments hold a bounded number
of vectors, all of them are indexed, and the index is stored once. A query
descends every tree to the vectors that share a long prefix with it, and scores
these exactly. Its k-th best score over all segments then tells how short the
prefixes must become before a vector of that score is met in one of the trees
with the wanted chance; all trees ascend together, ``STEP`` bits at a time, until
they are that short. Queries with near neighbours end high up in few vectors;
among random directions the ascent goes on to a large share of the table, and
``recall=1`` ascends to the roots, which is the exact search. Queries go out in
bounded blocks and each segment returns its best ``k``, so nothing grows with
the table in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.llm.common import released, small_batches, stored

SEGMENT, TREES, BITS, SEED = 16_384, 96, 32, 3
#: Wanted chance to meet a vector as good as the k-th best one found.
RECALL = 0.9
#: The first prefixes are expected to hold so many times ``k`` entries in all trees; bits by which the trees ascend at once.
FIRST, STEP = 8, 2
BLOCK_QUERIES = 8_192


def usable(vec: str, dim: int) -> Column:
    """Full vectors of finite numbers, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def dimension(df: DataFrame, vec: str) -> int:
    """The commonest length; ties go to the longer."""
    top = df.filter(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return int(top["d"]) if top else 0


def codes(x: np.ndarray, largest: float, query: bool = False) -> np.ndarray:
    """(tree, vector) bit strings, as 32-bit numbers.

    A further component lifts all vectors to the length ``largest``; a query has
    none there, so the angle to it follows the inner product alone.
    """
    if query:
        full = np.column_stack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))]).astype(np.float32)
    else:
        full = np.column_stack([x / largest, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1) / largest**2))]).astype(np.float32)
    planes = np.random.default_rng(SEED).standard_normal((TREES, BITS, x.shape[1] + 1)).astype(np.float32)
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.uint64)
    return np.stack([(((full @ p.T) > 0) @ weights).astype(np.uint32) for p in planes])


def prefix_for(cosine: np.ndarray, recall: float) -> np.ndarray:
    """The longest prefix, in bits, that one of the trees shares with a vector of this cosine with the wanted chance."""
    same = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    lengths = np.arange(BITS + 1)
    met = 1 - (1 - same[:, None] ** lengths) ** TREES
    return (met >= recall).cumprod(axis=1).sum(axis=1) - 1


def build(df: DataFrame, key: str, vec: str, dim: int, largest: float) -> DataFrame:
    """One row per segment: ids, vectors, and each tree's sorted strings with their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, held = [], [], 0
        for batch in (*[], *batches, None):
            if batch is not None and len(batch):
                ids.append(batch["key"].to_numpy(np.int64))
                rows.append(np.stack(batch["vec"].to_numpy()).astype(np.float32 if batch["vec"].iloc[0].dtype == np.float32 else np.float64))
                held += len(batch)
            if held and (batch is None or held >= SEGMENT):
                x = np.concatenate(rows)
                c = codes(x.astype(np.float64), largest)
                order = np.argsort(c, axis=1, kind="stable")
                yield pd.DataFrame({"ids": [np.concatenate(ids).tobytes()], "single": [x.dtype == np.float32], "x": [x.tobytes()], "strings": [np.take_along_axis(c, order, axis=1).astype(np.uint32).tobytes()], "order": [order.astype(np.int32).tobytes()]})
                ids, rows, held = [], [], 0

    return df.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("vec")).mapInPandas(lambda b: released(run(b)), "ids binary, single boolean, x binary, strings binary, order binary")


def look_up(sent, k: int, dim: int):
    """Each segment's best ``k`` for each query, among the vectors that share its prefix in any tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, vectors, strings_of, bits = sent.value
        low, span = prefix_bounds(strings_of, bits)
        for batch in batches:
            for row in batch.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                n = len(ids)
                x = np.frombuffer(row.x, np.float32 if row.single else np.float64).reshape(n, dim).astype(np.float64)
                strings = np.frombuffer(row.strings, np.uint32).reshape(TREES, n).astype(np.uint64)
                order = np.frombuffer(row.order, np.int32).reshape(TREES, n)
                left, right = (np.stack([np.searchsorted(strings[t], at[t]) for t in range(TREES)]) for at in (low, low + span))
                out_q, out_v, out_s, out_n = [], [], [], []
                for q in range(len(asked)):
                    mark = np.zeros(n, dtype=bool)
                    for t in np.flatnonzero(right[:, q] > left[:, q]):
                        mark[order[t, left[t, q] : right[t, q]]] = True
                    near = np.flatnonzero(mark)
                    near = near[ids[near] != asked[q]]
                    score = x[near] @ vectors[q]
                    scored = len(near)
                    if len(near) > k:
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        best = np.flatnonzero(score >= least)
                        near, score = near[best], score[best]
                    top = np.lexsort((ids[near], -score))[:k]
                    out_q.append(np.full(len(top), asked[q]))
                    out_v.append(ids[near[top]])
                    out_s.append(score[top])
                    out_n.append(np.where(np.arange(len(top)) == 0, scored, 0))
                yield pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s), "scored": np.concatenate(out_n)})

    return lambda batches: released(run(batches))


def prefix_bounds(strings: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least string, number of strings) that share the first ``bits`` bits."""
    gone = (BITS - bits).astype(np.uint64)
    return strings.astype(np.uint64) >> gone << gone, np.uint64(1) << gone


def best(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's best ``k``; a repeated row counts once."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", recall: float = RECALL) -> DataFrame:
    """Each query's ``k`` nearest rows by inner product: ``query_id, rank, vec_id, score, scored``.

    ``scored`` is the number of vectors that the query was compared with in its last ascent.

    Null and zero vectors, and those with null or non-finite components or
    another length than most, take no part. Fewer rows than ``k`` are all
    returned; ties go to the smaller id; rows of the query's own id are left
    out; a repeated row is returned once. An empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    dim = dimension(df, vec)
    good = df.filter(F.col(key).isNotNull() & usable(vec, dim))
    squares = F.aggregate(vec, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    stats = good.agg(F.max(F.sqrt(squares)).alias("largest"), F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("asked")).first()
    largest, n = stats["largest"] or 1.0, stats["n"]
    index = stored(build(good, key, vec, dim, largest))
    n_blocks = -(-stats["asked"] // BLOCK_QUERIES)
    first = min(BITS, max(0, math.floor(math.log2(max(1.0, n * TREES / (FIRST * k))))))
    done = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scored long")
    asked = stored(good.filter(is_query).select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")))
    for b in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(n_blocks)) == b).dropDuplicates(["key"]).toPandas()
        if not len(block):
            continue
        ids, vectors = block["key"].to_numpy(np.int64), np.stack(block["vec"].to_numpy())
        strings, lengths = codes(vectors, largest, query=True), np.sqrt((vectors * vectors).sum(axis=1)) * largest
        todo, bits = np.arange(len(ids)), np.full(len(ids), first)
        while len(todo):
            sent = spark.sparkContext.broadcast((ids[todo], vectors[todo], strings[:, todo], bits[todo]))
            found = index.mapInPandas(look_up(sent, k, dim), "query_id long, vec_id long, score double, scored long")
            top = stored(best(found.withColumn("scored", F.sum("scored").over(Window.partitionBy("query_id"))), k).select(*done.columns))
            sent.unpersist()
            worst = top.filter(F.col("rank") == k).select("query_id", "score").toPandas()
            place = {q: i for i, q in enumerate(ids[todo].tolist())}
            cosine = np.full(len(todo), -np.inf)
            cosine[[place[q] for q in worst["query_id"].tolist()]] = worst["score"].to_numpy()
            cosine /= lengths[todo]
            # With fewer than k found there is no score to go by, and the ascent goes on.
            need = np.where(np.isfinite(cosine), prefix_for(np.nan_to_num(cosine, neginf=0.0), recall), 0)
            more = need < bits[todo]
            ended = spark.createDataFrame(pd.DataFrame({"query_id": ids[todo[~more]]}), "query_id long")
            done = done.unionByName(top.join(F.broadcast(ended), "query_id").select(*done.columns))
            bits[todo] = np.maximum(need, bits[todo] - STEP)
            todo = todo[more]
    return done
