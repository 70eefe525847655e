"""Range, band and as-of joins as bucketed equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def range_join(points: DataFrame, intervals: DataFrame, x: str, lo: str, hi: str, keys: list[str], width: float) -> DataFrame:
    """Points with lo <= x < hi of the same keys; an interval goes to each bucket it touches, a point to one."""
    p = points.withColumn("_k", F.floor(F.col(x) / width))
    i = intervals.filter(F.col(hi) > F.col(lo)).withColumn("_k", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(i, [*keys, "_k"]).filter((F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi))).drop("_k")


def tempo_band_join(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Pairs with |b * ratio - a| <= tolerance * a; log-wide buckets, three probed, exact check after.

    Columns ``a_id, a_bpm`` and ``b_id, b_bpm``; a pair may come once a ratio.
    """
    width = -math.log(1 - tolerance)
    bucket = lambda c: F.floor(F.ln(c) / width)
    left = a.filter("a_bpm > 0").withColumn("_k", F.explode(F.array(*[bucket(F.col("a_bpm")) + d for d in (-1, 0, 1)])))
    right = b.filter("b_bpm > 0").withColumn("ratio", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)))).withColumn("_k", bucket(F.col("b_bpm") * F.col("ratio")))
    return left.join(right, "_k").filter(F.abs(F.col("b_bpm") * F.col("ratio") - F.col("a_bpm")) <= tolerance * F.col("a_bpm")).drop("_k")


def tempo_band_counts(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """``a_id, n``: how many of ``b`` lie in each one's band.

    Distinct tempi are joined, not tracks, so a common tempo costs one row; with
    a tolerance below a third nothing lies in the bands of two ratios at once.
    """
    asked = a.select("a_bpm").distinct()
    tally = b.groupBy("b_bpm").agg(F.count(F.lit(1)).alias("_n"))
    counts = tempo_band_join(asked, tally, tolerance).groupBy("a_bpm").agg(F.sum("_n").alias("n"))
    return a.join(counts, "a_bpm").select("a_id", "n")


def nearest(array: Column, x: Column) -> Column:
    """The first nearest element of a sorted array."""
    return F.array_min(F.transform(array, lambda t: F.struct(F.abs(t - x).alias("d"), t.alias("t"))))["t"]
