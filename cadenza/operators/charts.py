"""Charts: union, merge, sampling, resolution against the library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cadenza.config import DEFAULT, Tuning
from cadenza.functions import music, text
from cadenza.operators.fuzzy import library_keys


def chart_union(charts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, charts)


def merge_trends(charts: DataFrame, tuning: Tuning = DEFAULT) -> DataFrame:
    """One row per song: the best entry's names (and links, if there are any), providers, winning region, score and place.

    A song that charts in IL counts there; otherwise its best place is that of
    the global charts, or of whatever else it has.
    """
    keyed = charts.withColumn("key", text.match_key(F.col("title"), F.col("artist"))).filter("key <> ''")
    said = [c for c in ("title", "artist", "url", "artwork") if c in charts.columns]
    g = keyed.groupBy("key").agg(
        F.min_by(F.struct(*said), F.struct("rank", "provider", "region", "song")).alias("best"),
        F.array_sort(F.collect_set("provider")).alias("providers"),
        F.min(F.when(F.col("region") == "IL", F.col("rank"))).alias("il"),
        F.min(F.when(F.col("region") == "global", F.col("rank"))).alias("world"),
        F.min("rank").alias("any"),
    )
    n = F.size("providers")
    weight = F.when(F.col("il").isNotNull(), tuning.israel_weight).when(F.col("world").isNotNull(), tuning.global_weight).otherwise(tuning.other_weight)
    rank = F.coalesce("il", "world", "any")
    score = music.rank_score(rank, tuning.chart_size) * weight * F.when(n > 1, 1 + tuning.agreement_bonus * (n - 1)).otherwise(1.0)
    out = g.select(
        "key", *[f"best.{c}" for c in said], F.array_join("providers", ",").alias("providers"), F.when(F.col("il").isNotNull(), "IL").otherwise("global").alias("region"),
        rank.alias("best_rank"), F.round(score, 9).alias("score"),
    )
    # At most ``max_trends`` rows are numbered.
    top = out.orderBy(F.desc("score"), "key").limit(tuning.max_trends)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))


def provider_status(charts: DataFrame) -> DataFrame:
    return charts.groupBy("provider").pivot("region", ["IL", "global"]).count().select("provider", F.coalesce("IL", F.lit(0)).alias("il"), F.coalesce("global", F.lit(0)).alias("world"))


def weighted_sample(merged: DataFrame, count: int, ratio: float, seed: int) -> DataFrame:
    """``count`` songs without replacement, likelier by score, ``ratio`` of them from IL (half to even).

    A short stratum is topped up from the other. A stratum's songs are those of
    the largest ``ln(u) / weight`` (Efraimidis and Spirakis), u from a hash; the
    sample is ranked by score.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    il = F.col("region") == "IL"
    w = Window.partitionBy("region").orderBy(F.desc("draw"), "key")
    drawn = merged.filter(F.col("region").isin("IL", "global")).withColumn("draw", F.round(F.ln(u) / F.greatest("score", F.lit(1e-6)), 6)).withColumn("place", F.row_number().over(w))
    have = merged.agg(F.count_if(il).alias("n_il"), F.count_if(F.col("region") == "global").alias("n_world"))
    first = F.least(F.col("n_il"), F.lit(round(count * ratio)))
    other = F.least(F.col("n_world"), F.lit(count) - first)
    short = F.greatest(F.lit(0), F.lit(count) - first - other)
    il_all = F.least(F.col("n_il"), first + short)
    sizes = have.select(il_all.alias("take_il"), F.when(il_all > first, other).otherwise(F.least(F.col("n_world"), other + short)).alias("take_world"))
    chosen = drawn.join(F.broadcast(sizes), F.lit(True)).filter(F.col("place") <= F.when(il, F.col("take_il")).otherwise(F.col("take_world")))  # one row
    # At most ``count`` rows are numbered.
    return chosen.select("key", "region", "score").withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "key")))


def resolve_exact(merged: DataFrame, tracks: DataFrame) -> DataFrame:
    return merged.join(library_keys(tracks).drop("first_id"), "key").select("key", "track_id", "rank", F.lit(100.0).alias("match_score"))


def missing(merged: DataFrame, tracks: DataFrame) -> DataFrame:
    return merged.join(library_keys(tracks), "key", "left_anti").select("key", "rank")


def claim_once(resolved: DataFrame) -> DataFrame:
    """A file goes to the best-ranked of its trends; the others are dropped."""
    w = Window.partitionBy("track_id").orderBy("rank", "key")
    return resolved.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def coverage(resolved: DataFrame, lost: DataFrame) -> DataFrame:
    both = resolved.select(F.lit(1).alias("hit")).unionByName(lost.select(F.lit(0).alias("hit")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg("hit"), 9), F.lit(0.0)).alias("coverage"))
