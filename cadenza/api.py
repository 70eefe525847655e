"""What a service's routes would answer, as DataFrames with the digits that are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.config import DEFAULT, Tuning
from cadenza.operators import charts, library, matching, store


def track(tracks: DataFrame, track_id) -> DataFrame:
    return library.one_row(tracks.filter(F.col("track_id") == track_id), f"track {track_id}")


def analysis(tracks: DataFrame, sections: DataFrame, beats: DataFrame, track_id) -> DataFrame:
    """One track: tempo, key, counts, the first 64 downbeats and its sections."""
    b = beats.filter(F.col("track_id") == track_id).groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("_b"))
    s = sections.filter(F.col("track_id") == track_id).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.round("energy", 3).alias("energy")))).alias("sections"))
    down = F.filter("_b", lambda _, i: i % 4 == 0)
    shown = track(tracks, track_id).join(b, "track_id", "left").join(s, "track_id", "left")
    return shown.select(
        "track_id", F.round("bpm", 2).alias("bpm"), library.key_name(F.col("pitch_class"), F.when(F.col("minor"), "minor").otherwise("major")).alias("key"), F.round("confidence", 3).alias("confidence"),
        F.coalesce(F.size("_b"), F.lit(0)).alias("beats"), F.slice(down, 1, 64).alias("downbeats"), F.coalesce(F.size(down), F.lit(0)).alias("downbeat_count"), "sections",
    )


def set_key(overrides: DataFrame, track_id, pitch_class: int, mode: str) -> DataFrame:
    """The overrides with one more, or one replaced; a key beyond the twelve pitches and two modes is an error."""
    if not 0 <= pitch_class <= 11 or mode not in ("major", "minor"):
        raise ValueError("a key is a pitch class of 0 to 11 and major or minor")
    new = overrides.sparkSession.createDataFrame([(track_id, pitch_class, mode == "minor")], "track_id long, pitch_class int, minor boolean")
    return reset_key(overrides, track_id).unionByName(new)


def reset_key(overrides: DataFrame, track_id) -> DataFrame:
    gone = overrides.sparkSession.createDataFrame([(track_id,)], "track_id long")
    return store.delete(overrides, gone, "track_id")


def match(tracks: DataFrame, sections: DataFrame, chroma: DataFrame, a, b, intent: str = "match", top: int = 10, tuning: Tuning = DEFAULT) -> DataFrame:
    """How each section of ``a`` could move into each of ``b``, best first."""
    one = track(tracks, a).select(F.col("track_id").alias("a_track_id")).join(track(tracks, b).select(F.col("track_id").alias("b_track_id")), F.lit(True))
    ranked = matching.rank_pairs(one, tracks, sections, chroma, intent, tuning).filter(F.col("place") <= (top or tuning.top_n))
    return ranked.select("place", "a_idx", "b_idx", *[F.round(x, 4).alias(x) for x in ("tempo", "key", "chroma", "energy", "total")]).orderBy("place")


def mixes(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("created_at"))


def mix(history: DataFrame, mix_id) -> DataFrame:
    return library.one_row(history.filter(F.col("mix_id") == mix_id), f"mix {mix_id}")


def trends(merged: DataFrame) -> DataFrame:
    """The first hundred; more are never shown."""
    return merged.orderBy("rank").limit(100)


def missing(merged: DataFrame, tracks: DataFrame) -> DataFrame:
    """The first fifty songs that the library lacks."""
    return charts.missing(merged, tracks).orderBy("rank").limit(50)


def jobs(states: DataFrame) -> DataFrame:
    return states.orderBy(F.desc("created_at"))
