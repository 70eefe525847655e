"""From charts to a set, as one chain: merge, resolve, claim, sample, keep, order, plan, lay out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.config import DEFAULT, Tuning
from cadenza.operators import analysis, charts, fuzzy, matching, sets
from cadenza.operators.store import kept as stored

#: A set is chosen from twice the tracks it needs, since some do not fit its tempo.
SPARE = 2


def resolved(merged: DataFrame, tracks: DataFrame, tuning: Tuning = DEFAULT) -> DataFrame:
    """``key, track_id, match_score, hit`` of every song: exact keys first, the rest by token sets; of songs that name one file the best-ranked has it."""
    exact = charts.resolve_exact(merged, tracks)
    lost = charts.missing(merged, tracks)
    rest = fuzzy.resolution(lost, tracks, tuning.fuzzy_threshold, tuning.near_miss)
    every = exact.select("key", "track_id", "match_score", F.lit(True).alias("hit")).unionByName(rest)
    ranked = every.join(merged.select("key", "rank"), "key")
    kept = charts.claim_once(ranked.filter("hit")).select("key", F.lit(True).alias("_kept"))
    return ranked.join(kept, "key", "left").filter("not hit or _kept").drop("_kept")


def chosen(merged: DataFrame, found: DataFrame, wanted: int, ratio: float, seed: int) -> DataFrame:
    """``track_id, place``: twice as many as wanted of the songs that are there, likelier by score."""
    there = merged.join(found.filter("hit").select("key", "track_id"), "key")
    return charts.weighted_sample(there, SPARE * wanted, ratio, seed).join(there.select("key", "track_id"), "key").select("track_id", "place")


def set_of(picked: DataFrame, tracks: DataFrame, sections: DataFrame, chroma: DataFrame, grids: DataFrame, minutes: float, wanted: int, group: str = "set_id", tuning: Tuning = DEFAULT) -> dict[str, DataFrame]:
    """``kept, order, joins, clips``: the set (or one for each ``group``) of the picked tracks (``group, track_id``).

    ``grids``: ``track_id, grid, duration``.
    """
    named = picked.join(tracks.select("track_id", "bpm"), "track_id")
    kept = stored(sets.kept_tracks(named, matching.set_tempi(named, group), wanted, group, tuning))
    playing = kept.filter("fate = 'kept'").select(group, "track_id", "bpm", "tempo", "rate")
    energies = matching.track_energy(sections)
    order = stored(matching.running_order(playing.select(group, "track_id", "bpm"), energies, group, tuning))
    joins = matching.plan_set(order, tracks, sections, chroma, group, tuning)
    starts = sets.default_start(analysis.labelled(sections))
    rows = order.join(playing, [group, "track_id"]).join(grids, "track_id")
    return {"kept": kept, "order": order, "joins": joins, "clips": sets.layout(rows, joins, starts, minutes, group, tuning)}


def create_set(listed: DataFrame, tracks: DataFrame, sections: DataFrame, chroma: DataFrame, grids: DataFrame, minutes: float, wanted: int, ratio: float = 0.7, seed: int = 7, tuning: Tuning = DEFAULT) -> dict[str, DataFrame]:
    """The whole flow for one request: ``merged, found, picked`` and what ``set_of`` returns; the set's ``set_id`` is 0.

    What many steps read is written to the shared folder once. Fewer than two songs that the library holds make no set: the clips are then empty.
    """
    merged = stored(charts.merge_trends(listed, tuning))
    found = stored(resolved(merged, tracks, tuning))
    picked = stored(chosen(merged, found, wanted, ratio, seed).select(F.lit(0).alias("set_id"), "track_id"))
    # A set's tracks, ``SPARE * wanted`` at most, are named, so that readers leave all others before sections are ordered.
    ids = [r["track_id"] for r in picked.select("track_id").collect()]
    tracks, sections, grids = (x.filter(F.col("track_id").isin(ids)) for x in (tracks, sections, grids))
    told = set_of(picked, tracks, sections, chroma, grids, minutes, wanted, tuning=tuning)
    enough = F.broadcast(picked.agg((F.count(F.lit(1)) >= 2).alias("_enough")).filter("_enough"))  # one row or none
    return {"merged": merged, "found": found, "picked": picked, **told, "clips": told["clips"].join(enough, F.lit(True), "left_semi")}
