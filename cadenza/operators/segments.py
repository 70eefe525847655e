"""Segmentation of tracks: contiguous clusters of beat features, then bounds of a least length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.operators import blocks
from cadenza.operators.joins import nearest


#: Sections of a track that are compared in one place, at most about so many, and those that meet them at a time.
ALIKE, MEET = 4096, 1024


def recurrence(sections: DataFrame, chroma: DataFrame, near: float = 0.92) -> DataFrame:
    """How many other sections of its track each section resembles; sections of one track meet, never tracks.

    A place of a track is a part of its sections (all, if there are few), and
    what it is compared with passes by, so a task holds one part, no pairs.
    """
    from cadenza.functions.music import unit

    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("track_id")) / ALIKE).cast("int")
    units = chroma.select("vec_id", F.coalesce(unit(F.col("chroma")), F.array(*[F.lit(0.0)] * 12)).alias("unit"))
    s = sections.select("track_id", "idx", "vec_id", parts.alias("_n")).join(units, "vec_id").withColumn("_of", F.pmod(F.xxhash64("idx"), F.col("_n")).cast("int"))
    dealt = s.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = dealt.select("track_id", "idx", "_at", (F.col("_at") != F.col("_of")).alias("_other"), "unit").repartition("track_id", "_at").sortWithinPartitions("track_id", "_at", "_other")
    out = s.select("track_id", "idx", F.lit(0).cast("long").alias("n")).schema
    return rows.mapInArrow(lambda batches: alike(batches, near), out)


def alike(batches: Iterator[pa.RecordBatch], near: float) -> Iterator[pa.RecordBatch]:
    """``track_id, idx, n`` of each place's own sections; these come first, then the others that they meet."""
    place: Place | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        track, idx, at, other, unit = batch.columns
        units = unit.flatten().to_numpy(zero_copy_only=False).reshape(-1, 12)
        numbers, at, other = idx.to_numpy(zero_copy_only=False), at.to_numpy(zero_copy_only=False), other.to_numpy(zero_copy_only=False)
        fresh = np.ones(batch.num_rows, dtype=bool)
        # A track without a name is none: each of its sections stands alone.
        fresh[1:] = pc.fill_null(pc.not_equal(track[1:], track[:-1]), True).to_numpy(zero_copy_only=False) | (at[1:] != at[:-1])
        turns = fresh.copy()
        turns[1:] |= other[1:] != other[:-1]
        bounds = [*np.flatnonzero(turns).tolist(), batch.num_rows]
        done = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            name = (track[lo].as_py(), at[lo]) if lo == 0 else None
            if fresh[lo] and (lo or place is None or name[0] is None or place.name != name):
                if place is not None and place.parts:
                    done.append(place.told())
                place = Place(near)
            if other[lo]:
                place.meet(units[lo:hi])
            else:
                place.add(track.slice(lo, hi - lo), idx.slice(lo, hi - lo), numbers[lo:hi], units[lo:hi])
        place.name = (track[lo].as_py(), at[lo])
        if done:
            yield batch_of(done)
    if place is not None and place.parts:
        yield batch_of([place.told()])


def batch_of(parts: list[tuple]) -> pa.RecordBatch:
    track, idx, n = zip(*parts, strict=True)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(track), pa.concat_arrays(idx), pa.array(np.concatenate(n))], names=["track_id", "idx", "n"])


class Place:
    """A part of a track's sections, with how many others each of them resembles."""

    def __init__(self, near: float):
        self.near, self.name, self.parts, self.n = near, None, [], None

    def add(self, *part) -> None:
        self.parts.append(part)

    def close(self, units: np.ndarray) -> np.ndarray:
        return np.round(np.clip(np.nan_to_num(self.units @ units.T, nan=1.0), 0.0, 1.0), 9) > self.near

    def settle(self) -> None:
        """All own sections are there: they meet each other."""
        track, idx, numbers, units = zip(*self.parts, strict=True)
        one = len(track) == 1
        self.track, self.idx = (track[0], idx[0]) if one else (pa.concat_arrays(track), pa.concat_arrays(idx))
        self.numbers, self.units = (numbers[0], units[0]) if one else (np.concatenate(numbers), np.concatenate(units))
        self.n = np.zeros(len(self.units), dtype=np.int64)
        for lo in range(0, len(self.units), MEET):
            other = self.numbers[:, None] != self.numbers[None, lo : lo + MEET]
            self.n += (self.close(self.units[lo : lo + MEET]) & other).sum(axis=1)

    def meet(self, units: np.ndarray) -> None:
        if not self.parts:
            return
        if self.n is None:
            self.settle()
        for lo in range(0, len(units), MEET):
            self.n += self.close(units[lo : lo + MEET]).sum(axis=1)

    def told(self) -> tuple:
        """A section that occurs twice is one, with what all its rows resemble."""
        if self.n is None:
            self.settle()
        numbers, first, back = np.unique(self.numbers, return_index=True, return_inverse=True)
        if len(numbers) == len(self.n) or self.track[0].as_py() is None:
            return self.track, self.idx, self.n
        return self.track.take(pa.array(first)), self.idx.take(pa.array(first)), np.bincount(back, self.n).astype(np.int64)


def novelty(beats: DataFrame, group: str = "track_id", i: str = "i", vector: str = "chroma") -> DataFrame:
    """One less the cosine of each vector with the one before; 0 for the first and for a zero vector."""
    from cadenza.functions.music import dot

    prev = F.lag(vector).over(Window.partitionBy(group).orderBy(i))
    norms = F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(F.col("_prev"), F.col("_prev")))
    return beats.withColumn("_prev", prev).select(group, i, F.when(norms > 0, 1 - dot(F.col(vector), F.col("_prev")) / F.nullif(norms, F.lit(0.0))).otherwise(0.0).alias("novelty"))


def zscored(long: DataFrame, group: list[str], x: str) -> DataFrame:
    """``x`` less its mean over its deviation within ``group``; a deviation of about 0 counts as 1."""
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(x).over(w)
    return long.withColumn("z", (F.col(x) - F.avg(x).over(w)) / F.when(sd < 1e-9, 1.0).otherwise(sd))


def cluster_starts(features: np.ndarray, k: int) -> list[int]:
    """First rows of ``k`` contiguous clusters; the neighbours whose union adds least variance merge first (Ward), the left ones on ties."""
    sums = [np.array(x, dtype=float) for x in features]
    sizes, starts = [1] * len(sums), list(range(len(sums)))

    def price(j: int) -> float:
        gap = sums[j] / sizes[j] - sums[j + 1] / sizes[j + 1]
        return sizes[j] * sizes[j + 1] / (sizes[j] + sizes[j + 1]) * float(gap @ gap)

    prices = [price(j) for j in range(len(sums) - 1)]
    while len(starts) > max(k, 1):
        j = int(np.argmin(prices))
        sums[j] = sums[j] + sums[j + 1]
        sizes[j] += sizes[j + 1]
        for held in (sums, sizes, starts):
            del held[j + 1]
        del prices[j]
        if j < len(prices):
            prices[j] = price(j)
        if j > 0:
            prices[j - 1] = price(j - 1)
    return starts


def n_segments(duration: Column) -> Column:
    """One for each quarter of a minute, from 3 to 14."""
    return F.greatest(F.lit(3), F.least(F.lit(14), F.bround(duration / 15).cast("int")))


def boundaries(beats: DataFrame) -> DataFrame:
    """``track_id, t`` where a cluster starts; ``beats`` has ``track_id, i, t, features, k``. A track's beats are one group."""

    met = beats.groupBy("track_id", "k").agg(F.array_sort(F.collect_list(F.struct("i", "t", F.col("features").cast("array<double>").alias("f")))).alias("z"))
    rows = met.select("track_id", "k", F.col("z.t").cast("array<double>").alias("t"), F.size(F.col("z.f")[0]).alias("width"), F.flatten("z.f").alias("f"))
    # A row a track, so that a task goes through many tracks at a time.
    found = blocks.by_row(rows, {"t": "array<double>"}, lambda row: (row.t[cluster_starts(row.f.reshape(-1, row.width), int(row.k))[1:]],), ("k", "width", "f"))
    return found.select("track_id", F.explode("t").alias("t"))


def least_length(edges: Column, least: Column) -> Column:
    """Sorted edges without those nearer than ``least`` to the last kept one or to the end; both ends stay."""
    end = F.element_at(edges, -1)
    inner = F.slice(edges, F.lit(2), F.greatest(F.lit(0), F.size(edges) - 2))
    kept = F.aggregate(inner, F.slice(edges, 1, 1), lambda a, x: F.when((x - F.element_at(a, -1) >= least) & (end - x >= least), F.concat(a, F.array(x))).otherwise(a))
    return F.when(F.size(edges) <= 2, edges).otherwise(F.concat(kept, F.array(end)))


def snapped(found: DataFrame, downbeats: DataFrame) -> DataFrame:
    """``track_id, t`` of ``found`` moved to the nearest downbeat where that is at most a bar away."""
    moved = found.join(grids(downbeats), "track_id", "left").withColumn("_near", nearest(F.col("grid"), F.col("t")))
    return moved.select("track_id", F.when(F.abs(F.col("_near") - F.col("t")) <= F.col("bar"), F.col("_near")).otherwise(F.col("t")).alias("t"))


def grids(downbeats: DataFrame) -> DataFrame:
    """``track_id, grid, bar``: sorted downbeats and the median bar, of two seconds where there are fewer than three."""
    g = downbeats.groupBy("track_id").agg(F.array_sort(F.collect_list("t")).alias("grid"))
    gap = F.percentile("gap", 0.5)
    gaps = downbeats.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("track_id").orderBy("t"))).groupBy("track_id").agg(gap.alias("gap"))
    return g.join(gaps, "track_id").select("track_id", "grid", F.when(F.size("grid") > 2, F.col("gap")).otherwise(F.lit(2.0)).alias("bar"))


def segment(beats: DataFrame, lengths: DataFrame, least: float, downbeats: DataFrame | None = None, bars: int = 4) -> DataFrame:
    """``track_id, idx, start, end`` of each track; ``lengths`` has ``track_id, duration``.

    With ``downbeats`` bounds lie on them and a section has ``bars`` at least.
    ``least`` is at most a third of a track. A track of fewer than eight beats is one section.
    """
    n = beats.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 8")
    k = F.least(n_segments(F.col("duration")), F.col("n").cast("int") - 1)
    found = boundaries(beats.join(lengths.filter("duration > 0").join(n, "track_id").select("track_id", k.alias("k")), "track_id"))
    shortest = F.lit(least)
    if downbeats is not None:
        found = snapped(found, downbeats)
        lengths = lengths.join(grids(downbeats).select("track_id", "bar"), "track_id", "left")
        shortest = F.greatest(shortest, bars * F.coalesce("bar", F.lit(2.0)))
    ts = found.groupBy("track_id").agg(F.collect_set("t").alias("ts"))
    every = lengths.join(ts, "track_id", "left").withColumn("ts", F.coalesce("ts", F.array().cast("array<double>")))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("duration").cast("double")), "ts")))
    kept = every.select("track_id", least_length(edges, F.least(shortest, F.col("duration") / 3)).alias("e"))
    pieces = F.transform(F.slice("e", F.lit(1), F.size("e") - 1), lambda x, j: F.struct(x.alias("start"), F.element_at("e", j + 2).alias("end")))
    return kept.select("track_id", F.posexplode(pieces).alias("idx", "s")).select("track_id", "idx", "s.start", "s.end")
