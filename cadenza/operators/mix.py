"""A set's sound: its clips cut, trimmed, joined and summed, and the sum mastered.

Sound moves twice: parts of a track go to its clips, and what these make of them goes
to the blocks of their set. A row is a block with its borders, or one side of a join,
never a set or a whole track.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cadenza.config import DEFAULT
from cadenza.operators import blocks, levels, transitions
from cadenza.operators.sound import target_gain
from cadenza.operators.store import kept

#: The first clip's fade and the limiter's release, in seconds.
FADE_SECONDS, RELEASE = 0.05, 0.12


def placed(clips: DataFrame, rate: int, group: str = "set_id") -> DataFrame:
    """Clips on a clock of samples: ``group, slot, track_id, first, n, head, keep, last`` and what ``layout`` told.

    ``head``: samples that a clip shares with the one before. ``keep``: where its own
    sound ends because the next one's join begins. A join reaches back over the clip
    before as far as that one's own head, not into the joins before it.
    """
    w = Window.partitionBy(group).orderBy("slot")
    rows = clips.withColumns({"first": F.round(F.col("start") * rate).cast("long"), "n": F.floor(F.col("seconds") * rate).cast("long")}).filter("n > 0")
    want = F.least(F.floor(F.col("overlap") * rate).cast("long"), F.col("n"))
    rows = rows.withColumn("_want", F.when(F.lag("slot").over(w).isNull(), 0).otherwise(want))
    # What is left of the clip before once its own head is taken; a head is at most half of a clip, so this follows from the wishes alone.
    left = F.lag("n").over(w) - F.lag("_want").over(w)
    rows = rows.withColumn("head", F.greatest(F.lit(0), F.least("_want", F.coalesce(left, F.lit(0)))).cast("long"))
    # The next clip begins where its head fits, whatever was rounded.
    rows = rows.withColumn("_step", F.coalesce(F.lag("n").over(w) - F.col("head"), F.col("first")))
    rows = rows.withColumn("first", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("keep", F.coalesce(F.col("n") - F.lead("head").over(w), F.col("n"))).drop("_want", "_step")


def heard(spans: DataFrame, audio: DataFrame, out: dict[str, str], make: Callable, drop: tuple[str, ...] = ()) -> DataFrame:
    """``spans`` without ``drop``, with the columns ``out`` that ``make`` gives of a row and its samples.

    A span has ``track_id``, ``rate`` and ``cut``, and is the samples ``low`` to before
    ``high`` of a clip: read from its track, from the sample ``cut`` on and at its rate,
    between neighbouring samples. ``audio``: ``track_id, first, x``, the parts of a
    track in any lengths; with ``m`` a part is a loop, ``x`` again and again for ``m``
    samples. What no part holds is silence. Parts go to the spans of their track, and
    what they give is made there.
    """
    looped = "m" in audio.columns
    first, low, high = F.col("_first"), F.col("cut") + F.col("low") * F.col("rate"), F.col("cut") + (F.col("high") - 1) * F.col("rate")
    parts = audio.filter(F.size("x") > 0).select(F.col("track_id").alias("_track"), F.col("first").cast("long").alias("_first"), (F.col("m").cast("long") if looped else F.size("x")).alias("_m"), F.col("x").alias("_x"))
    # A part that begins just beyond a span tells the sample that the last one before it is read towards.
    met = spans.join(parts, (F.col("track_id") == F.col("_track")) & (first <= high + 2) & (first + F.col("_m") >= low - 2), "left")
    skip = F.greatest(F.lit(0), F.floor(low - first).cast("long") - 2)
    long = F.greatest(F.lit(0), F.ceil(high - first).cast("long") + 3 - skip)
    cut = F.col("_x") if looped else F.slice("_x", skip.cast("int") + 1, long.cast("int"))
    told = lambda x, name: F.coalesce(x, F.lit(0)).cast("long").alias(name)
    part = F.struct(told(first, "first"), told(F.col("_m"), "m"), told(skip, "skip"), told(F.least(long, F.col("_m") - skip), "long"), F.coalesce(cut.cast("array<double>"), blocks.nothing()).alias("x"))
    rows = met.groupBy(*spans.columns).agg(F.collect_list(part).alias("z"))
    rows = rows.select(*spans.columns, *[F.col(f"z.{x}").alias(f"z_{x}") for x in ("first", "m", "skip", "long", "x")]).withColumns({"z_n": F.transform("z_x", F.size), "z_x": F.flatten("z_x")})

    def run(row):
        x, parts = np.zeros(row.high - row.low), list(zip(row.z_first, row.z_m, row.z_skip, row.z_long, np.split(row.z_x, np.cumsum(row.z_n)[:-1]), strict=True))
        begun = {f: v[0] for f, _, skip, _, v in parts if skip == 0 and len(v)}
        for f, m, skip, long, v in parts:
            a, z = max(row.low, math.ceil((f - row.cut) / row.rate)), min(row.high, math.ceil((f + m - row.cut) / row.rate))
            if a >= z or not len(v):
                continue
            v = v.take(np.arange(skip, skip + long), mode="wrap") if looped else v
            if skip + len(v) == m:
                after = begun.get(f + m, np.nan)
                v = np.append(v, v[-1] if np.isnan(after) else after)
            v, at = np.nan_to_num(v), row.cut + np.arange(a, z) * row.rate - f
            # Rounding may put a sample a hair outside of its part.
            k = np.clip(np.floor(at), 0, m - 1).astype(np.int64)
            x[a - row.low : z - row.low] += v[k - skip] + (at - k) * (v[k + 1 - skip] - v[k - skip])
        return make(row, x)

    return blocks.by_row(rows, out, run, (*drop, "track_id", "rate", "cut", "low", "high", "z_first", "z_m", "z_skip", "z_long", "z_n", "z_x"))


def taken(clips: DataFrame, audio: DataFrame, rate: int, group: str = "set_id") -> DataFrame:
    """``group, slot, n, block, x, before``: each clip's samples in blocks, with those before a block that K-weighting remembers."""
    size, back, n = levels.block_size(rate, RELEASE), len(levels.k_response(rate)), F.col("n").cast("long")
    at = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))
    spans = clips.select(group, "slot", "track_id", n.alias("n"), "rate", (F.col("cut_start") * rate).alias("cut"), F.posexplode(at).alias("block", "low"))
    spans = spans.withColumns({"block": F.col("block").cast("long"), "low": F.greatest(F.lit(0), F.col("low") - back), "high": F.least("n", F.col("low") + size)})
    parted = lambda row, x: (x[row.block * size - row.low :], x[: row.block * size - row.low])
    return heard(spans, audio, {"x": "array<double>", "before": "array<double>"}, parted)


def trims(samples: DataFrame, rate: int, target: float, group: str = "set_id") -> DataFrame:
    """``group, slot, gain``: what brings each clip's loudness to the target; ``samples`` in blocks."""
    told = levels.told(samples, [group, "slot"], rate, levels.block_size(rate, RELEASE))
    return told.select(group, "slot", target_gain(F.col("lufs"), target).alias("gain"))


def pieces(clips: DataFrame, audio: DataFrame, rate: int, target: float | None = DEFAULT.target_lufs, options: dict[str, dict] | None = None, build_bars: int = 0, group: str = "set_id") -> DataFrame:
    """``group, n, at, gain, x``: all that sounds in each set of ``n`` samples, before the master; what overlaps adds up.

    ``clips`` from ``placed``. A clip is trimmed to ``target`` (None leaves it), the
    first one fades in. In a join each side is treated by the name of what comes and
    takes the place of its clip's own sound; ``build_bars``: a high-pass climbs over so
    many last bars of what leaves. Clips are written to the shared folder; their
    samples are read twice, for the trim and for the mix, and never written.
    """
    keys, size = [group, "slot"], levels.block_size(rate, RELEASE)
    clips = kept(clips)
    ready = clips.join(trims(taken(clips, audio, rate, group), rate, target, group), keys) if target is not None else clips.withColumn("gain", F.lit(1.0))
    w, every = Window.partitionBy(group).orderBy("slot"), Window.partitionBy(group)
    # Slots may have gaps where a track had nothing to cut.
    later = lambda x: F.lead(x).over(w)
    at = ready.select(
        *keys, "track_id", F.col("n").cast("long").alias("end"), "rate", (F.col("cut_start") * rate).alias("cut"), "first", "head", "keep", "gain", (F.row_number().over(w) == 1).alias("opens"), F.max(F.col("first") + F.col("n")).over(every).alias("whole"),
        F.struct(F.col("tempo").alias("bpm"), F.col("transition").alias("name")).alias("come"), F.struct(later("tempo").alias("bpm"), later("transition").alias("name")).alias("gone"),
    )
    span = lambda side, low, high: F.struct(F.lit(side).alias("side"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    own = F.when(F.col("head") < F.col("keep"), F.sequence(F.col("head").cast("long"), F.col("keep").cast("long") - 1, F.lit(size).cast("long")))
    own = F.transform(F.coalesce(own, F.array().cast("array<long>")), lambda a: span("own", a, F.least(a + size, F.col("keep"))))
    sides = F.array(span("come", F.lit(0), F.col("head")), span("gone", F.col("keep"), F.col("end")))
    spans = at.withColumn("s", F.explode(F.concat(own, sides))).filter("s.low < s.high")
    join = F.when(F.col("s.side") == "gone", F.col("gone")).otherwise(F.col("come"))
    spans = spans.select(*keys, "track_id", "rate", "cut", "first", "keep", "gain", "opens", "whole", "s.side", "s.low", "s.high", join["bpm"].alias("bpm"), join["name"].alias("name"))

    def sound(row, x):
        if row.side == "own":
            up, i = min(int(FADE_SECONDS * rate), row.keep), np.arange(row.low, row.high)
            if row.opens and up > 1:
                x = x * np.where(i < up, np.sin(np.pi / 2 * i / (up - 1)), 1.0)
            return x, row.first + row.low, row.gain
        x, rest = row.gain * x, np.zeros(len(x))
        gone, come = (transitions.built(x, rate, row.bpm, build_bars), rest) if row.side == "gone" else (rest, x)
        gone, come = transitions.treat(row.name, gone, come, rate, row.bpm, options)
        return gone + come, row.first + row.low, 1.0

    made = heard(spans, audio, {"x": "array<double>", "at": "long", "gain": "double"}, sound, ("first", "keep", "opens", "side", "bpm", "name"))
    return made.select(group, F.col("whole").alias("n"), "at", "gain", "x")


def mixed_blocks(clips: DataFrame, audio: DataFrame, rate: int, target: float | None = DEFAULT.target_lufs, options: dict[str, dict] | None = None, build_bars: int = 0, group: str = "set_id") -> DataFrame:
    """``group, block, x``: the sum of ``pieces``."""
    return blocks.assembled(pieces(clips, audio, rate, target, options, build_bars, group), [group], levels.block_size(rate, RELEASE))


def mixed(clips: DataFrame, audio: DataFrame, rate: int, target: float | None = DEFAULT.target_lufs, options: dict[str, dict] | None = None, build_bars: int = 0, group: str = "set_id") -> DataFrame:
    """``group, i, v`` of ``mixed_blocks``."""
    return blocks.unblocked(mixed_blocks(clips, audio, rate, target, options, build_bars, group), [group], levels.block_size(rate, RELEASE))


def mastered(mix: DataFrame, rate: int, target: float = DEFAULT.target_lufs, ceiling_db: float = DEFAULT.ceiling_db, group: str = "set_id") -> tuple[DataFrame, DataFrame]:
    """(samples, report) of the sets, as ``levels.mastered`` has them; ``mix`` long, in blocks, or the ``pieces`` of it, which then move once."""
    size = levels.block_size(rate, RELEASE)
    if "at" in mix.columns:
        rows = blocks.gathered(mix, [group], size, *levels.borders(rate, RELEASE))
    else:
        rows = mix if "block" in mix.columns else blocks.blocked(mix, [group], size)
    done, report = levels.mastered_blocks(rows, [group], rate, size, target, ceiling_db, RELEASE)
    return blocks.unblocked(done, [group], size), report
