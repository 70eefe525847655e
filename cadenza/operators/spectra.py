"""Short-time spectra and resampling, in blocks that take a border of their neighbours' samples along.

Samples are ``clip_id, i, v`` with ``i`` from 0; beyond a clip's ends, and where
``v`` is null or missing, there is silence. No task holds a whole clip.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators import blocks

#: Frames, or samples made, of a block.
FRAMES, MADE = 256, 1 << 14
#: Zero crossings of the resampling kernel on each side.
ZEROS = 32


def dealt(samples: DataFrame, low: Column, high: Column, size: int) -> DataFrame:
    """``block, clip_id, i, v``: each sample for every block of ``size`` results of which it has a part, from ``low`` to ``high``."""
    rows = samples.withColumns({"_low": F.greatest(F.lit(0), low).cast("long"), "_high": high.cast("long")}).filter("_low <= _high")
    blocks = F.explode(F.sequence(F.expr(f"_low div {size}"), F.expr(f"_high div {size}")))
    return rows.select(blocks.alias("block"), "clip_id", F.col("i").cast("long").alias("i"), F.coalesce(F.col("v"), F.lit(0.0)).cast("double").alias("v"))


def lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("clip_id").agg((F.max("i") + 1).alias("_n"))


def made(near: DataFrame, samples: DataFrame, least: Column, at: str, out: str, make) -> DataFrame:
    """``clip_id``, ``at`` (a long) and ``out``: ``make(block, i, v, n)`` of each row of ``near``'s blocks, ``n`` results of a clip being as many as ``least`` says of its ``_n`` samples.

    A clip's block is a row, so a task goes through many short clips at a time; no result beyond a clip's end is worked out.
    """
    rows = near.groupBy("block", "clip_id").agg(F.collect_list(F.struct("i", "v")).alias("z")).join(lengths(samples).select("clip_id", least.cast("long").alias("_made")), "clip_id")
    flat = rows.select("clip_id", "block", "_made", F.col("z.i").alias("i"), F.col("z.v").alias("v"))
    done = blocks.by_row(flat, {"_x": "array<double>", "_from": "long"}, lambda row: make(row.block, row.i, row.v, row[2]), ("block", "_made", "i", "v"))
    return done.select("clip_id", "_from", F.posexplode("_x").alias("_i", out)).select("clip_id", (F.col("_from") + F.col("_i")).alias(at), out)


def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def band_energy(samples: DataFrame, rate: float, hop: int = 512, size: int = 2048, low_hz: float = 0.0, high_hz: float = 150.0) -> DataFrame:
    """``clip_id, k, energy``: the sum of a frame's magnitudes from ``low_hz`` to ``high_hz``.

    Frame ``k`` has its middle at sample ``k * hop``, under a Hann window; a clip of n samples has 1 + n div hop of them.
    """
    half = size // 2
    hz = np.arange(size // 2 + 1) * rate / size
    bins = np.flatnonzero((hz >= low_hz) & (hz <= high_hz))
    window = hann(size)
    near = dealt(samples, F.ceil((F.col("i") - size + half + 1) / hop), F.floor((F.col("i") + half) / hop), FRAMES)

    def make(block, i, v, n):
        first, count = block * FRAMES * hop - half, max(0, min(FRAMES, n - block * FRAMES))
        x = np.zeros((FRAMES - 1) * hop + size)
        x[i - first] = v
        cut = np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:count]
        return np.abs(np.fft.rfft(cut * window, axis=1))[:, bins].sum(axis=1), block * FRAMES

    return made(near, samples, F.floor(F.col("_n") / hop) + 1, "k", "energy", make)


def at_beats(frames: DataFrame, beats: DataFrame, rate: float, hop: int, out: str = "low") -> DataFrame:
    """``beats`` (``clip_id, t``) with the energy of the frame nearest to each; a beat after the last frame has that one's."""
    last = frames.groupBy("clip_id").agg(F.max("k").alias("_last"))
    k = F.least(F.greatest(F.lit(0), F.round(F.col("t") * rate / hop)), F.col("_last")).cast("long")
    return beats.join(last, "clip_id").withColumn("k", k).join(frames.withColumnRenamed("energy", out), ["clip_id", "k"]).drop("k", "_last")


def kernel(x: np.ndarray, scale: float, half: int) -> np.ndarray:
    """A low-pass's sinc under a Blackman window of ``half`` samples on each side."""
    at = np.clip(x / half, -1, 1)
    return scale * np.sinc(scale * x) * (0.42 + 0.5 * np.cos(np.pi * at) + 0.08 * np.cos(2 * np.pi * at))


def resampled(samples: DataFrame, rate_in: float, rate_out: float, zeros: int = ZEROS) -> DataFrame:
    """``clip_id, i, v`` at another rate: what lies above half of the lower rate is taken out; n samples become ceil(n * rate_out / rate_in).

    A phase's weights add to 1, so a constant stays.
    """
    if rate_in == rate_out:
        return samples.select("clip_id", "i", "v")
    step, scale = rate_in / rate_out, min(1.0, rate_out / rate_in)
    half = math.ceil(zeros / scale)
    near = dealt(samples, F.ceil((F.col("i") - half) / step), F.floor((F.col("i") + half) / step), MADE)
    reach = np.arange(-half, half + 1)

    def make(block, i, v, n):
        first, count = math.floor(block * MADE * step) - half - 1, max(0, min(MADE, n - block * MADE))
        x = np.zeros(math.ceil(count * step) + 2 * half + 4)
        at = i - first
        inside = (at >= 0) & (at < len(x))
        x[at[inside]] = v[inside]
        out = np.empty(count)
        for a in range(0, count, 1024):
            place = (block * MADE + np.arange(a, min(a + 1024, count))) * step
            whole = np.floor(place).astype(np.int64)
            weights = kernel((place - whole)[:, None] - reach, scale, half)
            out[a : a + 1024] = (x[whole[:, None] - first + reach] * weights).sum(axis=1) / weights.sum(axis=1)
        return out, block * MADE

    return made(near, samples, F.ceil(F.col("_n") * rate_out / rate_in), "i", "v", make)
