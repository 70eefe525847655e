"""Samples in arrays: a row is a block of a clip, and a task works through its rows one after the other.

A block (``keys, block, x``) holds ``size`` samples, the last one of a clip what is
left; NaN in it is no sample. A piece (``keys, n, at, gain, x``) is sound on its way
to the blocks of a clip of ``n`` samples. Only blocks and pieces move, so a sample
costs its eight bytes a step, and no group of rows is a clip.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


#: Bytes of a batch of rows that goes to Python, about.
BATCH_BYTES = 8 << 20


class Near(NamedTuple):
    """Blocks with their borders, before they are put together: ``opened`` gives (x, before, after) of a row, from the columns ``drop``; before the first block there is nothing, and before others as much as was asked for.

    ``rows`` lie where their block belongs, so what else it needs joins them there
    and no sound moves.
    """

    rows: DataFrame
    opened: Callable
    drop: tuple[str, ...]


def nothing() -> Column:
    return F.array().cast("array<double>")


def by_row(df: DataFrame, out: dict[str, str], make: Callable, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop``, with the columns ``out`` (their types) that ``make`` gives for a row, a tuple of it; a row of the batch at a time."""
    kept = [x for x in df.columns if x not in out and x not in drop]
    kinds = {x: F.lit(None).cast(kind).alias(x) for x, kind in out.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [make(row) for row in batch.itertuples(index=False)]
            told = batch[kept].copy()
            for j, x in enumerate(out):
                told[x] = [m[j] for m in made]
            yield told

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInPandas(run, df.select(*kept, *kinds.values()).schema)


def blocked(samples: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Blocks of long samples ``keys, i, v``; nulls are silence."""
    at = F.struct((F.col("i") % size).cast("int").alias("i"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    rows = samples.groupBy(*keys, F.expr(f"cast(i div {size} as long)").alias("block")).agg(F.collect_list(at).alias("z")).select(*keys, "block", F.col("z.i").alias("_i"), F.col("z.v").alias("_v"))

    def filled(row):
        x = np.full(row[-2].max() + 1, np.nan)
        x[row[-2]] = row[-1]
        return (x,)

    return by_row(rows, {"x": "array<double>"}, filled, ("_i", "_v"))


def unblocked(blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    rows = blocks.select(*keys, "block", F.posexplode("x").alias("_i", "v")).filter(~F.isnan("v"))
    return rows.select(*keys, (F.col("block") * size + F.col("_i")).alias("i"), "v")


def gathered(pieces: DataFrame, keys: list[str], size: int, back: int = 0, ahead: int = 0) -> Near:
    """The sum of each clip's pieces in blocks, dense, with the ``back`` samples before each and the ``ahead`` after it. What no piece covers is silence, but a block without any piece is not made."""
    end = "at + greatest(size(x), 1) - 1"
    met = F.sequence(F.expr(f"greatest(0, at - {ahead}) div {size}"), F.expr(f"least(n - 1, {end} + {back}) div {size}"))
    whole = pieces.withColumn("block", F.explode(met)).withColumn("_own", F.expr(f"block between at div {size} and ({end}) div {size}"))
    start = F.greatest(F.lit(0), F.col("block") * size - back)
    cut = whole.withColumns({"_start": start, "_lo": F.greatest(F.lit(0), start - F.col("at"))})
    room = F.greatest(F.lit(0), (F.col("block") + 1) * size + ahead - F.col("at") - F.col("_lo"))
    part = F.struct((F.col("at") + F.col("_lo") - F.col("_start")).alias("at"), "gain", F.slice("x", F.col("_lo").cast("int") + 1, room.cast("int")).alias("x"))
    rows = cut.groupBy(*keys, "block").agg(F.max("n").alias("n"), F.max("_own").alias("_own"), F.collect_list(part).alias("z")).filter("_own")
    rows = rows.select(*keys, "block", "n", F.col("z.at").alias("z_at"), F.col("z.gain").alias("z_gain"), F.transform("z", lambda p: F.size(p["x"])).alias("z_m"), F.flatten("z.x").alias("z_x"))

    def opened(row):
        own = row.block * size
        start = max(0, own - back)
        v, o = np.zeros(min(row.n, own + size + ahead) - start), 0
        for a, g, k in zip(row.z_at, row.z_gain, row.z_m, strict=True):
            v[a : a + k] += g * row.z_x[o : o + k]
            o += k
        before = np.concatenate([np.zeros(max(0, back - own) if own else 0), v[: own - start]])
        return v[own - start : own - start + size], before, v[own - start + size :]

    return Near(rows, opened, ("n", "z_at", "z_gain", "z_m", "z_x"))


def assembled(pieces: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``keys, block, x`` of ``gathered``."""
    near = gathered(pieces, keys, size)
    return by_row(near.rows, {"x": "array<double>"}, lambda row, opened=near.opened: opened(row)[:1], near.drop)


def bordered(blocks: DataFrame, keys: list[str], size: int, back: int, ahead: int = 0) -> DataFrame:
    """Blocks with ``before`` and ``after``: the ``back`` samples before a block (as far as there are any; none for the first one) and the ``ahead`` after it."""
    rest = [x for x in blocks.columns if x not in (*keys, "block", "x")]
    part = lambda b, k, x: F.struct(b.alias("b"), F.lit(k).alias("k"), x.alias("x"), *[(F.col(y) if k == 1 else F.lit(None).cast(blocks.schema[y].dataType)).alias(y) for y in rest])
    own = part(F.col("block"), 1, F.col("x"))
    later = F.when(F.size("x") > size - back, part(F.col("block") + 1, 0, F.slice("x", size - back + 1, back)))
    sooner = F.when((F.col("block") > 0) & (F.lit(ahead) > 0), part(F.col("block") - 1, 2, F.slice("x", 1, max(1, ahead))))
    dealt = blocks.select(*keys, F.explode(F.array_compact(F.array(own, later, sooner))).alias("p")).select(*keys, F.col("p.b").alias("block"), "p")
    met = dealt.groupBy(*keys, "block").agg(F.collect_list("p").alias("z"))
    one = lambda k: F.get(F.filter("z", lambda p: p["k"] == k), F.lit(0))
    rows = met.withColumn("_own", one(1)).filter("_own is not null")
    return rows.select(*keys, "block", *[F.col(f"_own.{x}").alias(x) for x in rest], F.col("_own.x").alias("x"), F.coalesce(one(0)["x"], nothing()).alias("before"), F.coalesce(one(2)["x"], nothing()).alias("after"))


def led(row, back: int) -> np.ndarray:
    """What lies before a row's block, ``back`` samples; nothing before the first one. Holes are silence."""
    if row.block == 0:
        return np.zeros(0)
    x = np.zeros(back)
    x[: len(row.before)] = np.nan_to_num(row.before)
    return x


def as_near(rows: DataFrame, back: int) -> Near:
    """Rows that have ``x``, ``before`` of ``back`` samples and perhaps ``after``, as ``bordered`` gives them."""
    after = "after" in rows.columns
    return Near(rows, lambda row: (row.x, led(row, back), row.after if after else row.x[:0]), ("x", "before", "after") if after else ("x", "before"))


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first ``len(x)`` samples of ``x`` through the impulse response ``h``."""
    if len(x) <= 256:
        return np.convolve(x, h)[: len(x)]
    n = 1 << (len(x) + len(h)).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]


def binned(x: np.ndarray, first: int, hop: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(first bin, energies, samples that there are) of bins of ``hop`` samples, for ``x`` that begins at sample ``first``."""
    at = (first + np.arange(len(x))) // hop - first // hop
    there = ~np.isnan(x)
    return first // hop, np.bincount(at, np.where(there, x, 0.0) ** 2), np.bincount(at, there)


def added_up(first: np.ndarray, m: np.ndarray, values: np.ndarray, by: Callable = np.add) -> np.ndarray:
    """Bins of a whole clip from those of its blocks; two blocks may share one."""
    out, o = np.zeros(int((first + m).max(initial=0))), 0
    for f, k in zip(first, m, strict=True):
        out[f : f + k] = by(out[f : f + k], values[o : o + k])
        o += k
    return out


def gated(e: np.ndarray, n: np.ndarray, channels: np.ndarray, block: int, hop: int) -> tuple[float, int]:
    """(loudness, blocks that count) from bins of ``hop`` samples: full blocks above -70, then above their mean less 10."""
    per = block // hop
    if len(e) < per:
        return -math.inf, 0
    near = np.lib.stride_tricks.sliding_window_view
    p = near(e, per).sum(axis=1) / block
    p = p[(near(n, per).sum(axis=1) == block * near(channels, per).max(axis=1)) & (p > 0)]
    db = lambda v: -0.691 + 10 * np.log10(v)
    p = p[db(p) > -70]
    if len(p):
        p = p[db(p) > db(p.mean()) - 10]
    return (float(db(p.mean())), len(p)) if len(p) else (-math.inf, 0)
