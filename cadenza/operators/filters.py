"""Recursive filters over blocks of samples, with coefficients of their own for each block.

A block is one row (``keys, block, x``: an array of samples). A second-order filter
has two numbers of state, and a block maps the state it begins with to the one it
ends with by a 2x2 matrix and an offset. These maps compose, so the states at
which all blocks begin are a scan over small rows, in two levels; then every block
is filtered on its own. A task steps through the samples of many blocks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions.music import bind
from cadenza.operators.levels import one_pole
from cadenza.operators.sound import sweep_cutoff

#: Samples of a block; blocks of a clip whose maps meet in one row of the scan.
SIZE, FAN = 2048, 256


def blocked(samples: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """``keys, block, n, x``: samples ``i`` dense from 0 in arrays of ``size``; ``n`` is the clip's number of samples. Nulls are silence."""
    at = F.struct((F.col("i") % size).alias("i"), F.coalesce(F.col("v"), F.lit(0.0)).cast("double").alias("v"))
    rows = samples.groupBy(*keys, F.expr(f"i div {size}").alias("block")).agg(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["v"]).alias("x"))
    n = rows.groupBy(*keys).agg(F.sum(F.size("x")).alias("n"))
    return rows.join(n, keys).select(*keys, "block", "n", "x")


def unblocked(blocks: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    return blocks.select(*keys, "block", F.posexplode("x").alias("_i", "v")).select(*keys, (F.col("block") * size + F.col("_i")).alias("i"), "v")


def first_order(cutoff: Column, rate: float, kind: str) -> Column:
    """array(b0, b1, b2, a1, a2) of a one-pole low or high pass, by the bilinear transform."""

    def made(k):
        b = (k if kind == "low" else F.lit(1.0)) / (1 + k)
        return F.array(b, b if kind == "low" else -b, F.lit(0.0), (k - 1) / (k + 1), F.lit(0.0))

    return bind(F.tan(math.pi * cutoff / rate), made)


def second_order(cutoff: Column, rate: float, kind: str) -> Column:
    """The same of a Butterworth filter of second order."""

    def made(k):
        whole = 1 + math.sqrt(2) * k + k * k
        b = (k * k if kind == "low" else F.lit(1.0)) / whole
        return F.array(b, 2 * b if kind == "low" else -2 * b, b, 2 * (k * k - 1) / whole, (1 - math.sqrt(2) * k + k * k) / whole)

    return bind(F.tan(math.pi * cutoff / rate), made)


def stepped(x: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filtered, end states) of blocks of equal length, from states ``s``; transposed direct form II."""
    b0, b1, b2, a1, a2 = c.T
    s1, s2 = s[:, 0].copy(), s[:, 1].copy()
    y = np.empty_like(x)
    for t in range(x.shape[1]):
        v = x[:, t]
        w = b0 * v + s1
        s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
        y[:, t] = w
    return y, np.column_stack([s1, s2])


def by_length(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, samples, coefficients) of blocks of equal length."""
    for _, rows in batch.groupby(batch["x"].map(len), sort=False):
        yield rows, np.stack(rows["x"].to_numpy()).astype(np.float64), np.stack(rows["c"].to_numpy())


def from_rest(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block, x``: every block filtered by its coefficients ``c`` alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, x, c in by_length(batch):
                yield rows.assign(x=list(stepped(x, c, np.zeros((len(x), 2)))[0])).drop(columns="c")

    whole = blocks.select(*keys, "block", "x", "c")
    return whole.mapInPandas(run, whole.drop("c").schema)


def maps(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block, m``: (m11, m12, m21, m22, e1, e2), so that a block takes a state s to M s + e."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, x, c in by_length(batch):
                end = stepped(x, c, np.zeros((len(x), 2)))[1]
                step = np.zeros((len(x), 2, 2))
                step[:, 0, 0], step[:, 0, 1], step[:, 1, 0] = -c[:, 3], 1.0, -c[:, 4]
                power = np.linalg.matrix_power(step, x.shape[1])
                yield rows.assign(m=list(np.column_stack([power.reshape(-1, 4), end]))).drop(columns=["x", "c"])

    whole = blocks.select(*keys, "block", "x", "c")
    return whole.mapInPandas(run, whole.select(*keys, "block", F.array().cast("array<double>").alias("m")).schema)


def run_through(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The states before each of ``steps`` (a map each), and the one after the last."""
    out = [start]
    for m in steps:
        out.append(m[:4].reshape(2, 2) @ out[-1] + m[4:])
    return np.array(out)


def whole_map(steps: np.ndarray) -> np.ndarray:
    """All of ``steps`` as one map: where it takes rest and the unit states."""
    e, p, q = (run_through(steps, np.array(s, dtype=np.float64))[-1] for s in ((0, 0), (1, 0), (0, 1)))
    return np.concatenate([np.column_stack([p - e, q - e]).ravel(), e])


def states(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block, s``: the state at which each block begins. A row holds ``FAN`` maps, or one map for each ``FAN`` blocks of a clip."""
    listed = lambda df, at, by: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "m"))).alias("z")).select(*by, F.transform("z", lambda x: x["at"]).alias("at"), F.transform("z", lambda x: x["m"]).alias("m"))
    grouped = listed(steps.withColumn("_far", F.expr(f"block div {FAN}")), "block", [*keys, "_far"])

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(m=[whole_map(np.stack(m)) for m in batch["m"]])

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = batch["s"] if "s" in batch else [np.zeros(2)] * len(batch)
            yield batch.assign(s=[run_through(np.stack(m), np.asarray(s))[:-1].tolist() for m, s in zip(batch["m"], start, strict=True)]).drop(columns="m")

    def told(df: DataFrame, by: list[str], at: str) -> DataFrame:
        kind = df.select(*by, "at", F.array().cast("array<array<double>>").alias("s")).schema
        rows = df.mapInPandas(begun, kind)
        return rows.select(*by, F.explode(F.arrays_zip("at", "s")).alias("z")).select(*by, F.col("z.at").alias(at), F.col("z.s").alias("s"))

    one = grouped.select(*keys, "_far", F.array().cast("array<double>").alias("m")).schema
    far = told(listed(grouped.select(*keys, "_far", "m").mapInPandas(folded, one), "_far", keys), keys, "_far")
    return told(grouped.join(far, [*keys, "_far"]).select(*keys, "at", "m", "s"), keys, "block")


def carried(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block, x``: the filter runs through a clip's blocks, each with its coefficients ``c``, from the state that the last one left."""
    began = blocks.join(states(maps(blocks, keys), keys), [*keys, "block"]).select(*keys, "block", "x", "c", "s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, x, c in by_length(batch):
                yield rows.assign(x=list(stepped(x, c, np.stack(rows["s"].to_numpy()))[0])).drop(columns=["c", "s"])

    return began.mapInPandas(run, began.drop("c", "s").schema)


def passed(samples: DataFrame, keys: list[str], cutoff: float, rate: float, kind: str, design=first_order) -> DataFrame:
    """``keys, i, v`` through one filter of a fixed corner."""
    blocks = blocked(samples, keys).withColumn("c", design(F.lit(float(cutoff)), rate, kind))
    return unblocked(carried(blocks, keys), keys)


def moving(samples: DataFrame, keys: list[str], rate: float, start_hz: float, end_hz: float, kind: str = "high", design=second_order, size: int = SIZE, low: float = 25.0, share: float = 0.95, carry: bool = False) -> DataFrame:
    """``keys, i, v`` through a filter whose corner glides from block to block, geometrically.

    Each block starts from rest, as the results to match have it; with ``carry`` the state runs on.
    """
    blocks = blocked(samples, keys, size)
    corner = sweep_cutoff(F.col("block") * size, F.col("n"), rate, start_hz, end_hz, size, low, share)
    ready = blocks.withColumn("c", design(corner, rate, kind))
    return unblocked((carried if carry else from_rest)(ready, keys), keys, size)


def echoed(samples: DataFrame, keys: list[str], delay: Column, feedback: float, mix: float) -> DataFrame:
    """``keys, i, v`` with a feedback delay: w(i) = x(i - d) + feedback * w(i - d), and (1 - mix) * x + mix * w.

    Samples that lie whole delays apart form chains of their own, so the loop is a
    running sum along each chain, in blocks. ``delay``: whole samples, at least 1; it is one for each key.
    """
    d = F.greatest(F.lit(1), delay.cast("long"))
    chained = samples.withColumn("_d", d).withColumns({"_chain": F.struct(*keys, (F.col("i") % F.col("_d")).alias("r")), "_k": F.expr("i div _d")})
    heard = one_pole(chained, "v", feedback, "_w", "_chain", "_k").withColumn("_w", F.col("_w") / (1 - feedback)) if feedback > 0 else chained.withColumn("_w", F.col("v"))
    late = heard.select("_chain", (F.col("_k") + 1).alias("_k"), F.col("_w").alias("_late"))
    return chained.join(late, ["_chain", "_k"], "left").select(*keys, "i", ((1 - mix) * F.col("v") + mix * F.coalesce("_late", F.lit(0.0))).alias("v"))


def filter_build(samples: DataFrame, keys: list[str], rate: float, bpm: Column, bars: int = 8, top_hz: float = 1800.0) -> DataFrame:
    """``keys, i, v`` with a high-pass that climbs over the last ``bars``; what comes before them stays. ``bpm`` is one for each key."""
    if bars <= 0:
        return samples.select(*keys, "i", "v")
    tail = F.floor(bars * 240.0 / F.greatest(bpm, F.lit(1e-6)) * rate)
    n = samples.groupBy(*keys).agg((F.max("i") + 1).alias("_n"), F.max(tail).alias("_tail"))
    told = samples.join(n, keys).withColumn("_from", F.greatest(F.lit(0), F.col("_n") - F.col("_tail")))
    kept = told.filter(F.col("i") < F.col("_from")).select(*keys, "i", "v")
    built = moving(told.filter(F.col("i") >= F.col("_from")).select(*keys, (F.col("i") - F.col("_from")).alias("i"), "v"), keys, rate, 30.0, top_hz, "high")
    starts = n.select(*keys, F.greatest(F.lit(0), F.col("_n") - F.col("_tail")).alias("_from"))
    return kept.unionByName(built.join(starts, keys).select(*keys, (F.col("i") + F.col("_from")).alias("i"), "v"))
