"""Smoothing, limiting, the level ride, fades and K-weighting over long tables of samples (``clip_id, i, v``)."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.functions.music import gain_db
from cadenza.operators import blocks
from cadenza.operators.sound import target_gain

#: What is left of a sample's weight where the one-pole filter forgets it.
FORGOTTEN = 1e-15


def one_pole(df: DataFrame, x: str, alpha: float, out: str = "smooth", group: str = "clip_id", i: str = "i") -> DataFrame:
    """``out_i = (1 - alpha) * x_i + alpha * out_(i-1)``, from zero; ``i`` is dense from 0.

    The recursion runs in blocks: inside one it is a running sum with powers
    of ``alpha``, between them a fold over the blocks that still count. No task
    holds more than a block, or one row for each block of a clip.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    size = max(1, min(4096, int(math.log(1e3) / -math.log(alpha))))
    reach = max(1, math.ceil(math.log(FORGOTTEN) / (size * math.log(alpha))))
    at = F.col(i) % size
    w = Window.partitionBy(group, "_block").orderBy(i)
    own = df.withColumn("_block", F.expr(f"`{i}` div {size}")).withColumn("_own", (1 - alpha) * F.pow(F.lit(alpha), at) * F.sum(F.col(x) * F.pow(F.lit(alpha), -at)).over(w))
    ends = own.groupBy(group, "_block").agg(F.max_by("_own", i).alias("_end"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(-reach, -1)
    carried = ends.select(group, "_block", F.aggregate(F.collect_list("_end").over(before), F.lit(0.0), lambda s, e: s * alpha**size + e).alias("_carry"))
    return own.join(carried, [group, "_block"]).withColumn(out, F.col("_own") + F.col("_carry") * F.pow(F.lit(alpha), at + 1)).drop("_block", "_own", "_carry")


def nearby_least(samples: DataFrame, x: str, look: int, out: str, size: int = 1 << 14) -> DataFrame:
    """The least ``x`` within ``look`` samples of each; a block of samples and a border of its neighbours' meet in a task."""
    size = max(size, 2 * look)
    block = F.expr(f"i div {size}")
    dealt = F.array_compact(F.array(block, F.when(F.col("i") % size < look, block - 1), F.when(F.col("i") % size >= size - look, block + 1)))
    w = Window.partitionBy("clip_id", "_b").orderBy("i").rowsBetween(-look, look)
    near = samples.withColumn("_b", F.explode(dealt)).withColumn(out, F.min(x).over(w))
    return near.filter(F.col("_b") == block).drop("_b")


def limit(samples: DataFrame, ceiling: float, look: int, alpha: float) -> DataFrame:
    """Peaks held below ``ceiling``: least gain within ``look`` samples, smoothed, never above what the sample needs. ``i`` is dense from 0."""
    need = samples.withColumn("_need", F.coalesce(F.least(F.lit(1.0), ceiling / F.nullif(F.abs("v"), F.lit(0.0))), F.lit(1.0)))
    smooth = one_pole(nearby_least(need, "_need", look, "_g"), "_g", alpha, "_s")
    v = F.col("v") * F.least("_s", "_need")
    return smooth.select("clip_id", "i", F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), v)).alias("v"))


def smoothed(curve: DataFrame, x: str, size: int, out: str, group: str = "clip_id", k: str = "k") -> DataFrame:
    """Moving mean of ``size`` points; beyond an end its value repeats. ``k`` is dense from 0."""
    back, ahead = size // 2, size - size // 2 - 1
    whole = Window.partitionBy(group).orderBy(k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = curve.withColumn("_first", F.first(x).over(whole)).withColumn("_last", F.last(x).over(whole)).withColumn("_top", F.max(k).over(whole))
    inside = F.sum(x).over(Window.partitionBy(group).orderBy(k).rowsBetween(-back, ahead))
    left, right = F.greatest(F.lit(0), back - F.col(k)), F.greatest(F.lit(0), F.col(k) + ahead - F.col("_top"))
    return c.withColumn(out, (inside + left * F.col("_first") + right * F.col("_last")) / size).drop("_first", "_last", "_top")


def level_ride(samples: DataFrame, target: float, window: int, hop: int, smooth: int, tolerance: float = 1.5, cut: float = 8.0, boost: float = 3.0) -> DataFrame:
    """Samples with short-term loudness brought to within ``tolerance`` of ``target``.

    Loudness of full windows is a sum over bins of ``hop`` samples; what strays is
    corrected (at most ``cut`` down, ``boost`` up), smoothed over ``smooth`` windows
    and read between their centres. A clip below two windows stays as it is.
    """
    if window % hop:
        raise ValueError("a window is a whole number of hops")
    bins = samples.groupBy("clip_id", F.expr(f"i div {hop}").alias("k")).agg(F.sum(F.col("v") * F.col("v")).alias("e"), F.count(F.lit(1)).alias("n"), F.max("i").alias("end"))
    ahead = Window.partitionBy("clip_id").orderBy("k").rowsBetween(0, window // hop - 1)
    length = F.max("end").over(Window.partitionBy("clip_id")) + 1
    power = bins.select("clip_id", "k", (F.sum("e").over(ahead) / window).alias("p"), F.sum("n").over(ahead).alias("n"), length.alias("length")).filter((F.col("n") == window) & (F.col("length") >= 2 * window))
    away = F.when(F.col("p") > 0, -0.691 + 10 * F.log10("p") - target).otherwise(0.0)
    fix = F.when(away > tolerance, tolerance - away).when(away < -tolerance, -tolerance - away).otherwise(0.0)
    curve = smoothed(power.withColumn("c", F.greatest(F.lit(-cut), F.least(F.lit(boost), fix))), "c", smooth, "c0")
    by_clip = Window.partitionBy("clip_id")
    curve = curve.select("clip_id", "k", "c0", F.coalesce(F.lead("c0").over(by_clip.orderBy("k")), F.col("c0")).alias("c1"))
    top = curve.groupBy("clip_id").agg(F.max("k").alias("top"))
    x = F.greatest(F.lit(0.0), F.least(F.col("top").cast("double"), (F.col("i") - window / 2) / hop))
    placed = samples.join(top, "clip_id", "left").withColumn("_x", F.when(F.col("top").isNotNull(), x)).withColumn("k", F.floor("_x"))
    db = F.col("c0") + (F.col("_x") - F.col("k")) * (F.col("c1") - F.col("c0"))
    return placed.join(curve, ["clip_id", "k"], "left").select("clip_id", "i", (F.col("v") * F.coalesce(F.pow(F.lit(10.0), db / 20), F.lit(1.0))).alias("v"))


def fade(i: Column, length: Column, fade_in: int, fade_out: int) -> Column:
    """The equal-power gain of sample ``i`` of ``length``; a fade is at most the clip, one of a sample or less is none."""
    quarter = lambda at, n: F.sin(F.lit(math.pi / 2) * at / F.nullif(n - 1, F.lit(0)))
    n, m = F.least(F.lit(fade_in), length), F.least(F.lit(fade_out), length)
    up = F.when((n > 1) & (i < n), quarter(i, n)).otherwise(1.0)
    down = F.when((m > 1) & (length - 1 - i < m), quarter(length - 1 - i, m)).otherwise(1.0)
    return up * down


#: Fixed values of K-weighting (after ITU-R BS.1770): a high shelf of the cookbook's form, so with
#: its middle at SHELF_HZ, then a high-pass.
SHELF_HZ, SHELF_Q, SHELF_DB = 1681.974450955533, 0.7071752369554196, 3.999843853973347
HIGH_PASS_HZ, HIGH_PASS_Q = 38.13547087602444, 0.5003270373238773
#: Samples of a block of ``k_weight``; what the filters remember below this share of a peak is left out.
BLOCK, FAINT = 1 << 15, 1e-13


def biquad(above: tuple, below: tuple, hz: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital coefficients of the analogue filter ``above / below`` (powers of s, highest first), by the bilinear transform."""
    k = math.tan(math.pi * hz / rate)
    b, a = (np.array([p * 1.0 + q * k + r * k * k, 2 * (r * k * k - p), p - q * k + r * k * k]) for p, q, r in (above, below))
    return b / a[0], a / a[0]


def k_response(rate: float) -> np.ndarray:
    """The impulse response of both K-weighting filters, up to where it is faint."""
    g = 10 ** (SHELF_DB / 40)
    slope = math.sqrt(g) / SHELF_Q
    stages = (
        biquad((g * g, g * slope, g), (1.0, slope, g), SHELF_HZ, rate),
        biquad((1.0, 0.0, 0.0), (1.0, 1 / HIGH_PASS_Q, 1.0), HIGH_PASS_HZ, rate),
    )
    x = np.zeros(max(64, math.ceil(7 * rate / HIGH_PASS_HZ)))
    x[0] = 1.0
    for b, a in stages:
        y = np.convolve(x, b)[: len(x)]
        p = q = 0.0
        for i, v in enumerate(y.tolist()):
            p, q = v - a[1] * p - a[2] * q, p
            y[i] = p
        x = y
    return x[: int(np.flatnonzero(np.abs(x) > FAINT)[-1]) + 1]


def k_weight(samples: DataFrame, rate: float, group: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """K-weighted samples of each ``group`` (a clip, or a clip's channel).

    Blocks are filtered apart, each with the samples before it that the filters
    still remember; so no task holds a whole clip. Missing samples and nulls are silence.
    """
    h = k_response(rate)
    size, keys = max(BLOCK, len(h)), list(group)
    near = blocks.bordered(blocks.blocked(samples, keys, size), keys, size, len(h))
    heard = blocks.by_row(near, {"x": "array<double>"}, lambda row: (weighted(row.x, blocks.led(row, len(h)), h),), ("before", "after"))
    return blocks.unblocked(heard, keys, size).select(*keys, "i", "v")


def weighted(x: np.ndarray, before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A block through the filters, after what lies before it; where it has no sample it still has none."""
    y = blocks.convolved(np.concatenate([before, np.nan_to_num(x)]), h)[len(before) :]
    return np.where(np.isnan(x), np.nan, y)


def block_size(rate: float, release: float = 0.0) -> int:
    """Samples of a block: enough for all that a block takes along of the one before."""
    return max(BLOCK, borders(rate, release)[0])


def reach(rate: float, release: float) -> int:
    """How far back the limiter looks: its smoothing, until that has forgotten, and its window."""
    return math.ceil(-math.log(FORGOTTEN) * max(1.0, release * rate)) + max(1, int(rate) // 200)


def borders(rate: float, release: float) -> tuple[int, int]:
    """(samples before a block, samples after it) that its master needs: the limiter's, and before them what K-weighting of the limited block remembers."""
    return reach(rate, release) + len(k_response(rate)), max(1, int(rate) // 200)


def told(rows: DataFrame | blocks.Near, keys: list[str], rate: int, size: int, hop: int | None = None) -> DataFrame:
    """``keys, lufs, blocks`` of blocks (with ``ch``, the channels' powers add up), and their largest ``peak``, ``unlimited`` and ``ride``.

    With ``hop`` also ``energies`` and ``counts``, bins of so many samples as they
    are. A clip's bins, ten and four a second, meet in one row. Blocks that come with
    what lies before them (``before``, or ``Near``) do not move, and where they tell
    the clip's length ``n`` a clip of one block is told there.
    """
    h, per = k_response(rate), rate // 10
    if isinstance(rows, DataFrame):
        if "before" not in rows.columns:
            own = [*keys, "ch"] if "ch" in rows.columns else keys
            rows = blocks.bordered(rows, own, size, len(h))
        rows = blocks.as_near(rows, len(h))
    near, opened, drop = rows
    more, sized = [x for x in ("unlimited", "ride") if x in near.columns], "n" in near.columns

    def measured(row):
        x, before, _ = opened(row)
        at = row.block * size
        first, e, n = blocks.binned(weighted(x, before[-len(h) :], h), at, per)
        ride = blocks.binned(x, at, hop) if hop else (0, [], [])
        there = x[~np.isnan(x)]
        lufs, many = 0.0, -1
        if sized and row.n <= size:
            lufs, many = blocks.gated(e, n, (n > 0) * 1.0, 4 * per, per)
            e = n = e[:0]
        return first, e, n, *ride, np.abs(there).max(initial=0.0), lufs, many

    kinds = {"first": "long", "e": "array<double>", "n": "array<double>", "first_": "long", "e_": "array<double>", "n_": "array<double>", "peak": "double", "own": "double", "own_blocks": "long"}
    bins = blocks.by_row(near, kinds, measured, drop).withColumn("c", (F.col("ch") + 1).cast("double") if "ch" in near.columns else F.lit(1.0))
    listed = lambda f, e, n: F.collect_list(F.struct(F.col(f).alias("f"), F.col(e).alias("e"), F.col(n).alias("n"), F.transform(n, lambda k: F.when(k > 0, F.col("c")).otherwise(0.0)).alias("c")))
    met = bins.groupBy(*keys).agg(listed("first", "e", "n").alias("z"), listed("first_", "e_", "n_").alias("y"), *[F.max(x).alias(x) for x in ("peak", "own", "own_blocks", *more)])
    flat = lambda z: [F.col(f"{z}.f").alias(f"{z}f"), F.transform(z, lambda p: F.size(p["e"])).alias(f"{z}m"), *[F.flatten(f"{z}.{x}").alias(f"{z}{x}") for x in "enc"]]
    met = met.select(*keys, "peak", "own", "own_blocks", *more, *flat("z"), *flat("y"))

    def added(row):
        e, n, c = blocks.added_up(row.zf, row.zm, row.ze), blocks.added_up(row.zf, row.zm, row.zn), blocks.added_up(row.zf, row.zm, row.zc, np.maximum)
        loud = (row.own, row.own_blocks) if row.own_blocks >= 0 else blocks.gated(e, n, c, 4 * per, per)
        return *loud, blocks.added_up(row.yf, row.ym, row.ye), blocks.added_up(row.yf, row.ym, row.yn)

    out = blocks.by_row(met, {"lufs": "double", "blocks": "long", "energies": "array<double>", "counts": "array<double>"}, added, ("own", "own_blocks", *(f"{z}{x}" for z in "zy" for x in "fmenc")))
    return out.withColumn("lufs", F.when(F.abs("lufs") < float("inf"), F.round("lufs", 6)).otherwise(F.col("lufs")))


def loudness(samples: DataFrame, rate: int) -> DataFrame:
    """Gated loudness of K-weighted clips: blocks of 400 ms, a new one each 100 ms; a column ``ch`` tells channels apart."""
    size = block_size(rate)
    rows = blocks.blocked(samples, ["clip_id", "ch"] if "ch" in samples.columns else ["clip_id"], size)
    return told(rows, ["clip_id"], rate, size).select("clip_id", "lufs", "blocks")


def ride_curve(e: np.ndarray, n: np.ndarray, gain: float, target: float, window: int, hop: int, smooth: int, tolerance: float = 1.5, cut: float = 8.0, boost: float = 3.0) -> np.ndarray:
    """``level_ride``'s corrections in decibels, from a clip's bins; none below two windows."""
    per = window // hop
    if n.sum() < 2 * window:
        return np.zeros(0)
    near = np.lib.stride_tricks.sliding_window_view
    full = near(n, per).sum(axis=1) == window
    p = near(e, per).sum(axis=1) * gain * gain / window
    away = np.where(p > 0, -0.691 + 10 * np.log10(np.where(p > 0, p, 1.0)) - target, 0.0)
    fix = np.where(away > tolerance, tolerance - away, np.where(away < -tolerance, -tolerance - away, 0.0))
    c = np.where(full, np.clip(fix, -cut, boost), 0.0)[: int(np.flatnonzero(full).max(initial=-1)) + 1]
    if not len(c):
        return c
    return near(np.pad(c, (smooth // 2, smooth - smooth // 2 - 1), "edge"), smooth).sum(axis=1) / smooth


def limited(v: np.ndarray, own: slice, ceiling: float, look: int, alpha: float) -> np.ndarray:
    """``limit`` of an array with its borders: the samples ``own`` of it."""
    size = np.abs(v)
    need = np.where(size > ceiling, ceiling / np.where(size > 0, size, 1.0), 1.0)
    least = np.lib.stride_tricks.sliding_window_view(np.pad(need, look, constant_values=1.0), 2 * look + 1).min(axis=1)
    smooth = np.fromiter(accumulate(((1 - alpha) * least[: own.stop]).tolist(), lambda s, x: alpha * s + x), dtype=np.float64, count=own.stop)
    return np.clip(v[own] * np.minimum(smooth[own], need[own]), -ceiling, ceiling)


def mastered_blocks(rows: DataFrame | blocks.Near, keys: list[str], rate: int, size: int, target: float, ceiling_db: float, release: float = 0.12, ride: bool = True) -> tuple[DataFrame, DataFrame]:
    """``mastered`` of blocks, which come out as blocks. Blocks move once: what is told of a clip joins them where they lie."""
    hop, look, alpha, ceiling = max(1, rate // 4), max(1, rate // 200), math.exp(-1 / max(1.0, release * rate)), 10 ** (ceiling_db / 20)
    window, (back, ahead), heard = 8 * hop, borders(rate, release), len(k_response(rate))
    if isinstance(rows, DataFrame):
        rows = blocks.as_near(blocks.bordered(rows.select(*keys, "block", "x"), keys, size, back, ahead), back)
    near, opened, drop = rows
    # A join leaves rows without a key out; left out here, both uses ask for the same rows, which then move once.
    near = near.filter(" and ".join(f"`{x}` is not null" for x in (*keys, "block")))
    rows = blocks.Near(near, opened, drop)
    before = told(rows, keys, rate, size, hop).withColumn("gain", target_gain(F.col("lufs"), target))

    def ridden(row):
        curve = ride_curve(row.energies, row.counts, row.gain, target, window, hop, 5) if ride else np.zeros(0)
        return curve, max(0, len(row.energies) * hop - 1) // size

    # Each block gets the part of the curve that it meets.
    curve = blocks.by_row(before, {"curve": "array<double>", "last": "long"}, ridden, ("energies", "counts", "peak", "lufs", "blocks"))
    each = curve.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    at = lambda i: F.floor((i - window / 2) / hop).cast("long")
    each = each.withColumn("begin", F.greatest(F.lit(0), F.least(F.size("curve") - 1, at(F.col("block") * size - back) - 1)))
    each = each.select(*keys, "block", "gain", "begin", F.slice("curve", F.col("begin").cast("int") + 1, F.greatest(F.lit(1), at((F.col("block") + 1) * size + ahead) + 3 - F.col("begin")).cast("int")).alias("curve"))

    def run(row):
        x, led, after = opened(row)
        v = np.concatenate([led, np.nan_to_num(x), np.nan_to_num(after)]) * row.gain
        own = slice(len(led), len(led) + len(x))
        db = np.zeros(len(v))
        if len(row.curve):
            i = row.block * size - len(led) + np.arange(len(v))
            db = np.interp((i - window / 2) / hop, row.begin + np.arange(len(row.curve)), row.curve)
            v = v * 10.0 ** (db / 20)
        sounds, holes = v[own] != 0, np.isnan(x)
        # What lies before is limited too: the loudness of the result needs it.
        done = limited(v, slice(max(0, len(led) - heard), own.stop), ceiling, look, alpha)
        before, done = done[: len(done) - len(x)], done[len(done) - len(x) :]
        return np.where(holes, np.nan, done), before, np.abs(v[own]).max(initial=0.0), np.abs(db[own][sounds]).max(initial=0.0)

    done = blocks.by_row(near.join(each, [*keys, "block"]), {"x": "array<double>", "before": "array<double>", "unlimited": "double", "ride": "double"}, run, (*[x for x in drop if x != "n"], "curve", "begin", "gain"))
    shown = lambda x: F.when(F.abs(x) < float("inf"), F.round(x, 2))
    after = told(done, keys, rate, size).select(*keys, F.col("lufs").alias("after"), gain_db(F.col("peak")).alias("peak_db"), gain_db(F.col("unlimited")).alias("unlimited"), "ride")
    report = before.select(*keys, "lufs", "gain").join(after, keys).select(
        *keys, shown(F.col("lufs")).alias("input_lufs"), F.round(gain_db(F.col("gain")), 2).alias("gain_db"), shown(F.col("after")).alias("output_lufs"), shown(F.col("peak_db")).alias("peak_db"),
        F.round(F.greatest(F.lit(0.0), F.coalesce(shown(F.col("unlimited")) - shown(F.col("peak_db")), F.lit(0.0))), 2).alias("limiter_db"), F.round("ride", 2).alias("ride_db"),
    )
    return done.select(*keys, "block", "x"), report


def mastered(samples: DataFrame, rate: int, target: float, ceiling_db: float, release: float = 0.12, ride: bool = True) -> tuple[DataFrame, DataFrame]:
    """(samples, report): clips at their target loudness, with levels ridden and peaks below the ceiling.

    The report has, by clip: loudness before and after, the gain, the peak, what
    the limiter took, and the ride's largest change; silent clips stay silent.
    """
    size = block_size(rate, release)
    done, report = mastered_blocks(blocks.blocked(samples, ["clip_id"], size), ["clip_id"], rate, size, target, ceiling_db, release, ride)
    return blocks.unblocked(done, ["clip_id"], size), report
