"""Hard negatives by a search in norm buckets.

Vectors are rounded to integers, so all scores are exact. Candidates are dealt to
lanes, sorted by falling norm there and cut into buckets. A task holds one lane
and one block of anchors and goes down the lane's buckets; by Cauchy and Schwarz
no score exceeds the product of the two norms, so a window's search ends at the
first bucket whose largest norm cannot reach the window's lower limit, or its
k-th best score so far. Before anything is moved, the same bound drops buckets
that no window of a block can use: blocks hold windows of like need.

Positives are searched among rows of the same label first (lanes within groups
of labels); their scores then open one window each, which is searched among
rows of other labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.llm.common import released, small_batches, stored
from cadenza.llm.whitening import commonest_length, finite

SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 3, 50, 95
#: Rows of a bucket; windows that go down a lane together; rows of a lane and of a block of anchors at most; groups of labels.
BUCKET, CHUNK, LANE, BLOCK, LABELS = 1_024, 256, 1 << 19, 1 << 14, 256
#: Integers that doubles hold; the squared length of a vector beyond which scores may leave a long.
EXACT, LONGEST = 1 << 53, float(1 << 62)
#: Bands of windows of like need.
BANDS = 16

FOUND = "anchor long, slot int, id long, score long"


def lanes_for(rows: Column) -> Column:
    """The square root of the number of buckets, so that neither lanes nor what they return grows with all rows; no lane is larger than ``LANE``."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(rows / BUCKET)), F.ceil(rows / LANE)).cast("int")


def dtype_for(largest: int) -> np.dtype:
    return np.dtype(np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64)


def prepared(df: DataFrame, is_anchor: Column, label: Column, key: str, vec: str) -> DataFrame:
    """``id, label, x, square, anchor``: usable rows as integers, one for each id (the smallest by label and vector)."""
    clean = df.filter(F.col(key).isNotNull() & label.isNotNull() & finite(vec))
    dim = commonest_length(clean, vec)
    # What is clamped is beyond the longest vector that takes part.
    floored = F.transform(vec, lambda c: F.floor(F.greatest(F.lit(-4e18), F.least(F.lit(4e18), c.cast("double") * SCALE))))
    sized = clean.filter(F.size(vec) == dim).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), floored.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    one = sized.withColumn("square", square).filter(F.col("square") < LONGEST).groupBy("id").agg(F.min(F.struct("label", "x", "square", "anchor")).alias("r"))
    return one.select("id", "r.*")


def packed(rows: DataFrame, keys: list[str], largest: int) -> DataFrame:
    """Buckets of ``rows``, each lane's by falling norm: ids, labels and vectors as bytes, with the largest square of a norm."""
    kind = dtype_for(largest)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in (*[], *batches, None):
            held = batch if held is None else held if batch is None else pd.concat([held, batch])
            if held is None or not len(held):
                continue
            groups = [g for _, g in held.groupby(keys, sort=False)]
            # The last lane may go on in the next batch, in whole buckets.
            for i, g in enumerate(groups):
                ended = batch is None or i < len(groups) - 1
                end = len(g) if ended else len(g) // BUCKET * BUCKET
                for a in range(0, end, BUCKET):
                    b = g.iloc[a : min(a + BUCKET, end)]
                    yield pd.DataFrame({**{k: [b[k].iloc[0]] for k in keys}, "square": [b["square"].max()], "n": [len(b)], "ids": [b["id"].to_numpy(np.int64).tobytes()], "labels": [b["label"].to_numpy(np.int64).tobytes()], "x": [np.stack(b["x"].to_numpy()).astype(kind).tobytes()]})
                held = None if ended else g.iloc[end:]

    placed = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("square"), "id")
    return placed.select(*keys, "id", "label", "x", "square").mapInPandas(lambda b: released(cut(b)), ", ".join(f"{k} int" for k in keys) + ", square double, n int, ids binary, labels binary, x binary")


class Lane:
    """Buckets of one lane, by falling norm."""

    def __init__(self, frame: pd.DataFrame, kind: np.dtype) -> None:
        frame = frame.sort_values("square", ascending=False, kind="stable")
        self.buckets = []
        for r in frame.itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            self.buckets.append((math.sqrt(r.square), ids, np.frombuffer(r.labels, np.int64), np.frombuffer(r.x, kind).reshape(len(ids), -1)))

    def best(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, id, score): each window's first ``k`` with ``low <= score <= high``, ties to smaller ids.

        ``x, ids, labels``: anchors; ``of``: each window's anchor. ``same``: of the anchor's label and another id, else of other labels.
        """
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        top = np.full((len(of), k), -np.inf)
        win, got, points = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for norm, theirs, their_labels, y in self.buckets:
            # A little more than the bound, for its rounding.
            reach = norms[of] * norm * (1 + 1e-9) + 1
            live = np.flatnonzero((reach >= low) & (reach >= top[:, k - 1]))
            if not len(live):
                break
            used, where = np.unique(of[live], return_inverse=True)
            exact = norms[used].max() * norm < EXACT
            s = x[used].astype(np.float64) @ y.T.astype(np.float64) if exact else x[used] @ y.T.astype(np.int64)
            fits = (labels[used][:, None] == their_labels) & (ids[used][:, None] != theirs) if same else labels[used][:, None] != their_labels
            mine = s[where]
            ok = fits[where] & (mine >= low[live][:, None]) & (mine <= high[live][:, None])
            masked = np.where(ok, mine.astype(np.float64), -np.inf)
            least = np.partition(masked, -k, axis=1)[:, -k] if masked.shape[1] > k else np.full(len(live), -np.inf)
            # Doubles order longs up to ties, and those all stay.
            a, b = np.nonzero(ok & (masked >= np.maximum(least, top[live, k - 1])[:, None]))
            if not len(a):
                continue
            win, got, points = np.concatenate([win, live[a]]), np.concatenate([got, theirs[b]]), np.concatenate([points, mine[a, b].astype(np.int64)])
            order = np.lexsort((got, -points, win))
            win, got, points = win[order], got[order], points[order]
            first = np.searchsorted(win, win)
            rank = np.arange(len(win)) - first
            win, got, points, rank = (z[rank < k] for z in (win, got, points, rank))
            top[win, rank] = points
        return win, got, points


def searched(buckets: DataFrame, windows: DataFrame, keys: list[str], k: int, same: bool, largest: int) -> DataFrame:
    """``anchor, slot, id, score``: each lane's best for each window, by cogroups of one lane and one block of windows."""
    kind = dtype_for(largest)

    def run(lane: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "slot": [], "id": [], "score": []})]
        if len(lane) and len(asked):
            held = Lane(lane, kind)
            for a in range(0, len(asked), CHUNK):
                part = asked.iloc[a : a + CHUNK]
                x, ids = np.stack(part["x"].to_numpy()), part["id"].to_numpy(np.int64)
                slots = [np.asarray(p, np.int64) for p in part["positives"]]
                of = np.repeat(np.arange(len(part)), [len(p) for p in slots])
                slot = np.concatenate([np.arange(len(p)) for p in slots])
                low, high = (np.full(len(of), -np.inf), np.full(len(of), np.inf)) if same else limits(np.concatenate(slots))
                win, got, score = held.best(x, ids, part["label"].to_numpy(np.int64), of, low, high, k, same)
                out.append(pd.DataFrame({"anchor": ids[of[win]], "slot": slot[win], "id": got, "score": score}))
        return pd.concat(out[1:] or out)

    return buckets.groupBy(*keys, "block").cogroup(windows.groupBy(*keys, "block")).applyInPandas(run, FOUND)


def limits(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score of a negative, as integers: LEAST * p <= 100 * s <= MOST * p."""
    exact = [(-(-LEAST * p // 100), MOST * p // 100) for p in scores.tolist()]
    return np.array([a for a, _ in exact], dtype=np.int64), np.array([b for _, b in exact], dtype=np.int64)


def first_few(found: DataFrame, k: int, out: str) -> DataFrame:
    """The best ``k`` of all lanes, with their rank from 1."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def same_label(rows: DataFrame, k: int, largest: int) -> DataFrame:
    """``anchor, id, score, place``: each anchor's best ``k`` rows of its label."""
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int"))
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("asked")).filter("asked > 0")
    sizes = sizes.select("group", lanes_for(F.col("n")).alias("lanes"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("blocks"))
    known = grouped.join(F.broadcast(sizes), "group")  # at most LABELS rows
    dealt = known.withColumn("lane", F.pmod(F.xxhash64("id"), "lanes").cast("int"))
    buckets = packed(dealt, ["group", "lane"], largest).join(F.broadcast(sizes), "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = known.filter("anchor").select("id", "label", "x", F.array(F.lit(0).cast("long")).alias("positives"), "group", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.pmod(F.xxhash64(F.lit(5), "id"), "blocks").cast("int").alias("block"))
    return first_few(searched(buckets, asked, ["group", "lane"], k, True, largest), k, "place").drop("slot")


def other_labels(rows: DataFrame, found: DataFrame, k: int, largest: int, n: int) -> DataFrame:
    """``anchor, slot, id, score, rank``: each window's best ``k`` rows of other labels; slots follow the order of the positives."""
    opened = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("positives"))
    asked = rows.filter("anchor").join(opened.withColumnRenamed("anchor", "id"), "id")
    # The least norm that any of the windows can use; below 0 a window is empty.
    need = F.array_min(F.filter("positives", lambda p: p >= 0)) * (LEAST / 100) / F.greatest(F.lit(1.0), F.sqrt("square"))
    asked = stored(asked.select("id", "label", "x", "positives", need.alias("need")).filter("need is not null"))
    edges = asked.agg(F.percentile_approx("need", [i / BANDS for i in range(1, BANDS)])).first()[0] or []
    band = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("need"))) if edges else F.lit(0)
    banded = asked.withColumn("band", band)
    bands = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).orderBy("band").collect()  # BANDS rows
    first, blocks = 0, []
    for b in bands:
        blocks.append((b["band"], first, -(-b["n"] // BLOCK), b["need"]))
        first += blocks[-1][2]
    if not blocks:
        return rows.sparkSession.createDataFrame([], FOUND + ", rank int")
    n_lanes = max(1, math.isqrt(n // BUCKET), -(-n // LANE))
    lane = lambda x: F.pmod(F.xxhash64(x), F.lit(n_lanes)).cast("int")
    # Buckets go to the blocks of the bands that their largest norm can serve.
    serves = F.flatten(F.array(*[F.when(F.sqrt("square") * (1 + 1e-9) + 1 >= need, F.sequence(F.lit(a), F.lit(a + m - 1))).otherwise(F.array().cast("array<int>")) for _, a, m, need in blocks]))
    buckets = packed(rows.withColumn("lane", lane("id")), ["lane"], largest).withColumn("block", F.explode(serves))
    of_band = F.coalesce(*[F.when(F.col("band") == b, a + F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(m)).cast("int")) for b, a, m, _ in blocks])
    windows = banded.select("id", "label", "x", "positives", of_band.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))).alias("lane"))
    return first_few(searched(buckets, windows, ["lane"], k, False, largest), k, "rank")


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its best rows of the same label; a positive's
    negatives the best rows of other labels that score between 50 and 95 % of it.
    Scores are inner products of ``floor(256 * x)``, ties go to the smaller id.

    Rows without an id, a whole-number ``label`` or a full vector of finite numbers
    take no part, nor do those of another length than most, or whose squared
    length (as integers) reaches 2**62. Of rows that share an id one takes part,
    the smallest by label and vector, so repeated rows count once. An anchor
    without positives, or a positive without negatives, returns nothing, as an
    empty table does.
    """
    small_batches(df.sparkSession)
    rows = stored(prepared(df, is_anchor, label, key, vec))
    size = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("largest"), F.count(F.lit(1)).alias("n")).first()
    largest, n = int(size["largest"] or 0), size["n"]
    found = stored(same_label(rows, positives, largest))
    near = other_labels(rows, found, negatives, largest, n)
    of = found.select("anchor", (F.col("place") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(of, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
