"""Packing by non-negative least squares over shallow length combinations.

Every document becomes token ids plus one end id, cut at whole windows only, so
a document has full pieces and one rest. Lengths fall into bins of ``UNIT``
tokens. Combinations of at most three bins that fill a window exactly are the
columns of a least-squares problem against the histogram; its non-negative
solution, rounded, says how often each combination is used. Bins left over are
packed greedily, largest first. Only the histogram (at most 256 numbers)
reaches the driver; pieces find their place from their rank within their bin.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cadenza.llm.common import ranked, released, small_batches, stored
from cadenza.llm.tokens import encoder

WINDOW, UNIT, END_ID = 2048, 8, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of at most ``window`` ids; null and empty texts are the end id alone."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(lambda b: released(pieces(b)), PIECES)


@functools.lru_cache(maxsize=4)
def combinations(size: int) -> tuple[tuple[int, ...], ...]:
    """All multisets of one to three positive bins with sum ``size``."""
    two = [(a, size - a) for a in range((size + 1) // 2, size)]
    three = [(a, b, size - a - b) for a in range(-(-size // 3), size - 1) for b in range(max(1, -(-(size - a) // 2)), min(a, size - a - 1) + 1)]
    return ((size,), *two, *three)


def nonneg_lsq(a: np.ndarray, b: np.ndarray, rounds: int = 800) -> np.ndarray:
    """min |a x - b|, x >= 0, by accelerated projected gradient steps."""
    step = 1 / max(1e-9, np.linalg.norm(a @ a.T, 2))
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(bins of a window with their counts, number of such windows); it uses up the histogram."""
    left = np.zeros(size + 1, dtype=np.int64)
    for b, n in histogram.items():
        left[b] = n
    if not left.any():
        return []
    made = []
    # Only combinations whose bins all occur can be used.
    combos = [c for c in combinations(size) if all(left[b] for b in c)]
    if combos:
        a = np.zeros((size + 1, len(combos)))
        for j, c in enumerate(combos):
            for b in c:
                a[b, j] += 1
        scale = left.max()
        x = nonneg_lsq(a, left / scale) * scale
        for j in np.argsort(-x, kind="stable"):
            need = {b: combos[j].count(b) for b in combos[j]}
            n = min(int(np.rint(x[j])), *(int(left[b]) // m for b, m in need.items()))
            if n > 0:
                made.append((need, n))
                for b, m in need.items():
                    left[b] -= n * m
    while left.any():
        room, need = size, {}
        for b in range(size, 0, -1):
            if left[b] and b <= room:
                need[b] = int(min(left[b], room // b))
                room -= b * need[b]
        n = min(int(left[b]) // m for b, m in need.items())
        made.append((need, n))
        for b, m in need.items():
            left[b] -= n * m
    return made


def pack(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, tokenizer: str | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; an empty table gives no rows.

    Repeated rows are packed each for itself; a null doc_id stays null. No
    sequence holds more than ``window`` ids, and each id lies in exactly one
    piece. Other columns are not returned.
    """
    size = window // unit
    pieces = stored(cut(docs, window, tokenizer)).withColumn("bin", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["bin"]: r["n"] for r in pieces.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    places: dict[int, list[tuple[int, int, int]]] = {}  # bin: (ranks before, first sequence, pieces a sequence)
    used: dict[int, int] = {}
    first = 0
    for need, n in plan(histogram, size):
        for b, m in need.items():
            places.setdefault(b, []).append((used.get(b, 0), first, m))
            used[b] = used.get(b, 0) + n * m
        first += n
    tables = {b: np.array(p, dtype=np.int64).T for b, p in places.items()}

    @F.pandas_udf("long")
    def sequence(bins: pd.Series, ranks: pd.Series) -> pd.Series:
        b, r, out = bins.to_numpy(), ranks.to_numpy(), np.zeros(len(bins), dtype=np.int64)
        for k in np.unique(b):
            at = b == k
            before, start, m = tables[int(k)]
            i = np.searchsorted(before, r[at], side="right") - 1
            out[at] = start[i] + (r[at] - before[i]) // m[i]
        return pd.Series(out)

    placed = ranked(pieces, "bin", [F.xxhash64("doc_id", "start"), F.col("doc_id"), F.col("start")], sum(histogram.values()))
    placed = placed.withColumn("sequence_id", sequence("bin", "rank"))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
