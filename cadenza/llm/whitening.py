"""Whitening of embeddings from an exact integer scatter.

Components become integers. Sums and cross-products are taken of the integers
less a shift near their mean, without any rounding, and so the covariance
``n X'X - S S'`` is an exact integer matrix, whatever the number of rows or their
order. Only then does it become floating point, and is decomposed.

A task multiplies blocks of rows in double precision where that is exact (as
long as sums stay below 2**53), else in 64-bit or Python's integers. What tasks
return is cut into digits of 32 bits, which Spark adds up: the sums never
overflow, and what reaches the driver depends on the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm.common import released, small_batches, stored

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
ROWS = 1 << 14
DIGIT = 32
EXACT, LONG = 1 << 53, 1 << 63


def finite(vec: str) -> Column:
    """Vectors without null or non-finite entries; false for null."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def commonest_length(df: DataFrame, vec: str) -> int:
    """Ties go to the longer; 0 for an empty table."""
    top = df.groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return int(top["d"]) if top else 0


def integers(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET, as 64-bit integers or, where these do not hold them, Python's."""
    x = np.floor(SCALE * c)
    if x.size == 0 or np.abs(x).max() < LONG / 2:
        return x.astype(np.int64) + OFFSET
    # SCALE * c may leave the doubles; the product is exact in integers.
    return np.array([[exact_floor(v) + OFFSET for v in row] for row in c.tolist()], dtype=object)


def exact_floor(v: float) -> int:
    up, down = v.as_integer_ratio()
    return SCALE * up // down


def products(y: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(column sums, y'y), exactly, as Python integers."""
    d = y.shape[1]
    most = max(abs(int(y.min())), abs(int(y.max())), 1)
    if len(y) * most * most < EXACT:
        z = y.astype(np.float64)
        return y.sum(axis=0).tolist(), (z.T @ z).astype(np.int64).tolist()
    if len(y) * most * most < LONG and y.dtype != object:
        return y.sum(axis=0).tolist(), (y.T @ y).tolist()
    z = y.astype(object)
    return [int(v) for v in z.sum(axis=0)], [[int(v) for v in row] for row in (z.T @ z).reshape(d, d)]


def digits(value: int) -> list[int]:
    """Signed digits of ``DIGIT`` bits, lowest first."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out


def scatter(good: DataFrame, vec: str, dim: int, shift: list[int]) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, cross-products) of the integers less ``shift``, exactly.

    A task keeps one matrix and returns its digits once, at most ``d * d`` times
    the number of digits; Spark adds those of equal place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, cross = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        held: list[np.ndarray] = []

        def fold() -> None:
            nonlocal sums, cross
            x = integers(np.concatenate(held))
            y = x - np.array(shift, dtype=object if x.dtype == object or max(map(abs, shift)) >= LONG / 2 else np.int64)
            s, c = products(y)
            sums, cross = sums + np.array(s, dtype=object), cross + np.array(c, dtype=object).reshape(dim, dim)
            held.clear()

        for batch in batches:
            if len(batch):
                held.append(np.stack(batch["vec"].to_numpy()).astype(np.float64))
                n += len(batch)
                if sum(map(len, held)) >= ROWS:
                    fold()
        if held:
            fold()
        if n:
            rows = [(-1, -1, p, v) for p, v in enumerate(digits(n))]
            rows += [(-1, j, p, v) for j in range(dim) for p, v in enumerate(digits(int(sums[j])))]
            rows += [(i, j, p, v) for i in range(dim) for j in range(i, dim) for p, v in enumerate(digits(int(cross[i, j])))]
            yield pd.DataFrame(rows, columns=["i", "j", "p", "v"])

    parts = good.select(F.col(vec).alias("vec")).mapInPandas(lambda b: released(run(b)), "i int, j int, p int, v long")
    n, sums, cross = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    # decimal(38) holds the sum of 10**28 digits.
    for r in parts.groupBy("i", "j", "p").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).toLocalIterator():
        value = int(r["v"]) << DIGIT * r["p"]
        if r["j"] < 0:
            n += value
        elif r["i"] < 0:
            sums[r["j"]] += value
        else:
            cross[r["i"]][r["j"]] += value
            if r["i"] != r["j"]:
                cross[r["j"]][r["i"]] += value
    return n, sums, cross


def decomposed(n: int, sums: list[int], cross: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, eigenvectors as columns, trace) of the covariance; integers up to the last division."""
    d = len(sums)
    scaled = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    v = np.array([[a / (n * n) for a in row] for row in scaled])
    e, q = np.linalg.eigh(v)
    return e[::-1], q[:, ::-1], sum(scaled[i][i] for i in range(d)) / (n * n)


def whitened_rows(good: DataFrame, key: str, vec: str, shift: list[int], n: int, sums: list[int], q: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``key, deviation, w``: the squared deviation from the mean times n squared (a decimal's digits, null beyond 38), and the whitened components."""

    def deviations(y: np.ndarray) -> list[str | None]:
        most = n * max(abs(int(y.min())), abs(int(y.max()))) + max(map(abs, sums))
        fits = y.shape[1] * most * most < LONG and y.dtype != object
        z = n * y - np.array(sums, dtype=np.int64) if fits else n * y.astype(object) - np.array(sums, dtype=object)
        return [t if len(t) <= 38 else None for t in map(str, (z * z).sum(axis=1).tolist())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean = np.array([s / n for s in sums])
        for batch in batches:
            if len(batch):
                x = integers(np.stack(batch["vec"].to_numpy()).astype(np.float64))
                y = x - np.array(shift, dtype=object if x.dtype == object or max(map(abs, shift)) >= LONG / 2 else np.int64)
                w = ((y.astype(np.float64) - mean) @ q) * scale
                yield pd.DataFrame({"key": batch["key"], "deviation": deviations(y), "w": list(w)})

    return good.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("vec")).mapInPandas(lambda b: released(run(b)), "key long, deviation string, w array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest entry of the whitened rows' covariance minus the identity; centred before multiplying, divisor n."""
    w = [F.col("w")[i] for i in range(k)]
    mean = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    away = [c - F.lit(m) for c, m in zip(w, mean, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = rows.agg(*[F.avg(away[i] * away[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, cov, strict=True))


def whiten(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each remaining row and component.

    Rows whose vector is null, holds null or non-finite entries, or has another
    length than most, are left out; rows without an id and repeated rows stay. An
    empty table gives no rows. ``deviation`` is a decimal, null where it has more
    than 38 digits. A component along which nothing varies has ``whitened`` 0, and then
    ``identity_error`` is 1. Vectors of fewer dimensions than ``components`` have
    that many components.
    """
    small_batches(df.sparkSession)
    clean = df.filter(finite(vec))
    dim = commonest_length(clean, vec)
    good = clean.filter(F.size(vec) == dim)
    # The shift only keeps numbers small: any integers give the same covariance, and these lie near the means.
    about = good.agg(*[F.avg(F.col(vec)[j].cast("double")).alias(f"c{j}") for j in range(dim)]).first() if dim else []
    shift = [exact_floor(c) + OFFSET if np.isfinite(c) else OFFSET for c in about]
    n, sums, cross = scatter(good, vec, dim, shift) if dim else (0, [], [])
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    k = min(components, dim)
    e, q, trace = decomposed(n, sums, cross)
    e, q = e[:k], q[:, :k]
    # Rounding leaves what does not vary with a tiny eigenvalue of either sign.
    varies = e > trace * dim * np.finfo(float).eps
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, e, 1.0)), 0.0)
    rows = stored(whitened_rows(good, key, vec, shift, n, sums, q, scale))
    error = identity_error(rows, k)
    explained = F.array(*[F.lit(float(x / trace) if trace else 0.0) for x in e])
    long = rows.select(F.col("key").alias("vec_id"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))
