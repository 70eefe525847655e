"""Language-model scores by masked pseudo-likelihood.

A window network reads ``SIDE`` words on either side of a masked word and gives
the word's probability: embeddings, one hidden layer, and a two-step softmax
(class, then place in its class) that sums to one over all places. The corpus's
commonest words have a place each; the others share ``SHARED`` hashed places,
and a word's share of its place is its share of the place's count, so each word
has a probability of its own. The commonest ``LISTED`` words carry their counts;
those beyond share what is left of their place alike. Counts are taken over all
documents. A document's score is the sum of its words' log-probabilities.

Training is data-parallel: every task takes gradient steps on every position of
all its documents, and the tasks' weights are averaged, by the number of
positions, in two steps. What is sent is a fixed number of weights per task.
Weights therefore depend on how the table is split into partitions; for the
same files and split they are the same.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import released, small_batches, stored

SIDE, DIM, HIDDEN, CLASSES, IN_CLASS = 2, 16, 32, 48, 48
PLACES, SHARED, LISTED = CLASSES * IN_CLASS - 1, 256, 1 << 16
OWN = PLACES - SHARED
RATE, BATCH = 0.3, 8192
SHAPES = {"e": (PLACES + 1, DIM), "w": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "k": (CLASSES, HIDDEN, IN_CLASS), "kb": (CLASSES, IN_CLASS)}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all words of all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        out = lambda: pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
        for batch in batches:
            for text in batch["text"]:
                seen.update(words(text))
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        yield out()

    small_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string")).mapInPandas(lambda b: released(run(b)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """Number of each listed word; any other word has that of its shared place."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + zlib.crc32(word) % SHARED


class Vocabulary:
    """Numbers of words, and of each number its place and the log of its share of that place.

    Listed words are numbered by falling count; the numbers after them stand
    for all other words of each shared place. ``totals`` and ``kinds``: the
    count and the number of all distinct words by ``crc32 mod SHARED``.
    """

    def __init__(self, listed: list[bytes], counts: np.ndarray, totals: np.ndarray, kinds: np.ndarray) -> None:
        self.listed = listed
        hashed = np.array([zlib.crc32(w) % SHARED for w in listed], dtype=np.int64)
        self.number = Numbers(zip(listed, range(len(listed)), strict=True))
        own = np.arange(len(listed)) < OWN
        by = lambda x, at: np.bincount(hashed[at], weights=x[at], minlength=SHARED)
        shared = totals - by(counts, own) + 1
        rest = totals - by(counts, own | True) + 1
        others = kinds - by(np.ones(len(listed)), own | True) + 1
        self.place = np.concatenate([np.where(own, np.arange(len(listed)), OWN + hashed), OWN + np.arange(SHARED)]).astype(np.int32)
        self.share = np.concatenate([np.where(own, 0.0, np.log(np.maximum(counts, 1) / shared[hashed])), np.log(rest / shared / others)])
        self.counts = np.zeros(PLACES + 1)
        self.counts[: int(own.sum())] = counts[own]
        self.counts[OWN:PLACES] = shared

    def numbers(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.number.__getitem__, found), np.int32, len(found))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Three tables of bounded size reach the driver: how many words there are by size of count, the commonest words, and sums for each shared place.

    Listed are all words of a count that at most ``LISTED`` words reach, by
    eighths of a doubling.
    """
    counted = stored(count_words(docs))
    eighths = F.floor(8 * F.log2("n"))
    sizes = {r["e"]: r["kinds"] for r in counted.groupBy(eighths.alias("e")).agg(F.count(F.lit(1)).alias("kinds")).collect()}
    least, held = None, 0
    for e in sorted(sizes, reverse=True):
        held += sizes[e]
        if held > LISTED:
            break
        least = e
    top = [(bytes(r["word"]), r["n"]) for r in counted.filter(eighths >= least).collect()] if least is not None else []
    top.sort(key=lambda x: (-x[1], x[0]))
    sums = counted.groupBy((F.crc32("word") % SHARED).alias("place")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    totals, kinds = np.zeros((2, SHARED))
    for r in sums:
        totals[r["place"]], kinds[r["place"]] = r["n"], r["kinds"]
    return Vocabulary([w for w, _ in top], np.array([n for _, n in top], dtype=float), totals, kinds)


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """First weights: small random ones, and biases that give each place its share of the corpus."""
    rng = np.random.default_rng(1)
    p = {k: (0.1 if k == "e" else 1 / np.sqrt(s[-2] if len(s) > 1 else 1)) * rng.standard_normal(s) * (0 if k in ("b", "cb", "kb") else 1) for k, s in SHAPES.items()}
    n = (counts + 1.0).reshape(IN_CLASS, CLASSES).T  # place i is number i // CLASSES of class i % CLASSES
    p["k"] *= 0.1
    p["c"] *= 0.1
    p["cb"] = np.log(n.sum(axis=1) / n.sum())
    p["kb"] = np.log(n / n.sum(axis=1, keepdims=True))
    return {k: v.astype(np.float32) for k, v in p.items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


def contexts(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, 2 * SIDE neighbours) of all positions of the documents, padded at their ends."""
    pad = np.full(SIDE, PLACES, dtype=np.uint16)
    row = np.concatenate([pad, *(x for d in places for x in (d.astype(np.uint16), pad))])
    lengths = np.array([len(d) for d in places], dtype=np.int64)
    at = np.arange(lengths.sum()) + SIDE * (1 + np.repeat(np.arange(len(places)), lengths))
    return row[at], np.stack([row[at + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    """In place; returns the log of each row's sum, so that log p is the logit less it."""
    most = x.max(axis=1, keepdims=True)
    x -= most
    np.exp(x, out=x)
    total = x.sum(axis=1, keepdims=True)
    x /= total
    return (most + np.log(total))[:, 0]


def forward(p: dict, word: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """log p of each place, and what the gradients need; rows in the order of the place's class."""
    cls = (word % CLASSES).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    word, near, cls = word[order], near[order], cls[order]
    rows, place = np.arange(len(word)), word // CLASSES
    x = p["e"].take(near.ravel(), axis=0).reshape(len(near), -1)
    h = x @ p["w"]
    h += p["b"]
    np.tanh(h, out=h)
    top = h @ p["c"]
    top += p["cb"]
    edges = np.searchsorted(cls, np.arange(CLASSES + 1))
    inner = np.empty((len(word), IN_CLASS), dtype=np.float32)
    for k in range(CLASSES):
        if edges[k] < edges[k + 1]:
            s = slice(edges[k], edges[k + 1])
            np.matmul(h[s], p["k"][k], out=inner[s])
            inner[s] += p["kb"][k]
    lp = top[rows, cls] + inner[rows, place]
    lp -= softmax(top)
    lp -= softmax(inner)
    return lp, order, near, x, h, cls, place, top, inner, edges


def step(p: dict, word: np.ndarray, near: np.ndarray, rate: float) -> None:
    """One gradient step on the mean negative log-probability of the places."""
    _, _, near, x, h, cls, place, dt, di, edges = forward(p, word, near)
    n, rows = len(word), np.arange(len(word))
    dt[rows, cls] -= 1
    di[rows, place] -= 1
    dh = dt @ p["c"].T
    for k in range(CLASSES):
        if edges[k] < edges[k + 1]:
            s = slice(edges[k], edges[k + 1])
            dh[s] += di[s] @ p["k"][k].T
            # A class's weights move by its own mean gradient, damped where it has few rows.
            m = edges[k + 1] - edges[k] + n / CLASSES
            p["k"][k] -= rate / m * (h[s].T @ di[s])
            p["kb"][k] -= rate / m * di[s].sum(axis=0)
    p["c"] -= rate / n * (h.T @ dt)
    p["cb"] -= rate / n * dt.sum(axis=0)
    h *= h
    np.subtract(1, h, out=h)
    dh *= h
    dx = (dh @ p["w"].T).reshape(-1, DIM)
    p["w"] -= rate / n * (x.T @ dh)
    p["b"] -= rate / n * dh.sum(axis=0)
    flat_near = near.ravel()
    by = np.argsort(flat_near, kind="stable")
    sorted_near = flat_near[by]
    at = np.flatnonzero(np.concatenate([[True], sorted_near[1:] != sorted_near[:-1]]))
    p["e"][sorted_near[at]] -= rate / n * 20 * np.add.reduceat(dx.take(by, axis=0), at)


class Network:
    """The vocabulary and the weights; ``log_probabilities`` scores documents of word numbers."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray) -> None:
        self.vocabulary, self.weights = vocabulary, weights

    def log_probabilities(self, ids: list[np.ndarray]) -> np.ndarray:
        """The log-probability of every word of the documents, one after another."""
        p, v = shaped(self.weights), self.vocabulary
        if not sum(map(len, ids)):
            return np.zeros(0)
        word, near = contexts([v.place[d] for d in ids])
        out = v.share[np.concatenate(ids)]
        for i in range(0, len(word), BATCH):
            lp, order, *_ = forward(p, word[i : i + BATCH], near[i : i + BATCH])
            out[i + order] += lp
        return out


def batched(batches: Iterator[pd.DataFrame], vocabulary: Vocabulary, most: int = 1 << 17) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, word numbers) of whole documents, about ``most`` words at a time."""
    for batch in batches:
        keys, ids, held = [], [], 0
        for key, text in zip(batch["doc_id"], batch["text"], strict=True):
            keys.append(key)
            ids.append(vocabulary.numbers(text))
            held += len(ids[-1])
            if held >= most:
                yield keys, ids
                keys, ids, held = [], [], 0
        if keys:
            yield keys, ids


def train(docs: DataFrame) -> Network:
    """A network from all positions of all texts of ``docs``.

    Null and empty texts teach nothing; repeated rows teach again. Without any
    word the weights are the first ones and all places alike.
    """
    spark = docs.sparkSession
    known = vocabulary(docs)
    network = Network(known, flat(start(known.counts)))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = spark.sparkContext.broadcast(network)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        p, n, rng = shaped(own.weights.copy()), 0, np.random.default_rng(7)
        for _, ids in batched(batches, own.vocabulary):
            word, near = contexts([own.vocabulary.place[d] for d in ids])
            mixed = rng.permutation(len(word))
            for i in range(0, len(word), BATCH):
                c = mixed[i : i + BATCH]
                step(p, word[c], near[c], RATE * min(1.0, len(c) / BATCH + 0.1))
            n += len(word)
        if n:
            yield pd.DataFrame({"n": [n], "v": [flat(p).tobytes()]})

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for batch in batches:
            for k, v in zip(batch["n"], batch["v"], strict=True):
                x = np.frombuffer(v, np.float32).astype(np.float64) * k
                total, n = (x if total is None else total + x), n + k
        if n:
            yield pd.DataFrame({"n": [n], "v": [(total / n).astype(np.float32).tobytes()]})

    small_batches(spark)
    parts = texts.mapInPandas(lambda b: released(learn(b)), "n long, v binary")
    fan = max(1, int(texts.rdd.getNumPartitions() ** 0.5))
    merged = parts.repartition(fan).mapInPandas(mean, "n long, v binary").repartition(1).mapInPandas(mean, "n long, v binary").collect()
    sent.unpersist()
    return Network(known, np.frombuffer(merged[0]["v"], np.float32)) if merged else network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob``: the sum over a document's words, and by word.

    Null and empty texts have no words, sum 0 and a null mean. Whole texts are
    scored; each word sees only its own document. A repeated row repeats its
    score, a null doc_id stays null. Other columns are not returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for keys, ids in batched(batches, own.vocabulary):
            lp = np.append(own.log_probabilities(ids), 0.0)
            lengths = np.array([len(d) for d in ids])
            ends = np.cumsum(lengths)
            total = np.where(lengths > 0, np.add.reduceat(lp, ends - lengths), 0.0)
            mean = pd.array(total / np.maximum(lengths, 1), dtype="Float64")
            mean[lengths == 0] = pd.NA
            yield pd.DataFrame({"doc_id": pd.array(keys, dtype="Int64"), "n_words": lengths, "log_prob": total, "mean_log_prob": mean})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(lambda b: released(run(b)), "doc_id long, n_words long, log_prob double, mean_log_prob double")
