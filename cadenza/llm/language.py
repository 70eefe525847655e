"""Language identification by hierarchical discrimination.

A text is the distribution of its hashed letter trigrams. First one-versus-one
linear support vector machines tell the language family, then others tell the
languages of that family apart; each machine gives one vote, and the margins
break ties. Machines are fitted on a bounded sample of labelled texts of each
language, each in a task of its own. Prediction reads a table of weights per
trigram, so a whole text costs a few lookups a byte.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm.common import released, small_batches

BUCKETS = 1 << 13
#: Labelled texts of one language that a fit may read, about.
SAMPLE = 1_000
#: Families of common languages; any other language is a family by itself.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
UNDETERMINED = "und"
ASCII_LETTER = re.compile("[A-Za-z]")
BLANK = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
SCALE = 30.0


def has_letter(text: str | None) -> bool:
    """Any character of Unicode's letter categories."""
    return bool(text) and (ASCII_LETTER.search(text) is not None or not text.isascii() and any(map(str.isalpha, text)))


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the texts, one after another, and where each text begins. A text has three at least."""
    data = [b"  " + t.lower().encode("utf-8", "replace").translate(BLANK) + b"  " for t in texts]
    lengths = np.array([len(d) for d in data], dtype=np.int64)
    b = np.frombuffer(b"".join(data) + b"  ", np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int32), np.concatenate([[0], np.cumsum(lengths)[:-1]])


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text, the buckets that it has, and their shares of its trigrams."""
    grams, starts = trigrams(texts)
    for s, e in zip(starts, [*starts[1:], len(grams)], strict=True):
        at, n = np.unique(grams[s:e], return_counts=True)
        yield at.astype(np.int32), (n / (e - s)).astype(np.float32)


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int = BUCKETS, c: float = 1.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM (hinge loss, bias among the weights) by dual coordinate descent over sparse rows; y in -1, 1; classes weigh alike."""
    most = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * c
    norms = np.array([float(v @ v) + 1 for _, v in rows])
    alpha, w, bias = np.zeros(len(y)), np.zeros(size), 0.0
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0), most[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[at] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def machines(langs: list[str]) -> list[tuple[str, str, str]]:
    """(level, one, other): families against each other, then the languages inside each."""
    by: dict[str, list[str]] = {}
    for lang in sorted(langs):
        by.setdefault(family(lang), []).append(lang)
    out = [("", a, b) for a, b in itertools.combinations(sorted(by), 2)]
    return out + [(f, a, b) for f in sorted(by) for a, b in itertools.combinations(by[f], 2)]


class Model:
    def __init__(self, langs: list[str], names: list[tuple[str, str, str]], weights: np.ndarray, biases: np.ndarray) -> None:
        self.langs, self.names, self.weights, self.biases = langs, names, weights, biases

    def vote(self, margins: np.ndarray, level: str, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the winning class, score 0 to 1) per row."""
        votes = np.zeros((len(margins), len(classes)))
        sure = np.ones((len(margins), len(classes)))
        for j, (at, a, b) in enumerate(self.names):
            if at == level and a in classes and b in classes:
                p = 1 / (1 + np.exp(-np.clip(2 * margins[:, j], -50, 50)))
                ia, ib = classes.index(a), classes.index(b)
                votes[:, ia] += (p >= 0.5) + p * 1e-3
                votes[:, ib] += (p < 0.5) + (1 - p) * 1e-3
                sure[:, ia] = np.minimum(sure[:, ia], p)
                sure[:, ib] = np.minimum(sure[:, ib], 1 - p)
        best = votes.argmax(axis=1)
        return best, sure[np.arange(len(best)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        real = [i for i, t in enumerate(texts) if has_letter(t)]
        if not real or not self.langs:
            return out, score
        margins = np.zeros((len(real), len(self.names)))
        if self.names:
            # Whole texts, a few at a time, so a row of weights a byte stays small.
            lo = 0
            while lo < len(real):
                hi, held = lo, 0
                while hi < len(real) and (hi == lo or held < 1 << 20):
                    held += len(texts[real[hi]])
                    hi += 1
                grams, starts = trigrams([texts[i] for i in real[lo:hi]])
                sizes = np.diff(np.append(starts, len(grams)))
                for j in range(len(self.names)):
                    margins[lo:hi, j] = np.add.reduceat(self.weights[j][grams], starts, dtype=np.float64) / sizes + self.biases[j]
                lo = hi
        families = sorted({family(x) for x in self.langs})
        top, sure = self.vote(margins, "", families)
        for f, name in enumerate(families):
            rows = np.flatnonzero(top == f)
            inside = sorted(x for x in self.langs if family(x) == name)
            best, inner = self.vote(margins[rows], name, inside)
            for r, k, s in zip(rows, best, inner, strict=True):
                out[real[r]] = inside[k]
                score[real[r]] = s * sure[r]
        return out, score


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``doc_id, text, lang`` rows; rows without a language, or a letter in the text, teach nothing.

    About ``sample`` rows a language are read, those with the smallest hashes
    of their id and text. Every language with a text is learned; machines grow
    with the square of the families' number, 32 KB of weights each. With one
    language there is nothing to tell apart.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs = sorted(counts)
    names = machines(langs)
    if not names:
        return Model(langs, [], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])[F.col("lang")]
    chosen = rows.filter(unit < share).select("text", "lang")

    def roles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            out = []
            for lang, (at, x) in zip(batch["lang"], features(list(batch["text"])) if len(batch) else (), strict=True):
                for j, (level, a, b) in enumerate(names):
                    own = family(lang) if level == "" else lang if level == family(lang) else None
                    if own in (a, b):
                        out.append((j, 1 if own == a else -1, at.tobytes(), x.tobytes()))
            yield pd.DataFrame(out, columns=["machine", "y", "at", "x"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "at", "x"], kind="stable")
        scale = np.sqrt(SCALE) * SCALE
        rows = [(np.frombuffer(at, np.int32), np.frombuffer(v, np.float32) * scale) for at, v in zip(group["at"], group["x"], strict=True)]
        w, bias = fit_machine(rows, group["y"].to_numpy(np.float64))
        return pd.DataFrame({"machine": [int(group["machine"].iloc[0])], "w": [(scale * w).astype(np.float32).tobytes()], "bias": [float(bias)]})

    small_batches(spark)
    fitted = chosen.mapInPandas(lambda b: released(roles(b)), "machine int, y int, at binary, x binary").groupBy("machine").applyInPandas(train, "machine int, w binary, bias double").collect()
    weights, biases = np.zeros((len(names), BUCKETS), np.float32), np.zeros(len(names))
    for r in fitted:
        weights[r["machine"]], biases[r["machine"]] = np.frombuffer(r["w"], np.float32), r["bias"]
    return Model(langs, names, weights, biases)


def held_out() -> Column:
    """Rows that no fit may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; null texts and texts without a letter are ``und`` with score 0.

    All other columns pass through; those named like the new ones are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.names, model.weights, model.biases))
    small_batches(docs.sparkSession)

    # Nondeterministic only in name: a filter on the result must not make Spark predict twice.
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*sent.value)
        for t in texts:
            lang, score = own.predict([x or None for x in t])
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    told = F.pandas_udf(told, "lang_pred string, score double").asNondeterministic()
    return docs.withColumn("_told", told(F.col("text").cast("string"))).select(*docs.columns, "_told.lang_pred", "_told.score")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row, learned from the rows not held out."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"), sample)
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
