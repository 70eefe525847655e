"""Fuzzy resolution of songs in the library by token sets, without losing a pair.

Keys as written and keys without diacritics are one table of distinct forms. It
is dealt to lanes, each with an inverted index of tokens and with bit strings of
letters and of pairs of letters (2-grams). For a song, those bit strings bound
what any form can score; forms are scored by falling bound, many at a time, until
the bound lies below the best score. So only forms that can still win are scored.

Why the bounds hold, for strings p and q of n letters together whose longest
common subsequence has m letters: m is at most the common letters with their
counts; and of the 2-grams of p (with a space at both ends) every letter that is
taken out destroys two and every one put in destroys one, so both sides' missing
2-grams together are at most 3 (n - 2m). The tokens' order changes neither.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from cadenza.config import DEFAULT
from cadenza.functions import text

#: Forms of a lane, songs of a block, forms that are scored at first (then twice as many each time).
LANE, BLOCK, FIRST = 1 << 15, 1 << 10, 64
#: Letters of a machine word: longer strings are compared one by one.
WORD = 64
#: Classes of letters (by code), and how many of a class have a bit each.
CLASSES, TIMES = 32, 4

#: Marks that a decomposition sets apart, Hebrew points among them.
MARKS = regex.compile(r"\p{M}+")


def folded(key: str) -> str:
    """The key without diacritics."""
    return key if key.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", key))


def token_set_ratio(a: list[str], b: list[str]) -> float:
    """0 to 100 from the sorted token sets; 100 when one holds the other."""
    x, y = set(a), set(b)
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 100.0
    first, second = f"{common} {left}".strip(), f"{common} {right}".strip()
    pairs = [(first, second)] + ([(common, first), (common, second)] if common else [])
    return max(_indel(p, q) for p, q in pairs)


def _indel(p: str, q: str) -> float:
    """200 * LCS / lengths; the LCS bit-parallel (Hyyrö 2004), one big integer step a character."""
    if not p and not q:
        return 100.0
    at: dict[str, int] = {}
    for i, c in enumerate(p):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(p)) - 1
    s = full
    for c in q:
        u = s & at.get(c, 0)
        s = (s + u) | (s - u)
    return 200.0 * (~s & full).bit_count() / (len(p) + len(q))


def bits(p: str) -> tuple[int, int, int]:
    """(letters, letters beyond ``TIMES`` of their class, 2-grams) of sorted tokens: the k-th letter of a class sets its k-th bit."""
    seen, letters, beyond, grams = [0] * CLASSES, 0, 0, 0
    for c in p:
        k = ord(c) % CLASSES
        if seen[k] < TIMES:
            letters |= 1 << (TIMES * k + seen[k])
            seen[k] += 1
        else:
            beyond += 1
    padded = f" {p} "
    for a, b in zip(padded, padded[1:], strict=False):
        grams |= 1 << ((ord(a) * 37 + ord(b)) % 128)
    return letters, beyond, grams


def words(values: list[int]) -> np.ndarray:
    """128-bit numbers as two rows of 64 bits."""
    return np.array([[v & (1 << 64) - 1 for v in values], [v >> 64 for v in values]], dtype=np.uint64)


class Lane:
    """Forms with their bit strings, an index of their tokens, and their letters as a matrix."""

    def __init__(self, forms: list[str]) -> None:
        self.tokens = [sorted({*f.split()}) for f in forms]
        plain = [" ".join(t) for t in self.tokens]
        self.lengths = np.array([len(p) for p in plain], dtype=np.int64)
        told = [bits(p) for p in plain]
        self.letters, self.beyond, self.grams = words([t[0] for t in told]), np.array([t[1] for t in told], dtype=np.int64), words([t[2] for t in told])
        self.holding: dict[str, list[int]] = {}
        for i, t in enumerate(self.tokens):
            for token in t:
                self.holding.setdefault(token, []).append(i)
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted(set().union(*plain)))}
        self.codes = np.zeros((WORD, len(forms)), dtype=np.int32)
        for k, p in enumerate(plain):
            if len(p) <= WORD:
                self.codes[: len(p), k] = [self.alphabet[c] for c in p]

    def common(self, tokens: list[str]) -> np.ndarray:
        """Letters of the tokens that each form shares, joined by spaces."""
        out = np.zeros(len(self.tokens), dtype=np.int64)
        for t in tokens:
            if t in self.holding:
                out[self.holding[t]] += len(t) + 1
        return np.maximum(0, out - 1)

    def bound(self, p: str) -> np.ndarray:
        """What ``200 * LCS / lengths`` cannot exceed, whatever the order of the tokens."""
        letters, beyond, grams = bits(p)
        mine, pairs = words([letters]), words([grams])
        shared = np.bitwise_count(self.letters & mine).sum(axis=0, dtype=np.int64) + np.minimum(self.beyond, beyond)
        lost = np.bitwise_count(self.grams ^ pairs).sum(axis=0, dtype=np.int64)
        n = self.lengths + len(p)
        return 200.0 * np.minimum(shared, (n - -(-lost // 3)) // 2) / n

    def subsequences(self, p: str, at: np.ndarray) -> np.ndarray:
        """LCS of ``p`` with the forms ``at``, none longer than ``WORD``, all at a time, bit-parallel."""
        mask = np.zeros(len(self.alphabet) + 1, dtype=np.uint64)
        for i, c in enumerate(p):
            if c in self.alphabet:
                mask[self.alphabet[c]] |= np.uint64(1 << i)
        full = np.uint64((1 << len(p)) - 1)
        s = np.full(len(at), full)
        for row in self.codes[: int(self.lengths[at].max()), at]:
            u = s & mask[row]
            s = (s + u) | (s - u)
        return np.bitwise_count(~s & full).astype(np.int64)

    def best(self, key: str, orders: tuple[np.ndarray, ...], least: float) -> list[tuple[float, int]]:
        """For each of ``orders`` (a form's place among the choices, negative if it is none): (score, form) of the best choice of ``least`` at least, the first on ties; (-1, -1) if there is none."""
        found = [(-1.0, -1)] * len(orders)
        tokens = sorted({*key.split()})
        p = " ".join(tokens)
        if not tokens or not len(self.tokens):
            return found
        common, n = self.common(tokens), self.lengths + len(p)
        inner = self.bound(p)
        # A common part c against either whole side; 100 where it is the side.
        outer = 200.0 * common / np.minimum(common + len(p), common + self.lengths)
        bound = np.where(self.lengths > 0, np.maximum(inner, outer), -1.0)
        usable = np.any([o >= 0 for o in orders], axis=0)
        ranked = np.flatnonzero(usable & (bound >= least))
        ranked = ranked[np.argsort(-bound[ranked], kind="stable")]
        start, size = 0, FIRST
        while start < len(ranked) and bound[ranked[start]] >= max(least, min(s for s, _ in found)):
            at = ranked[start : start + size]
            start, size = start + size, 2 * size
            score = outer[at].copy()
            apart = (common[at] == 0) & (self.lengths[at] <= WORD) & (len(p) <= WORD)
            if apart.any():
                score[apart] = 200.0 * self.subsequences(p, at[apart]) / n[at[apart]]
            # Where tokens are shared, the rests are compared only if they can add to it.
            worst = max(least, min(s for s, _ in found))
            for k in np.flatnonzero(~apart & (inner[at] > score) & (inner[at] >= worst)):
                score[k] = token_set_ratio(tokens, self.tokens[at[k]])
            for j, order in enumerate(orders):
                ok = (order[at] >= 0) & (score >= least)
                if ok.any():
                    top = score[ok].max()
                    tied = at[ok][score[ok] == top]
                    first = int(tied[np.argmin(order[tied])])
                    if top > found[j][0] or top == found[j][0] and order[first] < order[found[j][1]]:
                        found[j] = (float(top), first)
        return found


@F.pandas_udf(T.StringType())
def _folded(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else folded(k))


def library_keys(tracks: DataFrame) -> DataFrame:
    """One file per key, the last by id; ``first_id`` is the key's place among the choices."""
    return tracks.withColumn("key", text.match_key(F.col("title"), F.col("artist"))).groupBy("key").agg(F.max("track_id").alias("track_id"), F.min("track_id").alias("first_id"))


def forms(tracks: DataFrame) -> DataFrame:
    """``form, raw_id, raw_order, bare_id, bare_order``: each distinct key, as written or without diacritics, with what it stands for in either way.

    Of keys that become one without diacritics the later is meant, in the place of the first.
    """
    keys = library_keys(tracks).filter("key <> ''")
    plain = F.col("key").rlike(r"^\p{ASCII}*$")
    keys = keys.withColumn("bare", F.when(plain, F.col("key")).otherwise(_folded(F.when(~plain, F.col("key")))))
    one = F.lit(None).cast("long")
    both = keys.select(F.col("key").alias("form"), F.col("track_id").alias("raw_id"), F.col("first_id").alias("raw_order"), one.alias("bare_id"), one.alias("bare_order")).unionByName(
        keys.groupBy(F.col("bare").alias("form")).agg(one.alias("raw_id"), one.alias("raw_order"), F.max_by("track_id", "first_id").alias("bare_id"), F.min("first_id").alias("bare_order"))
    )
    return both.groupBy("form").agg(*[F.max(c).alias(c) for c in ("raw_id", "raw_order", "bare_id", "bare_order")])


FOUND = "key string, raw double, raw_id long, raw_order long, bare double, bare_id long, bare_order long"


def scored_choices(asked: DataFrame, tracks: DataFrame, least: float = DEFAULT.near_miss) -> DataFrame:
    """``key, raw, raw_id, bare, bare_id``: each song's best choice as written, and without diacritics; null below ``least``. Songs without any are left out.

    A task holds one lane of the library and one block of songs, and returns a
    row a song; no pair that reaches ``least`` is lost. Ties go to the first file.
    """
    lib, keys = forms(tracks), asked.select("key").filter("key <> ''").distinct()
    n_forms = F.broadcast(lib.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / LANE)).cast("int").alias("lanes")))
    n_keys = F.broadcast(keys.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # The joins are with one row.
    dealt = lambda df, x: df.join(n_forms, F.lit(True)).join(n_keys, F.lit(True)).withColumn("h", F.xxhash64(x))
    lanes = dealt(lib, "form").withColumn("lane", F.pmod("h", "lanes").cast("int")).select("lane", every("blocks").alias("block"), *lib.columns)
    blocks = dealt(keys, "key").withColumn("block", F.pmod("h", "blocks").cast("int")).select(every("lanes").alias("lane"), "block", "key")

    def run(lane: pd.DataFrame, songs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(lane) and len(songs):
            held = Lane(list(lane["form"]))
            raw, bare = (lane[c].fillna(-1).to_numpy(np.int64) for c in ("raw_order", "bare_order"))
            ids = {c: lane[c].fillna(-1).to_numpy(np.int64) for c in ("raw_id", "bare_id")}
            for key in songs["key"]:
                bare_key = folded(key)
                if bare_key == key:
                    a, b = held.best(key, (raw, bare), least)
                else:
                    (a,), (b,) = held.best(key, (raw,), least), held.best(bare_key, (bare,), least)
                part = lambda hit, i, order: (hit[0], int(ids[i][hit[1]]), int(order[hit[1]])) if hit[1] >= 0 else (None, None, None)
                if max(a[1], b[1]) >= 0:
                    rows.append((key, *part(a, "raw_id", raw), *part(b, "bare_id", bare)))
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
        return frame.astype({c: "Int64" for c in frame.columns if c.endswith(("_id", "_order"))})

    found = lanes.groupBy("lane", "block").cogroup(blocks.groupBy("lane", "block")).applyInPandas(run, FOUND)
    top = lambda kind: F.max_by(F.struct(kind, f"{kind}_id"), F.when(F.col(kind).isNotNull(), F.struct(kind, -F.col(f"{kind}_order")))).alias(f"_{kind}")
    return found.groupBy("key").agg(top("raw"), top("bare")).select("key", "_raw.*", "_bare.*")


def chosen(scored: DataFrame, least: float) -> DataFrame:
    """``key, track_id, match_score``: the choice as written, else the one without diacritics."""
    raw = F.col("raw") >= least
    return scored.select("key", F.when(raw, F.col("raw_id")).otherwise(F.col("bare_id")).alias("track_id"), F.when(raw, F.col("raw")).otherwise(F.col("bare")).alias("match_score")).filter(F.col("match_score") >= least)


def resolve_fuzzy(lost: DataFrame, tracks: DataFrame, threshold: float = DEFAULT.fuzzy_threshold) -> DataFrame:
    """The best library key of each song by token sets, at ``threshold`` or better; ties go to the first file."""
    return chosen(scored_choices(lost, tracks, threshold), threshold)


def resolution(asked: DataFrame, tracks: DataFrame, threshold: float = DEFAULT.fuzzy_threshold, least: float = DEFAULT.near_miss) -> DataFrame:
    """``key, track_id, match_score, hit`` of every song, from one scored table: what it resolves to, else what comes nearest (null and 0 if nothing reaches ``least``)."""
    scored = asked.select("key").distinct().join(scored_choices(asked, tracks, least), "key", "left")
    pick = F.when(F.col("raw") >= threshold, "raw").when(F.col("bare") >= threshold, "bare").when(F.col("raw") >= least, "raw").when(F.col("bare") >= least, "bare")
    score = F.coalesce(F.when(pick == "raw", F.col("raw")).when(pick == "bare", F.col("bare")), F.lit(0.0))
    return scored.select("key", F.when(pick == "raw", F.col("raw_id")).when(pick == "bare", F.col("bare_id")).alias("track_id"), score.alias("match_score"), (score >= threshold).alias("hit"))


def near_misses(asked: DataFrame, tracks: DataFrame, threshold: float = DEFAULT.fuzzy_threshold, least: float = DEFAULT.near_miss) -> DataFrame:
    """The songs that found nothing, each with what comes nearest to it (null and 0 if nothing does): ``key, track_id, match_score``."""
    return resolution(asked, tracks, threshold, least).filter("not hit").drop("hit")
