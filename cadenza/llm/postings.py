"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` gives one row per segment of about ``SEGMENT_WORDS`` training
words: the terms, and for each its sorted positions. A segment holds whole
documents with one unused position between them, so no phrase crosses two. It
is named by its partition and its number there, which is stable once the index
is stored, so equal documents in two segments stay two. Stored, a few segments
lie in a row group, so no more of them are written or read at a time, whatever
a partition holds.
``search`` takes phrases in blocks of bounded size. In each segment a phrase
starts from the list of its rarest term there; every further list, rarest
first, keeps the candidates that it also holds at the term's offset. Segments
are bounded and phrases are checked in bounded chunks, so neither a hot term
nor a hot passage gathers in one task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm.common import released, small_batches, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: The same words in UTF-8: A-Z become a-z, 0-9 and all beyond ASCII stay, the rest is space.
SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words of a segment at least, and segments of a row group at most.
SEGMENT_WORDS, GROUP_ROWS = 100_000, 8
PHRASE = 10
#: Phrases in one block that is sent to all tasks, and candidates that are checked at a time.
BLOCK_PHRASES, CHUNK = 50_000, 1_000_000
INDEX = "segment string, doc_ids array<long>, keys array<binary>, lengths array<int>, terms array<binary>, starts binary, positions binary"
HITS = "segment string, ordinal int, doc_id long, text_key binary, n_words long, spans array<array<int>>, items array<string>"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


def utf8_words(text: bytes | None) -> list[bytes]:
    return text.translate(SPACED).split() if text else []


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of postings over all words of ``docs(doc_id, text)``; a null text has no words."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list = []
        parts: list[np.ndarray] = []
        numbers: defaultdict = defaultdict(count().__next__)
        held, made = 0, count()

        def segment() -> pd.DataFrame:
            lengths = np.array([len(p) for p in parts], dtype=np.int32)
            at = np.arange(held, dtype=np.int32) + np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
            terms = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            order = np.argsort(terms, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(numbers)))]).astype(np.int32)
            name = f"{TaskContext.get().partitionId()}-{next(made)}"
            return pd.DataFrame({"segment": name, "doc_ids": [ids], "keys": [texts], "lengths": [lengths], "terms": [list(numbers)], "starts": [starts.tobytes()], "positions": [at[order].tobytes()]})

        for batch in batches:
            for doc_id, key, text in zip(batch["doc_id"], batch["key"], batch["text"], strict=True):
                found = utf8_words(text)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(key)
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held >= segment_words or len(ids) >= 20_000:
                    yield segment()
                    ids, texts, parts, numbers, held = [], [], [], defaultdict(count().__next__), 0
        if ids:
            yield segment()

    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text_key(text).alias("key"), text.cast("binary").alias("text")).mapInPandas(lambda b: released(segments(b)), INDEX)


def text_key(text) -> Column:
    """A digest of a text; null for null."""
    return F.unhex(F.md5(text))


def windows(items: DataFrame, n: int = PHRASE) -> DataFrame:
    """``item_id, phrase`` for each run of ``n`` words; an item of fewer words is one phrase."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                w = words(text)
                rows += [(item, w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
            yield pd.DataFrame(rows, columns=["item_id", "phrase"])

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInPandas(runs, "item_id string, phrase array<string>")


def matches(starts: np.ndarray, keys: np.ndarray, span: int, phrases: np.ndarray, first: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, first position) of each occurrence; phrases: rows of term numbers, -1 beyond their end.

    With ``slop``, positions of the rarest term that has each other term of its
    phrase at most ``slop`` positions away, in any order, in its own document;
    first: where documents begin.
    """
    sizes = np.diff(starts).astype(np.int64)
    df = np.where(phrases >= 0, sizes[np.maximum(phrases, 0)], np.iinfo(np.int64).max)
    order = np.argsort(df, axis=1, kind="stable")
    rarest = phrases[np.arange(len(phrases)), order[:, 0]]
    n = sizes[rarest]
    total = np.cumsum(n)
    cuts = np.unique([0, *np.searchsorted(total, np.arange(CHUNK, int(n.sum()), CHUNK)), len(n)])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        which = np.repeat(np.arange(lo, hi), n[lo:hi])
        local = np.arange(len(which)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
        at = keys[starts[rarest[which]] + local] - rarest[which].astype(np.int64) * span
        at = at - (0 if slop else order[which, 0])
        for k in range(1, phrases.shape[1]):
            j = order[which, k]
            term = phrases[which, j].astype(np.int64)
            low = high = at + j
            if slop:
                doc = np.searchsorted(first, at, side="right") - 1
                low, high = np.maximum(at - slop, first[doc]), np.minimum(at + slop, first[doc + 1] - 1)
            i = np.minimum(np.searchsorted(keys, term * span + low), len(keys) - 1)
            good = (term < 0) | ((keys[i] >= term * span + low) & (keys[i] <= term * span + high))
            which, at = which[good], at[good]
        yield which, at


def search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Hit spans (start, end in words) and items found: a row per indexed document, and one more for each further block that hits it.

    ``phrases(item_id, phrase)`` are dealt into blocks of at most about
    ``BLOCK_PHRASES``; each block is collected, sent out, and looked up in all
    segments. With ``slop`` a hit is an occurrence of the phrase's rarest term
    with every other term at most ``slop`` words away, in any order, and its
    span is that neighbourhood.
    """
    spark = index.sparkSession
    phrases = stored(phrases)
    n_blocks = max(1, -(-phrases.count() // BLOCK_PHRASES))
    dealt = phrases.withColumn("_block", F.pmod(F.xxhash64("item_id", "phrase"), F.lit(n_blocks)))
    out = None
    for b in range(n_blocks):
        rows = dealt.filter(F.col("_block") == b).select("item_id", "phrase").toArrow()
        sent = spark.sparkContext.broadcast((rows["item_id"].to_pylist(), rows["phrase"].to_pylist()))
        part = index.mapInPandas(lookup(sent, slop, b == 0), HITS)
        out = part if out is None else out.unionByName(part)
    return out


def lookup(sent, slop: int, every: bool):
    """``every``: documents without a hit come out too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, phrases = sent.value
        width = max([1, *map(len, phrases)])
        asked = list(dict.fromkeys(w for p in phrases for w in p))
        number = {w: i for i, w in enumerate(asked)}
        grid = np.full((len(phrases), width), -1, dtype=np.int64)
        for i, p in enumerate(phrases):
            grid[i, : len(p)] = [number[w] for w in p]
        names, sought = np.array(items, dtype=object), pa.array([w.encode() for w in asked], pa.binary())
        for batch in batches:
            for row in batch.itertuples():
                starts, positions = np.frombuffer(row.starts, np.int32), np.frombuffer(row.positions, np.int32)
                lengths = np.asarray(row.lengths, dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(lengths + 1)])
                found: dict[int, tuple[list, set]] = {}
                if len(positions) and len(phrases):
                    span = int(first[-1]) + width + slop + 1
                    keys = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts)) * span + positions
                    here = pc.index_in(sought, value_set=pa.array(list(row.terms), pa.binary()))
                    here = np.append(here.fill_null(-2).to_numpy().astype(np.int64), -1)
                    local = here[grid]
                    some = np.flatnonzero((local != -2).all(axis=1))
                    for which, at in matches(starts, keys, span, local[some], first, slop):
                        doc = np.searchsorted(first, np.maximum(at, 0), side="right") - 1
                        size = (grid[some[which]] >= 0).sum(axis=1)
                        lo = at - first[doc] - slop
                        hi = at - first[doc] + (slop + 1 if slop else size)
                        for d, s, e, name in zip(doc.tolist(), lo.tolist(), hi.tolist(), names[some[which]], strict=True):
                            spans, got = found.setdefault(d, ([], set()))
                            spans.append((max(0, s), min(e, int(lengths[d]))))
                            got.add(name)
                out = []
                for d in range(len(lengths)) if every else sorted(found):
                    spans, got = found.get(d, ((), ()))
                    merged: list[list[int]] = []
                    for s, e in sorted(spans):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([s, e])
                    out.append((row.segment, d, row.doc_ids[d], row.keys[d], int(lengths[d]), merged, sorted(x for x in got if x is not None)))
                yield pd.DataFrame(out, columns=["segment", "ordinal", "doc_id", "text_key", "n_words", "spans", "items"]).astype({"doc_id": "Int64"})

    return lambda batches: released(run(batches))


def contamination(docs: DataFrame, items: DataFrame, n: int = PHRASE) -> DataFrame:
    """Per row of ``docs``: words, words inside an occurrence of a window of ``items``, and which items.

    Null and empty texts have no words and are clean; repeated documents and
    documents without an id count each for itself, repeated items once by id;
    an empty benchmark leaves all clean. Other columns of ``docs`` play no part
    and are not returned. ``text_key`` tells texts of one ``doc_id`` apart.
    """
    index = stored(build_index(docs), GROUP_ROWS)
    found = search(index, windows(items, n))
    # Spans of several blocks may overlap, so they are merged once more.
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s[1] - F.greatest(s[0], acc["end"]))).alias("n"), F.greatest(acc["end"], s[1]).alias("end")
        ),
        lambda acc: acc["n"],
    )
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    return (
        found.groupBy("segment", "ordinal", "doc_id", "text_key", "n_words")
        .agg(merged.alias("n_hit"), names.alias("items"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_key",
        )
    )
