"""The index is bounded in memory: small segments, a few of them in a row group."""

import random

import numpy as np
import pyarrow.parquet as pq

from cadenza.llm import postings
from cadenza.llm.common import stored


def test_a_task_holds_a_few_segments(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60))
    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string").coalesce(1)
    index = stored(postings.build_index(docs, 100), 4)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == index.count() == 100 and max(groups) <= 4


def test_a_segment_is_small(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * 2_000) for i in range(60)], "doc_id long, text string").coalesce(1)
    sizes = [len(r["positions"]) for r in postings.build_index(docs).select("positions").collect()]
    assert sum(sizes) == 60 * 10_000 * 4 and max(sizes) <= 4 * (postings.SEGMENT_WORDS + 10_000) <= 512 << 10


def test_words_of_bytes_are_the_words():
    rng = random.Random(2)
    chars = [chr(i) for i in range(0x180)] + [" ", "İ", "漢", "😀", "﻿"] + list("abC 09\n") * 20
    texts = [None, ""] + ["".join(rng.choices(chars, k=rng.randrange(1, 80))) for _ in range(3000)]
    for t in texts:
        assert [w.decode() for w in postings.utf8_words(t and t.encode())] == postings.words(t)


def test_contamination_of_all_kinds_of_text(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["Ünï", "x\x85y", "A1", "b", "漢字", "don't", "c_d", "É"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(80)] + [None, ""]
    items = [(f"i{k}", t) for k, t in enumerate([" ".join(texts[5].split()[:12]), "B", "漢字 b", None, "it's"])]
    got = {r["doc_id"]: r for r in postings.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    for k, text in enumerate(texts):
        w, hit, found = postings.words(text), set(), set()
        for item, t in items:
            b = postings.words(t)
            for g in [b[i : i + 10] for i in range(max(1, len(b) - 9))] if b else []:
                at = [i for i in range(len(w) - len(g) + 1) if w[i : i + len(g)] == g]
                hit |= {j for i in at for j in range(i, i + len(g))}
                found |= {item} if at else set()
        assert (got[k]["n_words"], got[k]["n_hit"], got[k]["n_items"]) == (len(w), len(hit), len(found))
