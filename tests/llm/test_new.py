"""Token counts, whitening and hard negatives against the library, exact fractions and plain loops."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import negatives, queries, tally, whitening
from cadenza.llm.tokens import vocabulary

VECS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


ODD_TEXTS = [
    None, "", "   \n\t ", "It's THE cat's <|endoftext|> we'll", "<|ENDOFTEXT|> <|startoftext|>", "a" * 30_000, "word " * 20_000, "H̱ ẖ É é İ ǅ ﬁ", "שלום עולם 漢字 😀😀", "line\r\nbreak\x0bvertical\x85next\xa0space\x00nul",
    "x" * 65 + " " + "y" * 64, "12345 ²³ ½ ''s !'s 'S 'RE", "don't DON'T", "ẞß ſ K", "a​b c", "|<| < |endoftext|>",
]


def test_counts_are_the_library_s(library):
    count, rng = tally.counter(), random.Random(5)
    chars = [chr(i) for i in range(0x250)] + ["€", "漢", "́", "<|endoftext|>", "Σ", "ς"] + list("ab '\nst") * 20
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rng.choices(chars, k=rng.randrange(1, 60))) for _ in range(4000)] + [" ".join("".join(rng.choices("abcdeéstß'", k=rng.randrange(1, 9))) for _ in range(40)) for _ in range(300)]
    assert [count(t) for t in texts] == [library(t) for t in texts]


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(tally, "REMEMBERED", 8)
    count = tally.counter.__wrapped__()
    texts = ["one two three four five six seven", "eight nine ten eleven", "one twelve thirteen two", " ".join(map(str, range(50))) + " a b c d e f g h i j"]
    assert [count(t) for t in texts] == [library(t) for t in texts]


def counted(df, **more):
    return sorted(map(tuple, tally.count_tokens(df, **more).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)


@pytest.mark.parametrize("few", [0, 100_000])
def test_token_counts(spark, tmp_path, library, few, monkeypatch):
    texts = [*ODD_TEXTS, "The  CAT\n sat", "the cat sat", "the cat sat"]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, "no id", "n", 1), (3, ODD_TEXTS[3], "n", 1)], "doc_id long, text string, n_tokens string, digest int").repartition(3)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := library(r["text"]), n > 2048) for r in docs.collect()), key=repr)
    cache = str(tmp_path / "cache")
    assert counted(docs, cache=cache, few=few) == want
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == len({*(t or "" for t in ODD_TEXTS)} - {"", "   \n\t "}) + 1 + 2  # empty ones alike; the cat and no id
    # A second call appends only what is new, whichever way it goes.
    asked = []
    real = tally.encoded
    monkeypatch.setattr(tally, "encoded", lambda misses, *a: asked.append(misses.count()) or real(misses, *a))
    more = docs.unionByName(spark.createDataFrame([(90, "something new", "n", 1), (91, "SOMETHING new ", "n", 1)], docs.schema))
    assert counted(more, cache=cache, few=few) == sorted([*want, (90, 13, library("something new"), False), (91, 14, library("something new"), False)], key=repr)
    assert counted(docs, cache=cache, few=few) == want
    assert asked == [1]


def test_the_cache_knows_versions_and_twice_appended_rows(spark, tmp_path):
    docs, cache = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), str(tmp_path / "c")
    spark.createDataFrame([(bytearray(b"x"), 9, "older")], tally.CACHE).write.partitionBy("tokenizer").parquet(cache)
    first = counted(docs, cache=cache)
    spark.read.parquet(cache).filter(f"tokenizer = '{tally.version()}'").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert counted(docs, cache=cache) == first == [(1, 7, 2, False)]
    with pytest.raises(ValueError, match="another version"):
        tally.counter.__wrapped__(expected="older")


def test_a_hot_content_keeps_its_rows(spark, library):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same words")).otherwise(F.concat(F.lit("w"), "id")).alias("text"))
    got = tally.count_tokens(docs)
    assert got.count() == 6000
    assert got.filter("doc_id % 3 > 0 and n_tokens = 3").count() == 4000


def test_no_documents(spark):
    assert counted(spark.createDataFrame([], "doc_id long, text string")) == []


def vectors(rng, n, d=6, scale=1.0):
    return [[float(np.float32(rng.gauss(0, scale * (1 + j)))) for j in range(d)] for _ in range(n)]


ODD_VECTORS = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] + [0.0] * 5, 1), (904, [1.0, 2.0], 1)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e25])
def test_whitening_is_exact(spark, scale):
    rng = random.Random(3)
    x = vectors(rng, 300, scale=scale)
    rows = [(i, v, i % 3) for i, v in enumerate(x)] + [(299, x[299], 0), (None, x[5], None)] + ODD_VECTORS
    df = spark.createDataFrame(rows, VECS).withColumn("component", F.lit("clash")).repartition(4)
    good = [(i, v) for i, v, _ in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    ints = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for _, v in good]
    n, sums = len(ints), [sum(c) for c in zip(*ints, strict=True)]
    cov = [[Fraction(sum(a[i] * a[j] for a in ints) * n - sums[i] * sums[j], n * n) for j in range(6)] for i in range(6)]
    e = np.linalg.eigvalsh(np.array(cov, dtype=float))[::-1]
    got = whitening.whiten(df, components=4).collect()
    assert len(got) == 4 * n and {r["n"] for r in got} == {n}
    want = sorted((k, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for (i, _), v in zip(good, ints, strict=True) for k in [-1 if i is None else i])
    told = sorted((-1 if r["vec_id"] is None else r["vec_id"], None if r["deviation"] is None else int(r["deviation"])) for r in got if r["component"] == 1)
    assert told == [(k, dev if dev < 10**38 else None) for k, dev in want]
    for r in got:
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9 and r["identity_error"] < 1e-8
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], [[], [], [], []])[r["component"] - 1].append(r["whitened"])
    # Each component is one direction: its values are the projections up to sign.
    _, q = np.linalg.eigh(np.array(cov, dtype=float))
    for i, v in enumerate(ints[:20]):
        dev = np.array([float(a - Fraction(s, n)) for a, s in zip(v, sums, strict=True)])
        for k in range(4):
            assert abs(abs(by[i][k][0]) - abs(dev @ q[:, ::-1][:, k]) / math.sqrt(e[k])) < 1e-6


def test_products_take_each_way(spark):
    rng = np.random.default_rng(1)
    for most in (10, 1 << 25, 1 << 31, 1 << 62):
        y = rng.integers(-most, most, size=(50, 3))
        exact = [[int(a) for a in row] for row in y]
        sums, cross = whitening.products(y)
        assert sums == [sum(c) for c in zip(*exact, strict=True)]
        assert cross == [[sum(r[i] * r[j] for r in exact) for j in range(3)] for i in range(3)]
    for v in (0, 1, -1, 2**32, -(2**95) - 7, 10**40):
        assert sum(d << 32 * p for p, d in enumerate(whitening.digits(v))) == v


def test_whitening_of_little(spark):
    assert whitening.whiten(spark.createDataFrame([], VECS)).collect() == []
    assert whitening.whiten(spark.createDataFrame(ODD_VECTORS[:4], VECS)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], VECS)).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in one] == [(1, 0.0, 0.0, 1.0, 0), (2, 0.0, 0.0, 1.0, 0)]


def brute_negatives(rows, is_anchor, k=5, m=3):
    best = {}
    sizes = [len(v) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    for i, v, lab in rows:
        if i is None or lab is None or v is None or len(v) != dim or not all(c is not None and math.isfinite(c) for c in v):
            continue
        x = [math.floor(256 * c) for c in v]
        if sum(c * c for c in x) < 2**62:
            best[i] = min(best.get(i, (lab, x)), (lab, x))
    out = []
    for a, (lab, x) in best.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, (other, y) in best.items() if i != a)
        for s, i, _ in [t for t in scores if t[2] == lab][:k]:
            window = [(t, j) for t, j, other in scores if other != lab and 50 * -s <= 100 * -t <= 95 * -s][:m]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(window)]
    return sorted(out)


def mined(df, label="label"):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, F.col(label)).collect()))


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("scale", [0.1, 1e5])
def test_hard_negatives(spark, small, scale, monkeypatch):
    if small:  # several buckets, chunks, lanes, blocks and bands
        for name, value in (("BUCKET", 8), ("CHUNK", 4), ("BLOCK", 8)):
            monkeypatch.setattr(negatives, name, value)
    rng = random.Random(8)
    x = [[c * rng.choice((0.2, 1, 5)) for c in v] for v in vectors(rng, 400, scale=scale)]
    x = [[float(np.float32(c)) for c in v] for v in x]
    rows = [(i, v, rng.choice((0, 0, 0, 1, 2, 7)) if i % 50 else None) for i, v in enumerate(x)]
    rows += [(400 + i, x[3], i % 3) for i in range(60)]  # equal vectors, under all labels
    rows += [(7, x[7], rows[7][2]), (11, x[12], 0), (None, x[1], 0), (905, [0.0] * 6, 0), (910, [1e30] * 6, 0), *ODD_VECTORS]
    df = spark.createDataFrame(rows, VECS).withColumns({"rank": F.lit("clash"), "anchor": F.lit("clash"), "square": F.lit("clash")}).repartition(5)
    want = brute_negatives(rows, lambda a: a % 5 == 0)
    assert len(want) > 300
    assert mined(df) == want


def test_few_negatives(spark):
    assert mined(spark.createDataFrame([], VECS)) == []
    assert mined(spark.createDataFrame([(5, [1.0, 0.0], 1)], VECS)) == []
    assert mined(spark.createDataFrame([(5, [1.0, 0.0], 1), (6, [2.0, 0.0], 1), (7, [1.5, 0.0], 2), (8, [-1.0, 0.0], 2)], VECS)) == [(5, 6, 1, 7, 131072, 98304)]


def test_a_lane_ends_at_its_bound():
    """Buckets beyond the bound are not looked at."""
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(1, 2000, size=(64, 1)), axis=0)[::-1]
    frame = [{"square": float(b[0, 0] ** 2), "ids": np.arange(8 * i, 8 * i + 8).tobytes(), "labels": np.ones(8, np.int64).tobytes(), "x": b.astype(np.int16).tobytes()} for i, b in enumerate(np.split(x, 8))]
    import pandas as pd

    lane = negatives.Lane(pd.DataFrame(frame), np.dtype(np.int16))
    lane.buckets[4:] = [(norm, None, None, None) for norm, *_ in lane.buckets[4:]]  # would fail if they were read
    win, ids, score = lane.best(np.array([[10]]), np.array([-1]), np.array([0]), np.array([0]), np.array([int(x[20, 0]) * 10]), np.array([10**9]), 3, False)
    assert ids.tolist() == [0, 1, 2] and score.tolist() == [int(v) * 10 for v in x[:3, 0]]


def test_new_queries_over_whole_tables(spark, library):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op11_token_counts(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted((i, len((t or "").encode()), n := library(t), n > 2048) for i, t in docs.items())
    e = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, d).collect())) == brute_negatives(e, lambda a: a % 50 == 0)
    white = queries.op12_whitening(spark, d)
    assert white.count() == 8 * len(e) and dict(white.dtypes)["deviation"] == "bigint" and white.first()["identity_error"] < 1e-4
