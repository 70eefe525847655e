"""Corpus operators on small fixtures against brute force, with odd rows and empty tables."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cadenza.llm import forest, language, lines, masked, order, packing, pathjoin, pii, postings, queries, shards
from cadenza.llm.tokens import encoder, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = [
    "the cat and the dog went over the hill with a big stone in the rain today",
    "der Hund und die Katze gehen nicht über den Berg mit einem großen Stein heute",
    "le chien et le chat vont sur la colline avec une grande pierre sous la pluie",
    "el perro y el gato van por la colina con una piedra grande bajo la lluvia",
]
LANGS = ["en", "de", "fr", "es"]


def rows():
    rng = random.Random(4)
    out = []
    for i in range(160):
        words = PROSE[i % 4].split() * 6
        rng.shuffle(words)
        out.append((i, " ".join(words), LANGS[i % 4], "s0", 1))
    out += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "123 456 !!", None, "s1", 1), (203, out[0][1], "en", "s0", 1), (204, out[0][1] + " end", "en", "s0", 1), (205, "word", "en", "s1", 1)]
    out += [(203, out[0][1], "en", "s0", 1)]  # a repeated row
    out += [(206, out[8][1].replace(" ", "\n", 3) + " x" * 20000, "en", "s2", 1)]  # a long one
    block = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    out += [(207, "start one\n" + block + "\nend one", "en", "s3", 1), (208, "begin two\n\n" + block + "\nlast two", "en", "s3", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5).withColumns({"shard": F.lit("clash"), "score": F.lit("clash"), "n_lines": F.lit("clash"), "rank": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens_agree():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), random.Random(1)
    chars = [chr(i) for i in range(0x250)] + ["€", "漢", " ", "<|endoftext|>"] + list("ab 1'\n") * 30
    for _ in range(1500):
        s = "".join(rng.choice(chars) for _ in range(rng.randint(0, 25)))
        assert encoder()(s).tolist() == whole.encode(s, add_special_tokens=False).ids


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        slots = order.feistel(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
    assert order.feistel(np.arange(1000), 1000, 1).tolist() != order.feistel(np.arange(1000), 1000, 2).tolist()


def test_training_order(spark, docs, empty, tmp_path):
    few = docs.select("doc_id", "text").coalesce(3)
    cut = [(r["part"], r["k"], r["n_ids"], r["first_doc"], zstandard.decompress(r["payload"])) for r in order.sequences(few, 64).collect()]
    cut.sort(key=lambda r: r[:2])
    slots = order.feistel(np.arange(len(cut)), len(cut))
    path = f"file://{tmp_path}/x"
    got = {r["slot"]: r for r in order.write_shards(order.in_training_order(few, length=64, per_shard=16), path).collect()}
    assert sorted(got) == list(range(len(cut))) and len(cut) > 30
    # Slot by slot: the row, and the record of the file at the slot's place.
    for number, (_, _, n_ids, first_doc, record) in enumerate(cut):
        r = got[int(slots[number])]
        assert (r["sequence"], r["n_ids"], r["first_doc"], r["ids_crc32"]) == (number, n_ids, first_doc, zlib.crc32(record))
        assert (r["shard"], r["byte_offset"]) == (r["slot"] // 16, r["slot"] % 16 * 128)
        assert order.read_from(path, r["slot"], 1, 64, 16)[0].tobytes() == record
    assert order.read_from(path, 10, 20, 64, 16).shape == (20, 64)
    # The streams of the tasks, whole.
    ids = [i for _, _, n, _, record in cut for i in np.frombuffer(record, "<u2")[:n].tolist()]
    want = [i for r in rows() for i in [*encoder()(r[1] or "").tolist(), order.END_ID]]
    assert sorted(ids) == sorted(want)
    # A run again writes the same bytes.
    again = order.write_shards(order.in_training_order(few, length=64, per_shard=16), path)
    assert {r["slot"]: r["ids_crc32"] for r in again.collect()} == {k: r["ids_crc32"] for k, r in got.items()}
    assert order.materialise(empty).count() == 0


def plain_log_prob(net, ids):
    """The network by loops over positions, classes and places."""
    p, v, out = masked.shaped(net.weights.astype(np.float64)), net.vocabulary, 0.0
    places = [masked.PLACES] * masked.SIDE + [int(v.place[i]) for i in ids] + [masked.PLACES] * masked.SIDE
    for t, i in enumerate(ids):
        at = t + masked.SIDE
        x = [float(e) for o in (-2, -1, 1, 2) for e in p["e"][places[at + o]]]
        h = [np.tanh(sum(x[a] * p["w"][a, j] for a in range(len(x))) + p["b"][j]) for j in range(masked.HIDDEN)]
        top = [sum(h[j] * p["c"][j, k] for j in range(masked.HIDDEN)) + p["cb"][k] for k in range(masked.CLASSES)]
        cls, place = places[at] % masked.CLASSES, places[at] // masked.CLASSES
        inner = [sum(h[j] * p["k"][cls, j, m] for j in range(masked.HIDDEN)) + p["kb"][cls, m] for m in range(masked.IN_CLASS)]
        out += top[cls] - np.log(np.sum(np.exp(top))) + inner[place] - np.log(np.sum(np.exp(inner))) + v.share[i]
    return out


def test_masked_network(spark, docs, empty):
    rare = " ".join(f"z{i} " * (1 + i % 5) for i in range(4000))
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(300, rare), (301, "z7 z9 the cat qqq")], "doc_id long, text string"))
    net = masked.train(every)
    v, p = net.vocabulary, masked.shaped(net.weights)
    counts = collections.Counter(w for r in every.collect() for w in masked.words(r["text"]))
    ordered = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert v.listed == [w for w, _ in ordered] and len(v.listed) > masked.OWN
    # Conditional probabilities of all words, of words that the corpus lacks and of the padding sum to one.
    near = np.tile(np.array([[1, 2, 3, 4]], dtype=np.uint16), (masked.PLACES + 1, 1))
    lp, by, *_ = masked.forward(p, np.arange(masked.PLACES + 1, dtype=np.uint16), near)
    place = np.empty(masked.PLACES + 1)
    place[by] = np.exp(lp.astype(np.float64))
    assert sum(place[v.place] * np.exp(v.share)) + place[masked.PLACES] == pytest.approx(1, abs=1e-3)
    got = {r["doc_id"]: r for r in masked.score(every, net).collect()}
    for d, text in ((5, rows()[5][1]), (301, "z7 z9 the cat qqq"), (205, "word")):
        ids = v.numbers(text)
        assert got[d]["log_prob"] == pytest.approx(plain_log_prob(net, ids), rel=1e-4) and got[d]["n_words"] == len(ids)
    assert got[200]["n_words"] == 0 and got[200]["log_prob"] == 0 and got[200]["mean_log_prob"] is None
    ids = [v.numbers(r["text"]) for r in every.collect()]
    before = masked.Network(v, masked.flat(masked.start(v.counts)))
    assert net.log_probabilities(ids).mean() > before.log_probabilities(ids).mean()
    assert masked.score(empty, masked.train(empty)).count() == 0


def test_vocabulary_beyond_its_list():
    # Words that are not listed share what is left of their place alike.
    counts = {f"w{i}".encode(): 10_000 - i for i in range(masked.OWN)} | {f"r{i}".encode(): 1 + i % 9 for i in range(3000)}
    ordered = sorted(counts, key=lambda w: (-counts[w], w))
    totals, kinds = np.zeros((2, masked.SHARED))
    for w, n in counts.items():
        totals[zlib.crc32(w) % masked.SHARED] += n
        kinds[zlib.crc32(w) % masked.SHARED] += 1
    listed = ordered[: masked.OWN + 1000]
    v = masked.Vocabulary(listed, np.array([counts[w] for w in listed], dtype=float), totals, kinds)
    share = np.zeros(masked.PLACES)
    for w in counts:
        n = v.number[w]
        share[v.place[n]] += np.exp(v.share[n])
    unknown = np.exp(v.share[len(listed) :])
    assert share[: masked.OWN] == pytest.approx(1) and share[masked.OWN :] + unknown == pytest.approx(1)
    assert len(v.number) == len(listed)


def test_masked_gradient():
    rng = np.random.default_rng(0)
    p = masked.start(np.ones(masked.PLACES + 1))
    word, near = rng.integers(0, 50, 300).astype(np.uint16), rng.integers(0, 50, (300, 4)).astype(np.uint16)
    loss = lambda q: -float(masked.forward(q, word, near)[0].mean())
    rate, moved = 1.0, {k: x.copy() for k, x in p.items()}
    masked.step(moved, word, near, rate)
    for name in ("w", "b", "c", "cb"):
        gradient = (p[name] - moved[name]).astype(np.float64) / rate
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        up, down = ({k: x.astype(np.float64) for k, x in p.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert gradient[at] == pytest.approx((loss(up) - loss(down)) / 2e-3, rel=0.05)


def test_language(docs, empty):
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    truth = {r[0]: r[2] for r in rows()[:160]}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.95 and all(got[d]["held_out"] for d in held)
    assert [got[d]["lang_pred"] for d in (200, 201, 202)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(empty).count() == 0


def test_language_of_letterless_labels(spark):
    # A language whose labelled texts hold no letter is not learned; ids may be null or equal.
    data = [(None, t, lang, None, None) for t, lang in zip(PROSE * 5, LANGS * 5, strict=True)] + [(7, "12 ½ 34", "xx", None, None)] * 30
    got = language.identify(spark.createDataFrame(data, DOCS)).collect()
    assert {r["lang_pred"] for r in got} == {*LANGS, "und"} and sum(r["lang_pred"] == "und" for r in got) == 30


def test_more_languages_than_families_know(spark):
    # Seventy languages, each of words from its own few letters.
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(70)
    own = {f"q{i:02d}": rng.sample(letters, 4) for i in range(70)}
    word = lambda lang: "".join(rng.choice(own[lang]) for _ in range(5))
    data = [(None, " ".join(word(x) for _ in range(40)), x, None, None) for x in own for _ in range(4)]
    df = spark.createDataFrame(data, DOCS)
    got = language.predict(df, language.fit(df)).select("lang", "lang_pred").collect()
    assert {r["lang_pred"] for r in got} == set(own) and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_votes_and_scores_like_loops(docs):
    model = language.fit(docs.filter("doc_id < 160"))
    # Machines of one level and of two: a family of one language, and one of two.
    assert {m[0] for m in model.names} == {"", "germanic", "romance"}
    texts = [r[1] for r in rows()]
    langs, scores = model.predict(texts)

    def margin(j, text):
        # A text stands between two blanks before it and four after it.
        data = b"  " + text.lower().encode().translate(language.BLANK) + b"    "
        total = 0.0
        for k in range(len(data) - 2):
            h = (data[k] * 0x9E3779B1 ^ data[k + 1] * 0x85EBCA77 ^ data[k + 2] * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 19
            total += float(model.weights[j][h])
        return total / (len(data) - 2) + model.biases[j]

    def level(text, at, classes):
        chances = {(a, b): 1 / (1 + math.exp(-max(-50, min(50, 2 * margin(j, text))))) for j, (x, a, b) in enumerate(model.names) if x == at}
        votes, sure = dict.fromkeys(classes, 0.0), dict.fromkeys(classes, 1.0)
        for (a, b), p in chances.items():
            for one, q, won in ((a, p, p >= 0.5), (b, 1 - p, p < 0.5)):
                votes[one] += won + q / 1000
                sure[one] = min(sure[one], q)
        best = max(classes, key=lambda c: votes[c])
        return best, sure[best]

    for text, lang, score in list(zip(texts, langs, scores, strict=True))[::7] + [(t, x, s) for t, x, s in zip(texts, langs, scores, strict=True) if not t or len(t) < 20]:
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0)
            continue
        top, first = level(text, "", sorted({language.family(x) for x in model.langs}))
        best, second = level(text, top, sorted(x for x in model.langs if language.family(x) == top))
        assert lang == best and score == pytest.approx(first * second, abs=1e-4)


def test_machine_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 12)) * (rng.random((60, 12)) < 0.5)
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(60) > 0, 1, -1)
    rows = [(np.flatnonzero(r).astype(np.int32), r[np.flatnonzero(r)]) for r in x]
    w, bias = language.fit_machine(rows, y, 12, epochs=2000)
    most = np.where(y > 0, 30 / (y > 0).sum(), 30 / (y < 0).sum())
    loss = lambda v, b: 0.5 * (v @ v + b * b) + (most * np.maximum(0, 1 - y * (x @ v + b))).sum()
    # No direction lowers the (convex) loss by more than the tolerance.
    least = min(loss(w + 1e-2 * d[:12], bias + 1e-2 * d[12]) for d in rng.standard_normal((3000, 13)))
    assert loss(w, bias) < least + 1e-3


def test_prediction_runs_once(docs):
    told = language.predict(docs, language.fit(docs)).filter(F.col("lang_pred") != "und").select("doc_id")
    assert told._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def brute_hits(text, items, n=10):
    w, hit, found = postings.words(text), set(), set()
    for item, t in items:
        b = postings.words(t)
        for g in [b[i : i + n] for i in range(max(1, len(b) - n + 1))] if b else []:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
    return len(w), len(hit), len(found)


def test_contamination(spark, docs, empty, monkeypatch):
    items = [(1, " ".join(rows()[3][1].split()[5:20])), (2, "the cat"), (3, None), (4, ""), (5, "Word"), (1, "zz yy")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    truth = sorted((r[0], *brute_hits(r[1], items)) for r in rows())
    for block in (50_000, 2):
        monkeypatch.setattr(postings, "BLOCK_PHRASES", block)
        got = postings.contamination(docs, bench).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got) == truth
    assert postings.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in postings.contamination(docs, bench.limit(0)).collect())


def test_contamination_of_equal_and_nameless_rows(spark):
    data = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z w"), (2, "x y z w"), (2, "clean words here"), (None, None)]
    parts = [spark.createDataFrame([r], "doc_id long, text string").coalesce(1) for r in data]
    df = functools.reduce(lambda a, b: a.unionByName(b), parts)
    bench = spark.createDataFrame([("i", "a b"), ("j", "y z w")], "item_id string, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["contaminated"]) for r in postings.contamination(df, bench).collect())
    assert got == sorted([("1", 4, 2, True)] * 2 + [("None", 4, 2, True), ("None", 4, 3, True), ("2", 4, 3, True), ("2", 3, 0, False), ("None", 0, 0, False)])


@pytest.mark.parametrize("slop", [1, 3])
def test_proximity(spark, slop):
    rng = random.Random(slop)
    data = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    phrases = [(str(i), rng.sample("abcdefgh", rng.randint(1, 3))) for i in range(25)]
    index = postings.build_index(spark.createDataFrame(data, "doc_id long, text string").repartition(1), 200)
    found = postings.search(index, spark.createDataFrame(phrases, "item_id string, phrase array<string>"), slop).collect()
    segments = {}
    for r in found:
        segments.setdefault(r["segment"], []).append(r)
    texts = dict(data)
    for held in segments.values():
        count = collections.Counter(w for r in held for w in texts[r["doc_id"]].split())
        for r in held:
            w, want = texts[r["doc_id"]].split(), {}
            for item, phrase in phrases:
                if all(count[t] for t in phrase):
                    rarest = min(phrase, key=lambda t: (count[t], phrase.index(t)))
                    at = [i for i, x in enumerate(w) if x == rarest and all(t in w[max(0, i - slop) : i + slop + 1] for t in phrase)]
                    if at:
                        want[item] = at
            covered = {i for s, e in r["spans"] for i in range(s, e)}
            near = {j for at in want.values() for i in at for j in range(max(0, i - slop), min(len(w), i + slop + 1))}
            assert r["items"] == sorted(want) and covered == near


def brute_components(texts, n, threshold=0.8):
    sets = {}
    for d, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(postings.LOWER)) if x]
        sets[d] = {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 100 * threshold * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("full", [pathjoin.FULL, 8])
@pytest.mark.parametrize("node", [512, 4])
def test_near_duplicates(spark, docs, empty, monkeypatch, node, full):
    monkeypatch.setattr(pathjoin, "FULL", full)
    monkeypatch.setattr(pathjoin, "NODE", node)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    many = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(120)] = f"u{rng.randrange(999)}"
        many.append((1000 + i, " ".join(w), "en", "s", 1))
    every = docs.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")).unionByName(spark.createDataFrame(many, DOCS))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in pathjoin.near_duplicates(every, 2).collect()}
    assert got == brute_components([(r[0], r[1]) for r in rows() + many], 2)
    if node == 512:
        assert pathjoin.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("depth", "least"), [(3, 0.995), (6, 0.99), (9, 0.97)])
def test_trees_meet_pairs_at_the_threshold(depth, least):
    rng, seeds, met, pairs = np.random.default_rng(depth), pathjoin.coefficients(), 0, 300
    for _ in range(pairs):
        x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        sig = np.stack([pathjoin.minwise(s, seeds) for s in (x[:180], x[20:])])  # 160 of 200 shared
        held = [set(), set()]
        for t in range(pathjoin.TREES):
            start = pathjoin.mix(np.full(2, 1000 + t, dtype=np.uint64)) & np.uint64(pathjoin.MASK ^ pathjoin.TREE) | np.uint64(t)
            for row, node in zip(*pathjoin.paths(sig, start, depth), strict=True):
                held[row].add(int(node))
        met += not held[0].isdisjoint(held[1])
    print(depth, met / pairs)
    assert met / pairs >= least


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(3)
    held = [np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in (0, 1, 5, 40, 80, 200)]
    want = [[len(np.intersect1d(x, y)) if i != j else None for j, y in enumerate(held)] for i, x in enumerate(held)]
    for columns in (7, 4096):
        monkeypatch.setattr(pathjoin, "COLUMNS", columns)
        got = pathjoin.overlaps(held)
        assert all(got[i][j] == want[i][j] for i in range(6) for j in range(6) if i != j)


def test_cut_nodes_meet_in_bounded_parts(spark):
    # Documents of a template: nearly all of them components of their own, in blocks of one cut node.
    n, blocks = 20_000, 40
    told = spark.range(n).selectExpr(f"id % {blocks} as node", "7L as whole", "id as rep", "if(id < 2000, 0L, id) as comp")
    sizes = [r["count"] for r in pathjoin.met_blocks(told).groupBy("node").count().collect()]
    assert max(sizes) <= 2 * pathjoin.NODE
    few = told.filter("rep % 10 = 0")
    met = pathjoin.met_blocks(few).select("node", "rep", "comp").distinct()
    pairs = met.join(met.toDF("node", "other", "c"), "node").filter("rep < other and comp <> c").select("rep", "other")
    assert pairs.distinct().count() == 2000 * 1999 // 2 - 200 * 199 // 2


def test_template_texts(spark, monkeypatch):
    # Distinct texts of similarity 0.7 to each other, and two pairs of 0.8 and more between them.
    monkeypatch.setattr(pathjoin, "NODE", 16)
    common = " ".join(f"t{i}" for i in range(200))
    texts = [common + "".join(f" o{d}x{i}" for i in range(43)) for d in range(240)]
    texts += [texts[3] + " more", texts[200] + " other"]
    widths, whole = [], pathjoin.met_blocks

    def watched(told):
        widths.append(whole(told).groupBy("node").count().agg({"count": "max"}).first()[0])
        return whole(told)

    monkeypatch.setattr(pathjoin, "met_blocks", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in pathjoin.near_duplicates(docs, 2).collect()}
    assert got == brute_components(list(enumerate(texts)), 2)
    assert widths and widths[0] <= 4 * pathjoin.NODE < 240 // 2


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["v"]: r["comp"] for r in pathjoin.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_lines(spark, docs, empty):
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[207]["n_dropped"] == 0 and got[208]["n_dropped"] == 4 and got[208]["text"] == "begin two\n\nlast two"
    assert got[200]["text"] is None and got[200]["n_lines"] == 0 and got[201]["n_lines"] == 1
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.sql(lines.LINES_SQL).fetchall()
    have = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(docs).collect()]
    assert sorted(map(str, have)) == sorted(map(str, want))
    assert lines.dedup_lines(empty).count() == 0
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_helper_columns_do_not_clash(docs):
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("key", "Dropped", "_key", "_bucket", "_first", "__key", "c", "i", "g", "pos")})
    names = [c for c in odd.columns if c not in ("n_lines", "shard")]
    got = lines.dedup_lines(odd)
    plain = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in lines.dedup_lines(docs.select("doc_id", "text")).collect()}
    rows_ = got.collect()
    assert set(names) < set(got.columns) and all(r[c] == f"{c}{r['doc_id']}" for r in rows_ for c in ("key", "Dropped", "_key", "c"))
    assert {r["doc_id"]: (r["n_dropped"], r["text"]) for r in rows_} == plain
    mixed = shards.shuffle(odd, bucket_bytes=4000)
    assert all(r[c] == f"{c}{r['doc_id']}" for r in mixed.collect() for c in ("key", "Dropped", "_key", "_bucket", "_first", "__key"))
    place = lambda df: sorted(map(str, df.select("doc_id", "shard", "slot").collect()))
    assert place(mixed) == place(shards.shuffle(docs.select("doc_id", "text"), bucket_bytes=4000))


def test_lines_of_a_longer_earlier_run(spark):
    # The first document holds only the middle of a passage that the second one has whole.
    said = [" ".join(f"p{i}x{j}" for j in range(10)) for i in range(6)]
    for turn in range(12):
        passage = [f"{x} v{turn}" for x in said]
        texts = [(1, "\n".join(["one first", *passage[2:5], "one last"])), (2, "\n".join(["two first", *passage, "two last"])), (3, "\n".join(["three first", *passage, "three last"]))]
        got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        assert got[3] == "three first\nthree last" and got[1] == texts[0][1]


def test_lines_of_long_documents(spark):
    # A document of many lines repeated whole: work in proportion to its lines.
    said = "\n".join(f"w{i} x{i % 7} y{i * 31 % 1009} z" for i in range(30_000))
    docs = spark.createDataFrame([(1, said), (2, "before it\n" + said + "\nafter it")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[1]["n_dropped"] == 0 and got[2]["n_dropped"] == 30_000 and got[2]["text"] == "before it\nafter it"


def test_lines_of_shared_passages(spark):
    rng = random.Random(11)
    passages = ["\n".join(" ".join(f"p{k}w{i}x{j}" for j in range(rng.randint(1, 14))) for i in range(rng.randint(3, 12))) for k in range(6)]
    data = []
    for d in range(60):
        pieces = [rng.choice(passages).split("\n") if rng.random() < 0.7 else [f"own {d} {i}" for i in range(3)] for _ in range(4)]
        cut = [p[rng.randint(0, 2) : len(p) - rng.randint(0, 2)] for p in pieces]
        data.append((d if d % 9 else None, "\n".join(x for p in cut for x in p) if d % 11 else None))
    df = spark.createDataFrame(data, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(map(str, con.sql(lines.LINES_SQL).fetchall()))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(df).collect()]
    assert sorted(map(str, got)) == want and sum(r[2] for r in got) > 100


def exact_nearest(x, q, k):
    s = x @ x[q]
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k].tolist(), s


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_nearest(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24))
    if kind == "clustered":
        x = rng.standard_normal((100, 24))[rng.integers(0, 100, 3000)] + 0.2 * x
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[7] = x[9] = x[20]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] * 24), (5004, [1.0]), (5005, [float("inf")] * 24), (7, x[7].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = forest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"], r["scored"]))
    recall, scored = [], []
    for q in range(0, 3000, 20):
        want, s = exact_nearest(x, q, 20)
        have = [v for _, v, _, _ in sorted(by[q])]
        assert [n for n, *_ in sorted(by[q])] == list(range(1, 21)) and all(abs(sc - x[v] @ x[q]) < 1e-9 for _, v, sc, _ in by[q])
        assert have == sorted(have, key=lambda v: (-by_score[v], v)) if (by_score := {v: sc for _, v, sc, _ in by[q]}) else True
        recall.append(len(set(have) & set(want)) / 20)
        scored.append(by[q][0][3] / 3000)
    print(kind, np.mean(recall), np.mean(scored))
    assert np.mean(recall) >= 0.9 and by[20][0][1:3][0] == 7 and by[20][1][1] == 9
    if kind == "clustered":
        assert np.mean(scored) < 0.2
    few = spark.createDataFrame(data[:3], "vec_id long, embedding array<double>")
    assert forest.nearest(few, F.col("vec_id") == 0).count() == 2
    assert forest.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_exactly(spark):
    x = np.random.default_rng(5).standard_normal((400, 16)) * np.arange(1, 401)[:, None] ** 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = forest.nearest(df, F.col("vec_id") % 40 == 0, k=5, recall=1.0).collect()
    for q in range(0, 400, 40):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == exact_nearest(x, q, 5)[0]


def test_shards(spark, docs, empty):
    got = shards.shuffle(docs, bucket_bytes=4000)
    counts = {}
    for r in got.select("shard", "slot", "doc_id").collect():
        counts.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(v) for v in counts.values()]
    assert sum(sizes) == len(rows()) and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in counts.values())
    again = shards.shuffle(docs.repartition(3), bucket_bytes=4000)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "shard", "slot").fillna(-1).collect()))
    assert key(got) == key(again)
    assert shards.shuffle(empty).count() == 0
    # The scatter and the shuffle of each bucket, replayed.
    n_buckets = -(-sum(len((r[1] or "").encode()) + 1 for r in rows()) // 4000)
    hashed = docs.withColumn("k", F.xxhash64(F.lit(shards.SEED), "doc_id", "text")).withColumn("b", F.pmod(F.xxhash64(F.lit(shards.SEED + 1), "k"), F.lit(n_buckets)))
    buckets = {}
    for r in hashed.select("doc_id", "k", "b").collect():
        buckets.setdefault(r["b"], []).append((r["k"], r["doc_id"]))
    line = []
    for b in sorted(buckets):
        held = [d for _, d in sorted(buckets[b], key=lambda x: x[0])]
        places = np.random.default_rng([shards.SEED, b]).permutation(len(held))
        line += [held[i] for i in places]
    n = len(line)
    cuts = [n * k // 8 for k in range(9)]
    want = {(d, k, i - cuts[k]) for k in range(8) for i, d in enumerate(line) if cuts[k] <= i < cuts[k + 1]}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got.select("doc_id", "shard", "slot").collect()} == want


def test_personal_data_base_is_the_pattern():
    rng = random.Random(2)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    for _ in range(5000):
        t = "".join(rng.choice("a@@..0194 -+()b") for _ in range(rng.randint(0, 40)))
        want = [(m.start(), k, m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if good(k, m[0])]
        assert sorted(pii.detect(t)) == sorted(want)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john [at] example [dot] com now", ["john [at] example [dot] com"]),
        ("write to john at example dot com", ["john at example dot com"]),
        ("jоhn@example.com", ["jоhn@example.com"]),
        ("call plus four nine one five one two three four five six seven", ["plus four nine one five one two three four five six seven"]),
        ("４１１１ １１１１ １１１１ １１１１", ["４１１１ １１１１ １１１１ １１１１"]),
        ("look at this. No dot here at all, one two three.", []),
        (None, []),
        ("", []),
    ],
)
def test_disguises(text, found):
    assert [text[s:e] for s, _, e in pii.spans(text)[1]] == found


@pytest.mark.parametrize("word", sorted(pii.DIGITS))
def test_each_number_word(word):
    said = " ".join(["plus"] + [word] * 10)
    assert [said[s:e] for s, _, e in pii.spans(said)[1]] == [said]


def test_number_words_and_brackets_alone():
    forms = ["plus four four seven eight nine six four seven eight six"]
    forms += [f"john{gap}{o}{pad}{at}{pad}{c}{gap}example.com" for o, c in ("[]", "()", "{}", "<>") for at in ("at", "arroba", "@") for pad in ("", " ", "\t") for gap in ("", " ")]
    forms += [f"john@example{o}{pad}{dot}{pad}{c}com" for o, c in ("[]", "()", "{}", "<>") for dot in ("dot", "punkt", "punto", "point", ".") for pad in ("", " ", "\n")]
    forms += ["john at example\tdot\tcom", "john at example\ndot\ncom"]
    for form in forms:
        assert [form[s:e] for s, _, e in pii.spans(form)[1]] == [form], form


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        return {"email": True, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_personal_data(spark, docs, empty):
    assert pii.personal_data(docs).count() == len(rows()) and pii.personal_data(empty).count() == 0
    rng = random.Random(6)
    bits = ["a.b@c.org", "x@y", "10.2.3.4", "1.2.3.400", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 20 7946 0958", "+1 (2)", "word", "at", "dot", "12", "ünï", "\U0001f600", "[at]"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, ""]
    got = pii.personal_data(spark.createDataFrame([(None if i % 50 == 7 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        if i % 50 != 7:
            want, r = plain_spans(t), by[i]
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
            every = r["spans"].split(",") if r["spans"] else []
            assert set(want) <= set(every) and len(every) == r["n_spans"] == len(want) + r["n_added"]


def test_personal_data_in_linear_time():
    def seconds(make, n):
        text, began = make(n), time.process_time()
        pii.spans(text)
        return time.process_time() - began

    forms = [lambda n: "x dot y " + "a" * n, lambda n: "x (at y" + " " * n, lambda n: "a dot " * (n // 6), lambda n: "x at y " * (n // 7), lambda n: "one " * (n // 4), lambda n: "[ " * (n // 2) + " dot ", lambda n: "@" * n, lambda n: "1" * n]
    for make in forms:
        small = min(seconds(make, 50_000) for _ in range(2))
        assert seconds(make, 400_000) < 25 * max(small, 0.02)


def test_pack(docs, empty):
    got = packing.pack(docs).collect()
    encode = encoder()
    truth = {r[0]: np.append(encode(r[1] or ""), 1).astype("<u4") for r in rows()}
    seen, seqs = {}, {}
    for r in got:
        ids = truth[r["doc_id"]]
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(n % len(truth[d]) == 0 for d, n in seen.items()) and seen[203] == 2 * len(truth[203])
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(empty).count() == 0
    # The sequences are those of the plan over the histogram of bins.
    bins = collections.Counter(-(-r["length"] // packing.UNIT) for r in got)
    planned = collections.Counter()
    for need, n in packing.plan(dict(bins), packing.WINDOW // packing.UNIT):
        planned[tuple(sorted(need.items()))] += n
    made = collections.Counter(tuple(sorted(collections.Counter(-(-n // packing.UNIT) for _, n in parts).items())) for parts in seqs.values())
    assert made == planned


def test_least_squares():
    rng = np.random.default_rng(3)
    a, b = rng.random((8, 20)), rng.random(8)
    x = packing.nonneg_lsq(a, b, 20_000)
    gradient = a.T @ (a @ x - b)
    # The conditions of the optimum: no slope below 0, and none where x is above 0.
    assert (x >= 0).all() and gradient.min() > -1e-6 and np.abs(gradient[x > 1e-9]).max() < 1e-6


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(0)
    h = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 257, 20000), return_counts=True), strict=True)}
    used, windows = {}, 0
    for need, n in packing.plan(h, 256):
        assert sum(b * m for b, m in need.items()) <= 256
        windows += n
        for b, m in need.items():
            used[b] = used.get(b, 0) + n * m
    assert used == h and sum(b * n for b, n in h.items()) / 256 / windows > 0.98


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, d).cache()
        after = {r["doc_id"]: r for r in docs.collect()} if name != "pack" else {}
        if name == "language_id":
            assert set(after) == {r["doc_id"] for r in before if r["text"] and re.search(r"[^\W\d_]", r["text"])}
        if name == "near_dedup":
            comp = brute_components([(r["doc_id"], r["text"]) for r in before], 5)
            assert set(after) == {k for k, (_, c) in comp.items() if k == c}
        if name == "decontaminate":
            assert set(after) == {r["doc_id"] for r in before if brute_hits(r["text"], items)[1] == 0}
        if name != "pack":
            assert len(docs.columns) == 5
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(r["doc_id"] for r in before)


ODD = [(None, "the cat sat on the mat by the door of the house today", "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0), (3, "the dog ran over the hill and into the wide open field", "en", "s", 1), (3, "the dog ran over the hill and into the wide open field", "en", "s", 1)]


def test_pipeline_of_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    words = postings.words(spark.read.parquet(f"{d}/benchmark.parquet").first()["text"])
    bad = (None, " ".join(words[:12]), "en", "s", 1)
    clash = lambda rows: spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit(1), "kept": F.lit(2), "n_lines": F.lit(3), "rank": F.lit(4)})
    for data in (ODD, []):
        docs = clash(data)
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs, d)
            assert out.count() <= 2 * len(data) + 1
            docs = out if set(docs.columns) == set(out.columns) else docs
        assert set(pipeline.STAGES[0][1](spark, clash(data), d).columns) == set(clash(data).columns)
    # A contaminated row without an id goes; a clean one that shares an id with a hit row stays.
    rows_ = [bad, (8, bad[1], "en", "s", 1), (8, "clean and different words", "en", "s", 1), (None, "also clean", "en", "s", 1)]
    left = sorted(r["text"] for r in pipeline.decontaminate(spark, spark.createDataFrame(rows_, DOCS), d).collect())
    assert left == ["also clean", "clean and different words"]
    left = pipeline.near_dedup(spark, spark.createDataFrame(ODD, DOCS), d).collect()
    assert sum(r["doc_id"] is None for r in left) == 2


def test_registered():
    assert len(queries.QUERIES) == 10 and set(queries.ORACLES) <= set(queries.QUERIES)
