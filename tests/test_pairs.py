"""Section pairs chosen inside of tasks against plain loops, and what the views leave together."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.config import DEFAULT
from cadenza.functions import music
from cadenza.operators import analysis, matching
from cadenza.plans import catalogue
from cadenza.sources import views


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(5)
    bpms = {1: 120.0, 2: 124.0, 3: 61.0, 4: 200.0, 5: 122.0}
    tracks = [(k, b, k % 12, k % 2 == 0, 0.05 * k) for k, b in bpms.items()]
    counts = {1: 7, 2: 90, 3: 5, 4: 3, 5: 40}
    sections = [(k, i, i * 10.0, i * 10.0 + rng.choice([6.0, 9.0, 12.0]), rng.choice([0.1, 0.3, 0.5]), rng.randrange(12)) for k, n in counts.items() for i in range(n)]
    # Few different sounds, one of them silent, so that scores tie.
    chroma = [(k, [0.0] * 12 if k == 0 else [rng.random() for _ in range(12)]) for k in range(11)]
    return (
        spark.createDataFrame(tracks, "track_id long, bpm double, pitch_class int, minor boolean, confidence double"),
        spark.createDataFrame(sections, "track_id long, idx long, start double, end double, energy double, vec_id long").repartition(4),
        spark.createDataFrame(chroma, "vec_id long, chroma array<double>"),
    ), tracks, sections, dict(chroma)


def plain_pairs(spark, pairs, tracks, sections, chroma):
    """match, build and the rest of every pair of long sections, by loops; tempo and key from the expressions."""
    w, by_id = DEFAULT.weights.normalized(), {t[0]: t for t in tracks}
    out = {}
    for a, b in pairs:
        (_, x, pa, ma, ca), (_, y, pb, mb, cb) = by_id[a], by_id[b]
        lit = F.lit
        got = spark.range(1).select(music.tempo(lit(x), lit(y)).alias("t"), music.key_match(lit(pa), lit(ma), lit(pb), lit(mb), lit(ca), lit(cb)).alias("k")).first()
        if got["t"]["score"] <= 0:
            continue
        for _, i, s1, e1, n1, v1 in (s for s in sections if s[0] == a and s[3] - s[2] >= 8 and s[5] in chroma):
            for _, j, s2, e2, n2, v2 in (s for s in sections if s[0] == b and s[3] - s[2] >= 8 and s[5] in chroma):
                p, q, turn = chroma[v1], chroma[v2], got["k"]["shift"]
                norms = math.sqrt(sum(z * z for z in p)) * math.sqrt(sum(z * z for z in q))
                like = sum(p[k] * q[(k - turn) % 12] for k in range(12)) / norms if norms else 0.0
                base = w.tempo * got["t"]["score"] + w.key * got["k"]["score"] + w.chroma * min(1.0, max(0.0, like))
                d = n2 - n1
                scores = {"match": base + w.energy * max(0.0, min(1.0, 1 - abs(d) / 0.15)), "build": base + w.energy * max(0.0, min(1.0, 1 - abs(d - 0.25) / 0.25))}
                out.setdefault((a, b), []).append({"i": i, "j": j, "shorter": min(e1 - s1, e2 - s2)} | {k: round(z, 9) for k, z in scores.items()})
    return out


PAIRS = [(1, 2), (2, 5), (5, 2), (3, 1), (1, 4), (2, 3)]


def best(rows, name, n):
    rows = sorted((r for r in rows if r[name] >= DEFAULT.min_score), key=lambda r: (-r[name], -r["shorter"], r["i"], r["j"]))
    return [(r["i"], r["j"]) for r in rows[:n]]


def test_the_best_section_pairs_over_many_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 32)
    tables, tracks, sections, chroma = library
    pairs = spark.createDataFrame(PAIRS, "a_track_id long, b_track_id long")
    want = plain_pairs(spark, PAIRS, tracks, sections, chroma)
    every = matching.section_pairs(pairs, *tables)
    assert {(r[0], r[1]): r[2] for r in every.groupBy("a_track_id", "b_track_id").count().collect()} == {k: len(x) for k, x in want.items()}
    for n in (1, 20):
        few = matching.section_pairs(pairs, *tables, by=("match", "build"), n=n, least=DEFAULT.min_score)
        # Only what may be among the best of two blocks leaves a task.
        assert few.count() <= 2 * n * sum(math.ceil(90 / 32) ** 2 for _ in PAIRS)
        for name in ("match", "build"):
            got = {}
            for r in matching.best_of(few.filter(F.col(name) >= DEFAULT.min_score), name, n=n).orderBy("place").collect():
                got.setdefault((r["a_track_id"], r["b_track_id"]), []).append((r["a_idx"], r["b_idx"]))
            assert got == {k: z for k, x in want.items() if (z := best(x, name, n))}
    assert set(want) == {(1, 2), (2, 5), (5, 2), (3, 1), (2, 3)}  # 120 and 200 a minute do not meet


def test_key_table_against_loops(spark):
    def wheel(pc, minor):
        return (((pc + 3) % 12 if minor else pc % 12) * 7 % 12 + 7) % 12 + 1

    rows = [(pa, ma, pb, mb) for pa in range(0, 12, 5) for ma in (True, False) for pb in range(12) for mb in (True, False)]
    df = spark.createDataFrame(rows, "pa int, ma boolean, pb int, mb boolean")
    got = df.withColumn("k", music.key_match(*[F.col(x) for x in ("pa", "ma", "pb", "mb")], F.lit(1.0), F.lit(1.0))).collect()
    for r in got:
        options = []
        for s in (-2, -1, 0, 1, 2):
            a, b = wheel(r["pa"], r["ma"]), wheel((r["pb"] + s) % 12, r["mb"])
            hours = min((a - b) % 12, (b - a) % 12)
            d = hours if r["ma"] == r["mb"] else 1 if a == b else hours + 2
            options.append(({0: 1.0, 1: 0.85, 2: 0.55, 3: 0.3}.get(d, max(0.0, 0.2 - 0.05 * (d - 4))) - 0.04 * abs(s), -s, d))
        top = max(options)
        assert (r["k"]["score"], r["k"]["shift"], r["k"]["distance"]) == (min(1.0, max(0.0, top[0])), -top[1], top[2])
    none = spark.range(1).select(music.key_match(F.lit(None).cast("int"), F.lit(True), F.lit(1), F.lit(True), F.lit(1.0), F.lit(1.0))["score"]).first()[0]
    assert none is None


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_a_tracks_sections_move_once(spark):
    d = "/root/testdata/sf0.001"
    s = views.sections(spark, d)
    assert exchanges(matching.track_energy(s)) == 1
    assert exchanges(analysis.labelled(s)) == 1
    assert exchanges(matching.packed(s, views.chroma(spark, d))) == 1


def test_mean_chroma_moves_sections_once(spark):
    d = "/root/testdata/sf0.001"
    mean = analysis.section_chroma(views.sections(spark, d), views.chroma(spark, d))
    assert exchanges(mean) == 1 and exchanges(analysis.key_estimate(mean)) == 1
    s = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 2)], "track_id long, vec_id long")
    c = spark.createDataFrame([(0, [1.0] + [0.0] * 11), (1, [0.0, 1.0] + [0.0] * 10), (2, [0.25] * 4 + [0.0] * 8)], "vec_id long, chroma array<double>")
    got = {(r["track_id"], r["pitch"]): r["v"] for r in analysis.section_chroma(s, c).collect()}
    assert len(got) == 24 and got[2, 3] == 0.25 and got[1, 0] == pytest.approx(1.25 / 3, abs=1e-9) and got[1, 11] == 0.0


def test_vectors_move_once_to_their_pair(spark, library):
    tables = library[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = matching.section_pairs(spark.createDataFrame(PAIRS, "a_track_id long, b_track_id long"), *tables, by=("match",), n=1)
        plan = pairs._jdf.queryExecution().explainString(pairs._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The vectors' own way to the sections, and one way from there to the pairs.
    assert len(re.findall(r"Exchange\nInput \[\d+\]: \[[^\]]*units#", plan)) == 2


def test_a_pair_is_whole_whatever_the_batches(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(matching, "BLOCK", 4)
    sizes = {(1, 2): (9, 5), (2, 1): (0, 3), (2, 3): (1, 1), (3, 3): (4, 0), (4, 1): (4, 8)}
    rows = [{"a_track_id": a, "b_track_id": b, "first": f, "idx": i, "start": 0.0, "end": 9.0, "energy": 0.5, "bonus": 0.0, "units": [float(i)] * 12, "label": f"{a}{b}{f}{i}", "tempo": 1.0} for (a, b), n in sizes.items() for f, m in zip((True, False), n, strict=True) for i in range(m)]
    whole = pa.RecordBatch.from_pylist(rows)
    for _ in range(5):
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(6))})
        parts = [whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        got = [r for batch in matching.whole_pairs(iter([whole.slice(0, 0), *parts])) for met in matching.blocks_met(batch, ["a_track_id", "b_track_id", "tempo"], ("label",)) for r in met.to_pylist()]
        assert max(len(r[f"{p}_idx"]) for r in got for p in "ab") == 4
        pairs = sorted((r["a_track_id"], r["b_track_id"], i, j) for r in got for i in r["a_idx"] for j in r["b_idx"])
        assert pairs == sorted((a, b, i, j) for (a, b), (m, n) in sizes.items() for i in range(m) for j in range(n))
        for r in got:
            for p, f in (("a", True), ("b", False)):
                assert r[f"{p}_units"] == [float(i) for i in r[f"{p}_idx"] for _ in range(12)]
                assert r[f"{p}_label"] == [f"{r['a_track_id']}{r['b_track_id']}{f}{i}" for i in r[f"{p}_idx"]]


def test_set_pairs_are_dealt(spark):
    """However small the file of tracks is, its pairs are not one task's."""
    pairs = catalogue.set_pairs(spark, "/root/testdata/sf0.001")
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    tracks = [r["track_id"] for r in views.tracks(spark, "/root/testdata/sf0.001").collect()]
    sets = {}
    for k in tracks:
        sets.setdefault(int((k - 1) / 20), []).append(k)
    assert pairs.count() == sum(len(s) * (len(s) - 1) for s in sets.values())
