"""Block filters, treatments by name and whole sets against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import filters, levels, mix, transitions


def clips(spark, arrays):
    rows = [(k, i, float(v)) for k, x in arrays.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "clip_id long, i long, v double").repartition(5)


def arrays_of(df, key="clip_id", value="v"):
    out = {}
    for r in df.orderBy("i").collect():
        out.setdefault(r[key], []).append(r[value])
    return {k: np.array(v) for k, v in out.items()}


def plain_design(hz, rate, kind, order):
    k = math.tan(math.pi * hz / rate)
    if order == 1:
        b = k / (1 + k) if kind == "low" else 1 / (1 + k)
        return (b, b if kind == "low" else -b, 0.0, (k - 1) / (k + 1), 0.0)
    whole = 1 + math.sqrt(2) * k + k * k
    b = (k * k if kind == "low" else 1.0) / whole
    return (b, 2 * b if kind == "low" else -2 * b, b, 2 * (k * k - 1) / whole, (1 - math.sqrt(2) * k + k * k) / whole)


def plain_filter(x, designs, size, carry):
    """Direct form I with its own memory of inputs and outputs, restated as states at a block's edge."""
    y, s1, s2 = [], 0.0, 0.0
    for i, v in enumerate(x):
        if i % size == 0 and not carry:
            s1 = s2 = 0.0
        b0, b1, b2, a1, a2 = designs[i // size]
        w = b0 * v + s1
        s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
        y.append(w)
    return np.array(y)


def glide(n, size, rate, a, b, low, share):
    blocks = math.ceil(n / size)
    return [max(low, min(rate / 2 * share, a * (b / a) ** (k / max(blocks - 1, 1)))) for k in range(blocks)]


@pytest.mark.parametrize("carry", [False, True])
@pytest.mark.parametrize("order", [1, 2])
def test_moving_filters(spark, carry, order, monkeypatch):
    monkeypatch.setattr(filters, "FAN", 4)
    rng = random.Random(2)
    sounds = {k: [rng.uniform(-1, 1) for _ in range(n)] for k, n in ((1, 1), (2, 16), (3, 700), (4, 333))}
    design = filters.first_order if order == 1 else filters.second_order
    for kind, a, b in (("high", 30.0, 1800.0), ("low", 3000.0, 50.0)):
        got = arrays_of(filters.moving(clips(spark, sounds), ["clip_id"], 8000, a, b, kind, design, size=16, carry=carry))
        for k, x in sounds.items():
            designs = [plain_design(hz, 8000, kind, order) for hz in glide(len(x), 16, 8000, a, b, 25.0, 0.95)]
            assert np.allclose(got[k], plain_filter(x, designs, 16, carry), atol=1e-9, rtol=0)


def test_a_fixed_filter_is_one_recursion(spark, monkeypatch):
    monkeypatch.setattr(filters, "SIZE", 8)
    monkeypatch.setattr(filters, "FAN", 3)
    monkeypatch.setattr(filters.blocked, "__defaults__", (8,))
    monkeypatch.setattr(filters.unblocked, "__defaults__", (8,))
    rng = random.Random(4)
    x = [rng.uniform(-1, 1) for _ in range(500)]
    got = arrays_of(filters.passed(clips(spark, {5: x}), ["clip_id"], 220.0, 8000, "high"))[5]
    assert np.allclose(got, plain_filter(x, [plain_design(220.0, 8000, "high", 1)] * 500, 500, True), atol=1e-9, rtol=0)
    # A second-order low-pass leaves a slow sine and takes a fast one.
    t = np.arange(4000) / 8000
    waves = {1: np.sin(2 * np.pi * 40 * t), 2: np.sin(2 * np.pi * 3000 * t)}
    through = arrays_of(filters.passed(clips(spark, waves), ["clip_id"], 400.0, 8000, "low", filters.second_order))
    assert np.abs(through[1][2000:]).max() == pytest.approx(1.0, abs=0.01) and np.abs(through[2][2000:]).max() < 0.03


def test_nulls_are_silence_and_nothing_gives_nothing(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 1.0)], "clip_id long, i long, v double")
    c = plain_design(100.0, 8000, "low", 1)
    assert np.allclose(arrays_of(filters.passed(df, ["clip_id"], 100.0, 8000, "low"))[1], plain_filter([0.0, 1.0], [c], 9, True))
    assert filters.passed(df.limit(0), ["clip_id"], 100.0, 8000, "low").collect() == []


def plain_echo(x, d, feedback, mixed):
    w, y = [0.0] * len(x), []
    for i, v in enumerate(x):
        w[i] = x[i - d] + feedback * w[i - d] if i >= d else 0.0
        y.append((1 - mixed) * v + mixed * w[i])
    return np.array(y)


@pytest.mark.parametrize(("d", "feedback"), [(1, 0.45), (7, 0.9), (60, 0.0), (500, 0.5)])
def test_echo(spark, d, feedback):
    rng = random.Random(d)
    sounds = {1: [rng.uniform(-1, 1) for _ in range(301)], 2: [1.0] + [0.0] * 99}
    got = arrays_of(filters.echoed(clips(spark, sounds), ["clip_id"], F.lit(d), feedback, 0.35))
    for k, x in sounds.items():
        assert np.allclose(got[k], plain_echo(x, d, feedback, 0.35), atol=1e-9, rtol=0)


def test_filter_build_leaves_what_is_before(spark):
    rng = random.Random(1)
    x = [rng.uniform(-1, 1) for _ in range(5000)]
    df = clips(spark, {1: x}).withColumn("bpm", F.lit(120.0))
    got = arrays_of(filters.filter_build(df, ["clip_id"], 400, F.col("bpm"), 4))[1]
    tail = 4 * 2 * 400
    designs = [plain_design(hz, 400, "high", 2) for hz in glide(tail, 2048, 400, 30.0, 1800.0, 25.0, 0.95)]
    assert got[: 5000 - tail].tolist() == x[: 5000 - tail] and np.allclose(got[5000 - tail :], plain_filter(x[5000 - tail :], designs, 2048, False), atol=1e-9)
    assert arrays_of(filters.filter_build(df, ["clip_id"], 400, F.col("bpm"), 0))[1].tolist() == x
    assert len(arrays_of(filters.filter_build(df, ["clip_id"], 400, F.col("bpm"), 400))[1]) == 5000


def plain_treatment(name, gone, come, rate, bpm):
    n = len(gone)
    gone, come = np.array(gone), np.array(come)
    if name == "filter_sweep":
        sweep = lambda x, a, b: plain_filter(x, [plain_design(hz, rate, "low", 1) for hz in glide(n, 2048, rate, a, b, 20.0, 0.99)], 2048, False)
        gone, come = sweep(gone, 20000.0, 400.0), sweep(come, 400.0, 20000.0)
    elif name == "echo_out":
        gone = plain_echo(gone, max(1, int(0.75 * 60 / bpm * rate)), 0.45, 0.35)
    else:
        swap, c = int(n * 0.5), [plain_design(220.0, rate, "high", 1)] * (n + 1)
        gone = np.concatenate([gone[:swap], plain_filter(gone[swap:], c, n + 1, True)])
        come = np.concatenate([plain_filter(come[:swap], c, n + 1, True), come[swap:]])
    x = np.pi / 2 * np.arange(n) / max(n - 1, 1)
    return gone * np.cos(x), come * np.sin(x)


def test_treatments_by_name(spark):
    rng = random.Random(9)
    joins = {1: ("bass_swap", 2500), 2: ("filter_sweep", 5000), 3: ("echo_out", 3000), 4: ("no such thing", 300), 5: (None, 7), 6: ("echo_out", 1)}
    rows, want = [], {}
    for k, (name, n) in joins.items():
        a, b = ([rng.uniform(-1, 1) for _ in range(n)] for _ in range(2))
        rows += [(k, i, n, a[i], b[i], 124.0, name) for i in range(n)]
        want[k] = plain_treatment(name, a, b, 8000, 124.0)
    df = spark.createDataFrame(rows, "join_id long, i long, n long, gone double, come double, bpm double, name string").repartition(4)
    got = transitions.treated(df, 8000)
    for side, at in (("gone", 0), ("come", 1)):
        told = arrays_of(got, "join_id", side)
        assert set(told) == set(want)
        for k in want:
            assert np.allclose(told[k], want[k][at], atol=1e-9, rtol=0), (k, side)
    louder = transitions.treated(df.filter("join_id = 3"), 8000, {"echo_out": {"mix": 0.0}})
    assert np.allclose(arrays_of(louder, "join_id", "gone")[3], [r[3] for r in rows if r[0] == 3] * np.cos(np.pi / 2 * np.arange(3000) / 2999), atol=1e-9)


def test_the_limiter_s_border(spark):
    rng = random.Random(3)
    x = {1: [rng.uniform(0, 1) for _ in range(400)]}
    got = arrays_of(levels.nearby_least(clips(spark, x), "v", 5, "m", 16), value="m")[1]
    assert got.tolist() == [min(x[1][max(0, i - 5) : i + 6]) for i in range(400)]


CLIP = "set_id long, slot int, track_id long, start double, seconds double, overlap double, rate double, cut_start double, tempo double, transition string"
RATE = 100
LAYOUT = [
    (1, 0, 10, 0.0, 20.0, 0.0, 1.0, 3.0, 120.0, None),
    (1, 1, 11, 16.0, 12.0, 4.0, 1.1, 0.5, 120.0, "bass_swap"),
    (1, 3, 12, 25.0, 9.0, 3.0, 0.93, 30.0, 120.0, "echo_out"),  # a slot is missing, and the track ends early
    (1, 4, 10, 30.0, 2.0, 1.0, 1.0, 1.234, 120.0, "filter_sweep"),
    (1, 5, 11, 24.0, 40.0, 16.0, 1.0, 0.0, 120.0, "unknown"),  # longer than the clip before it
    (2, 0, 12, 0.0, 5.0, 0.0, 0.5, 0.0, 90.0, None),
    (2, 1, 99, 4.0, 5.0, 1.0, 1.0, 0.0, 90.0, "bass_swap"),  # a track without sound
]


def plain_mix(layout, sound, rate):
    sets = {}
    for row in layout:
        sets.setdefault(row[0], []).append(row)
    out = {}
    for k, rows in sets.items():
        made, at, wish = [], 0, 0
        for j, (_, _, track, _, seconds, overlap, step, cut, bpm, name) in enumerate(rows):
            n = int(seconds * rate)
            want = min(int(overlap * rate), n) if j else 0
            head = max(0, min(want, len(made[-1][1]) - wish)) if j else 0
            x = sound.get(track, [])
            v = []
            for i in range(n):
                t = cut * rate + i * step
                a = int(t)
                v.append(0.0 if a >= len(x) else x[a] + (t - a) * ((x[a + 1] if a + 1 < len(x) else x[-1]) - x[a]))
            at = at + len(made[-1][1]) - head if j else 0
            made.append((at, v, head, bpm, name))
            wish = want
        total = [0.0] * (made[-1][0] + len(made[-1][1]))
        for j, (first, v, head, bpm, name) in enumerate(made):
            keep = len(v) - (made[j + 1][2] if j + 1 < len(made) else 0)
            for i in range(head, keep):
                up = int(0.05 * rate)
                total[first + i] += v[i] * (math.sin(math.pi / 2 * i / (up - 1)) if j == 0 and i < up else 1.0)
            if head:
                before = made[j - 1][1]
                gone, come = plain_treatment(name, before[len(before) - head :], v[:head], rate, bpm)
                for i in range(head):
                    total[first + i] += gone[i] + come[i]
        out[k] = np.array(total)
    return out


def test_a_set_is_mixed_like_a_loop(spark):
    rng = random.Random(12)
    sound = {10: [rng.uniform(-1, 1) for _ in range(4000)], 11: [rng.uniform(-1, 1) for _ in range(5000)], 12: [rng.uniform(-1, 1) for _ in range(3300)]}
    parts = [(k, a, x[a : a + m]) for k, x in sound.items() for m in (700 + k,) for a in range(0, len(x), m)]
    audio = spark.createDataFrame(parts, "track_id long, first long, x array<double>").repartition(3)
    clips_ = mix.placed(spark.createDataFrame(LAYOUT, CLIP).repartition(3), RATE)
    told = mix.mixed(clips_, audio, RATE, target=None).collect()
    want = plain_mix(LAYOUT, sound, RATE)
    got = {k: np.zeros(len(x)) for k, x in want.items()}
    for r in told:
        got[r["set_id"]][r["i"]] += r["v"]
    assert len({(r["set_id"], r["i"]) for r in told}) == len(told)
    for k, x in want.items():
        assert np.allclose(got[k], x, atol=1e-9, rtol=0)


def test_trims_and_master(spark):
    """Clips of different levels come to the same loudness, and the sum stays below the ceiling."""
    rate = 160
    rng = random.Random(4)
    noise = [rng.uniform(-1, 1) for _ in range(6 * rate)]
    sound = {1: [0.3 * v for v in noise], 2: [0.6 * v for v in noise]}
    audio = spark.createDataFrame([(k, a, x[a : a + 400]) for k, x in sound.items() for a in range(0, len(x), 400)], "track_id long, first long, x array<double>")
    rows = mix.placed(spark.createDataFrame([(1, 0, 1, 0.0, 6.0, 0.0, 1.0, 0.0, 120.0, None), (1, 1, 2, 4.0, 6.0, 2.0, 1.0, 0.0, 120.0, "bass_swap")], CLIP), rate)
    gains = {r["slot"]: r["gain"] for r in mix.trims(mix.taken(rows, audio, rate), rate, -10.0).collect()}
    assert gains[0] / gains[1] == pytest.approx(2.0, rel=1e-6)
    done, report = mix.mastered(mix.mixed(rows, audio, rate, -10.0), rate, -16.0, -3.0)
    told = report.first()
    assert told["set_id"] == 1 and told["peak_db"] <= -3.0 + 0.01
    assert done.agg(F.max(F.abs("v"))).first()[0] <= 10 ** (-3 / 20) + 1e-12


def test_a_mix_is_dense_and_moves_in_blocks(spark):
    """What no part of a track holds is silence, and a set at this rate is one block."""
    audio = spark.createDataFrame([(10, 0, [0.5] * 4000), (12, 0, [0.25] * 3300)], "track_id long, first long, x array<double>")
    clips_ = mix.placed(spark.createDataFrame(LAYOUT, CLIP), RATE)
    rows = mix.mixed_blocks(clips_, audio, RATE, target=None)
    length = {r["set_id"]: r["n"] for r in clips_.groupBy("set_id").agg(F.max(F.col("first") + F.col("n")).alias("n")).collect()}
    got = {r["set_id"]: r["x"] for r in rows.collect()}
    assert {k: len(x) for k, x in got.items()} == length and not any(math.isnan(v) for x in got.values() for v in x)
    assert got[2][-1] == 0.0
