"""Spectra against plain sums, resampling against sines of which the result is known."""

import math
import random

import numpy as np
import pytest

from cadenza.operators import spectra


def clips(spark, arrays):
    rows = [(k, i, None if v is None else float(v)) for k, x in arrays.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "clip_id string, i long, v double").repartition(5)


def plain_energy(x, rate, hop, size, low, high):
    out = []
    for k in range(1 + len(x) // hop):
        total = 0.0
        cut = [(x[j] or 0.0) if 0 <= (j := k * hop - size // 2 + a) < len(x) else 0.0 for a in range(size)]
        for b in range(size // 2 + 1):
            if low <= b * rate / size <= high:
                terms = [v * (0.5 - 0.5 * math.cos(2 * math.pi * a / size)) * complex(math.cos(2 * math.pi * a * b / size), -math.sin(2 * math.pi * a * b / size)) for a, v in enumerate(cut)]
                total += abs(sum(terms))
        out.append(total)
    return out


@pytest.mark.parametrize(("hop", "size"), [(5, 16), (8, 8), (16, 6)])
def test_band_energy(spark, hop, size, monkeypatch):
    monkeypatch.setattr(spectra, "FRAMES", 4)
    rng = random.Random(1)
    sounds = {"a": [rng.uniform(-1, 1) for _ in range(203)], "b": [None, 1.0, None], "c": [0.5]}
    frames = spectra.band_energy(clips(spark, sounds), 100.0, hop, size, 10.0, 40.0)
    got = {(r["clip_id"], r["k"]): r["energy"] for r in frames.collect()}
    want = {(c, k): e for c, x in sounds.items() for k, e in enumerate(plain_energy(x, 100.0, hop, size, 10.0, 40.0))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    beats = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 99.0), ("none", 1.0)], "clip_id string, t double")
    read = {r["t"]: r["low"] for r in spectra.at_beats(frames, beats, 100.0, hop).collect()}
    last = 203 // hop
    assert read == {0.0: got["a", 0], 1.0: got["a", min(last, math.floor(100.0 / hop + 0.5))], 99.0: got["a", last]}


@pytest.mark.parametrize(("before", "after"), [(44_100, 48_000), (48_000, 44_100), (44_100, 22_050), (8_000, 44_100), (96_000, 11_025)])
def test_sines_keep_their_shape(spark, before, after, monkeypatch):
    monkeypatch.setattr(spectra, "MADE", 1024)
    hz = 0.15 * min(before, after)
    x = np.sin(2 * np.pi * hz * np.arange(4000) / before)
    high = np.sin(2 * np.pi * 0.6 * after * np.arange(4000) / before)  # above half of the lower rate, if there is room
    out = {}
    for r in spectra.resampled(clips(spark, {"low": x, "high": high, "even": np.ones(4000)}), before, after).orderBy("i").collect():
        out.setdefault(r["clip_id"], []).append(r["v"])
    n = math.ceil(4000 * after / before)
    assert {len(v) for v in out.values()} == {n}
    inner = slice(n // 5, -n // 5)
    want = np.sin(2 * np.pi * hz * np.arange(n) / after)
    assert np.abs(np.array(out["low"]) - want)[inner].max() < 1e-3  # -60 dB
    assert np.abs(np.array(out["even"]) - 1)[inner].max() < 1e-9
    if after < before * 0.7:
        assert np.abs(np.array(out["high"]))[inner].max() < 1e-3


def test_little(spark):
    one = clips(spark, {"a": [2.0]})
    assert [tuple(r) for r in spectra.resampled(one, 100, 100).collect()] == [("a", 0, 2.0)]
    assert spectra.resampled(one, 100, 50).count() == 1 and spectra.resampled(one, 100, 300).count() == 3
    assert spectra.resampled(one.limit(0), 100, 50).collect() == [] and spectra.band_energy(one.limit(0), 100.0).collect() == []


def test_nothing_is_made_beyond_a_clip_s_end(spark, monkeypatch):
    """A short clip costs its own results, not a whole block of them."""
    made = []
    kernel = spectra.kernel
    monkeypatch.setattr(spectra, "kernel", lambda x, scale, half: made.append(len(x)) or kernel(x, scale, half))
    by_row = spectra.blocks.by_row

    def here(df, out, make, drop=()):
        for row in df.toPandas().itertuples(index=False):
            make(row)
        return by_row(df, out, make, drop)

    monkeypatch.setattr(spectra.blocks, "by_row", here)
    got = spectra.resampled(clips(spark, {1: np.ones(64), 2: np.ones(3)}), 48_000, 32_000, 8)
    assert sorted(made) == [2, 43] and got.schema.names == ["clip_id", "i", "v"]
