"""K-weighting, WAV parts and bounds on downbeats, against plain loops and the standard library."""

import io
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import levels, segments
from cadenza.sources import wav


def filtered(x, b, a):
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[j] * x[i - j] for j in range(3) if i >= j) - sum(a[j] * y[i - j] for j in (1, 2) if i >= j)
    return y


def gain(b, a, hz, rate):
    z = np.exp(-2j * np.pi * hz / rate) ** np.arange(3)
    return 20 * np.log10(abs((b @ z) / (a @ z)))


def test_k_weight_coefficients():
    """The shelf rises by half of its decibels at its frequency; the high-pass is the one the recommendation lists at 48 kHz."""
    g = 10 ** (levels.SHELF_DB / 40)
    slope = np.sqrt(g) / levels.SHELF_Q
    shelf = levels.biquad((g * g, g * slope, g), (1.0, slope, g), levels.SHELF_HZ, 48_000)
    assert [gain(*shelf, hz, 48_000) for hz in (0, levels.SHELF_HZ, 24_000)] == pytest.approx([0, levels.SHELF_DB / 2, levels.SHELF_DB], abs=1e-9)
    _, a = levels.biquad((1.0, 0.0, 0.0), (1.0, 1 / levels.HIGH_PASS_Q, 1.0), levels.HIGH_PASS_HZ, 48_000)
    assert a == pytest.approx([1, -1.99004745483398, 0.99007225036621], abs=1e-6)


def test_k_weight_blocks(spark, monkeypatch):
    monkeypatch.setattr(levels, "BLOCK", 300)
    rate, rng = 8_000, np.random.default_rng(3)
    xs = {c: rng.normal(size=n) for c, n in ((1, 4_000), (2, 299), (3, 1))}
    rows = pd.DataFrame([(c, i, v) for c, x in xs.items() for i, v in enumerate(x)], columns=["clip_id", "i", "v"])
    got = levels.k_weight(spark.createDataFrame(rows), rate).toPandas()
    g = 10 ** (levels.SHELF_DB / 40)
    slope = np.sqrt(g) / levels.SHELF_Q
    for c, x in xs.items():
        y = filtered(x, *levels.biquad((g * g, g * slope, g), (1.0, slope, g), levels.SHELF_HZ, rate))
        y = filtered(y, *levels.biquad((1.0, 0.0, 0.0), (1.0, 1 / levels.HIGH_PASS_Q, 1.0), levels.HIGH_PASS_HZ, rate))
        mine = got[got.clip_id == c].sort_values("i")
        assert mine.i.tolist() == list(range(len(x)))
        np.testing.assert_allclose(mine.v, y, atol=1e-9)


def test_loudness_of_a_sine(spark):
    """A sine reads its mean power after the filters' gain; the recommendation's -3.01 at 997 Hz within half a decibel."""
    rate = 48_000
    sine = lambda hz: spark.range(2 * rate).select(F.lit(1).alias("clip_id"), F.col("id").alias("i"), F.sin(2 * np.pi * hz * F.col("id") / rate).alias("v"))
    h = levels.k_response(rate)
    for hz in (100, 997):
        weight = 20 * np.log10(abs(np.sum(h * np.exp(-2j * np.pi * hz / rate * np.arange(len(h))))))
        assert levels.loudness(sine(hz), rate).first()["lufs"] == pytest.approx(-0.691 - 3.0103 + weight, abs=0.02)
    assert levels.loudness(sine(997), rate).first()["lufs"] == pytest.approx(-3.01, abs=0.5)


def test_wav_parts(spark, monkeypatch):
    monkeypatch.setattr(wav, "FRAMES", 4)
    rows = [(c, i, ch, v) for c in (1, 2) for i in range(5 * c) for ch, v in ((0, i / 10 - 0.5), (1, float("nan") if i == 2 else 2.0))]
    df = spark.createDataFrame(rows, "clip_id int, i int, ch int, v double")
    parts = wav.wav_parts(df, 22_050, 2).orderBy("clip_id", "part").toPandas()
    for c in (1, 2):
        with wave.open(io.BytesIO(b"".join(bytes(b) for b in parts[parts.clip_id == c]["bytes"]))) as f:
            assert (f.getnchannels(), f.getframerate(), f.getsampwidth(), f.getnframes()) == (2, 22_050, 2, 5 * c)
            data = np.frombuffer(f.readframes(99), "<i2").reshape(-1, 2)
        assert data[0].tolist() == [-16384, 32767] and data[2, 1] == 0


def test_bounds_on_downbeats(spark):
    found = spark.createDataFrame([(1, 3.9), (1, 9.0), (2, 5.0)], "track_id long, t double")
    downs = spark.createDataFrame([(1, float(t)) for t in (0, 2, 4, 6)], "track_id long, t double")
    assert sorted(map(tuple, segments.snapped(found, downs).collect())) == [(1, 4.0), (1, 9.0), (2, 5.0)]


def test_segment_with_downbeats(spark):
    rows = [(t, i, i * 1.1, [float(i >= n // 2), 0.0]) for t, n in ((1, 40), (2, 5)) for i in range(n)]
    beats = spark.createDataFrame(rows, "track_id long, i int, t double, features array<double>")
    downs = beats.filter("i % 4 = 0").select("track_id", "t")
    lengths = spark.createDataFrame([(1, 44.0), (2, 5.5), (3, 0.0)], "track_id long, duration double")
    got = segments.segment(beats, lengths, 4.0, downs, bars=2).orderBy("track_id", "idx").toPandas()
    one = got[got.track_id == 1]
    assert len(one) > 1 and (one.end - one.start).min() >= 8.8 - 1e-9
    assert all(min(abs(x - 4.4 * k) for k in range(10)) < 1e-9 for x in one.start)
    assert got[got.track_id == 2][["start", "end"]].values.tolist() == [[0.0, 5.5]]
