"""Levels and segments against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators import levels, segments


def clip(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "clip_id long, i long, v double")


@pytest.mark.parametrize("alpha", [0.5, 0.9, 0.999])
def test_one_pole(spark, alpha):
    x = np.random.default_rng(1).normal(size=300)
    want, y = [], 0.0
    for v in x:
        y = (1 - alpha) * v + alpha * y
        want.append(y)
    got = [r["smooth"] for r in levels.one_pole(clip(spark, x), "v", alpha).orderBy("i").collect()]
    assert np.allclose(got, want, atol=1e-12)


def test_limit_holds_the_ceiling(spark):
    x = np.random.default_rng(2).normal(size=100)
    got = np.array([r["v"] for r in levels.limit(clip(spark, x), 0.2, 3, 0.7).orderBy("i").collect()])
    assert len(got) == 100 and np.abs(got).max() <= 0.2 and (np.sign(got) * np.sign(x) >= 0).all()


def test_level_ride_leaves_short_clips_and_silence(spark):
    for x in ([0.5] * 31, [0.0] * 64):
        assert [r["v"] for r in levels.level_ride(clip(spark, x), -20.0, 16, 2, 5).orderBy("i").collect()] == x
    with pytest.raises(ValueError):
        levels.level_ride(clip(spark, [0.0]), -20.0, 15, 2, 5)


def test_fade(spark):
    got = [r["v"] for r in clip(spark, [1.0] * 10).select("i", levels.fade(F.col("i"), F.lit(10), 3, 99).alias("v")).orderBy("i").collect()]
    assert got[0] == 0 and math.isclose(got[9], 0, abs_tol=1e-12) and math.isclose(got[1], math.sin(math.pi / 4) * math.sin(math.pi / 2 * 8 / 9))


def test_clusters_split_where_features_change():
    x = np.repeat([[0.0, 1.0], [5.0, 0.0], [0.0, 9.0]], [4, 7, 3], axis=0)
    assert segments.cluster_starts(x, 3) == [0, 4, 11]
    assert segments.cluster_starts(x[:2], 5) == [0, 1] and segments.cluster_starts(x, 0) == [0]


def test_ward_takes_the_cheapest_neighbours():
    """The first merge is that of least added variance, by trying all."""
    x = np.random.default_rng(4).normal(size=(9, 3))
    spread = lambda rows: float(((rows - rows.mean(axis=0)) ** 2).sum())
    best = min(range(8), key=lambda j: spread(x[j : j + 2]))
    assert segments.cluster_starts(x, 8) == [i for i in range(9) if i != best + 1]


def test_least_length(spark):
    for edges, least in itertools.product(([0.0, 10.0], [0.0, 2.0, 5.0, 9.0, 10.0], [0.0, 4.0, 5.0, 8.0, 20.0]), (3.0, 0.5)):
        want = [edges[0]]
        for e in edges[1:-1]:
            if e - want[-1] >= least and edges[-1] - e >= least:
                want.append(e)
        want.append(edges[-1])
        got = spark.range(1).select(segments.least_length(F.array(*map(F.lit, edges)), F.lit(least)).alias("e")).first()["e"]
        assert got == want


def test_diacritics_and_names(spark):
    r = spark.createDataFrame([("Café Zoë", "a/b:c"), (None, None), ("שָׁלוֹם", "  ")], "a string, b string").select(text.strip_diacritics(F.col("a")).alias("a"), text.safe_name(F.col("b")).alias("b")).collect()
    assert [tuple(x) for x in r] == [("Cafe Zoe", "a_b_c"), (None, "track"), ("שלום", "track")]


def test_short_clips_are_not_groups_of_python(spark):
    """Clips are rows of a batch: loudness and the master start no call of Python for each of them."""
    df = spark.range(64).select((F.col("id") % 4).alias("clip_id"), F.expr("id div 4").alias("i"), F.lit(0.5).alias("v"))
    plans = [x._jdf.queryExecution().toString() for x in (levels.loudness(df, 160), levels.mastered(df, 160, -14.0, -1.0)[1])]
    assert not any("FlatMapGroups" in p for p in plans) and all("MapInPandas" in p for p in plans)
