"""A set's sound moves from its tracks to its clips and from these to its blocks, and no further."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import levels, mix

CLIP = "set_id long, slot int, track_id long, start double, seconds double, overlap double, rate double, cut_start double, tempo double, transition string"
OPTIONS = {"bass_swap": {"crossover_hz": 2.0}, "filter_sweep": {"start_hz": 6.0, "end_hz": 1.0}}
NAMES = ("bass_swap", "echo_out", "filter_sweep", None)


def layout(sets, seconds):
    return [(s, j, 10 * s + j, j * seconds * 0.8, seconds, 0.0 if j == 0 else seconds * 0.2, 1.0 + 0.03 * j, 1.5 * j, 120.0, NAMES[(s + j) % 4]) for s in range(sets) for j in range(4)]


def noise(clips, rate, seconds):
    rng = np.random.default_rng(7)
    return [(c[2], a, (rng.uniform(-1, 1, 700) * 0.3).tolist()) for c in clips for a in range(0, int(seconds * rate * 1.2) + 8 * rate, 700)]


def shuffled(spark, action):
    store = lambda: {x.stageId(): x.shuffleWriteBytes() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    seen = set(store())
    action()
    return sum(v for k, v in store().items() if k not in seen)


@pytest.mark.parametrize("which", [0, 1])
def test_sound_moves_twice(spark, which):
    """The samples as well as the report: one move of the tracks, one of the clips."""
    rate, clips = 160, layout(6, 90.0)
    audio = spark.createDataFrame(noise(clips, rate, 90.0), "track_id long, first long, x array<double>")
    rows = mix.placed(spark.createDataFrame(clips, CLIP), rate)
    sound = 8 * rows.agg(F.sum("n")).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = shuffled(spark, lambda: mix.mastered(mix.pieces(rows, audio, rate), rate)[which].write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sound < moved < 3 * sound


def test_blocks_of_any_size_give_one_mix(spark, monkeypatch):
    """Borders come along with the pieces: many small blocks sound, and are told, as one large one."""
    rate, clips = 16, layout(2, 90.0)
    audio = spark.createDataFrame(noise(clips, rate, 90.0), "track_id long, first long, x array<double>")
    rows = mix.placed(spark.createDataFrame(clips, CLIP), rate)
    told = []
    for size in (1 << 15, 1):
        monkeypatch.setattr(levels, "BLOCK", size)
        assert (levels.block_size(rate, mix.RELEASE) < 300) == (size == 1)
        done, report = mix.mastered(mix.pieces(rows, audio, rate, options=OPTIONS), rate)
        told.append(({(r["set_id"], r["i"]): r["v"] for r in done.collect()}, report.orderBy("set_id").collect()))
    (large, one), (small, other) = told
    assert large.keys() == small.keys() and max(abs(small[k] - v) for k, v in large.items()) < 1e-9
    assert [tuple(r) for r in one] == [pytest.approx(tuple(r), abs=0.011) for r in other]


def test_a_loop_is_its_part_written_out(spark):
    rate, clips, rng = 16, layout(2, 30.0), random.Random(3)
    parts = [(c[2], a, 100, [rng.uniform(-1, 1) for _ in range(n)]) for c in clips for a, n in zip(range(0, 900, 100), (64, 7, 1, 100, 130, 33, 50, 99, 3), strict=True)]
    loops = spark.createDataFrame(parts, "track_id long, first long, m long, x array<double>")
    written = spark.createDataFrame([(t, a, (x * 100)[:m]) for t, a, m, x in parts], "track_id long, first long, x array<double>")
    rows = mix.placed(spark.createDataFrame(clips, CLIP), rate)
    got = [sorted((r["set_id"], r["i"], r["v"]) for r in mix.mixed(rows, audio, rate, options=OPTIONS).collect()) for audio in (loops, written)]
    assert got[0] == got[1] and any(v for _, _, v in got[0])
