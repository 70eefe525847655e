"""Sections that resemble others of their track, against plain loops."""

import random

import numpy as np
import pytest

from cadenza.operators import segments


def plain(sections, chroma, near):
    unit = {k: np.array(v) / np.linalg.norm(v) if any(v) else np.zeros(12) for k, v in chroma}
    there = [s for s in sections if s[2] in unit]
    like = lambda a, b: a[0] is not None and a[0] == b[0] and a[1] != b[1] and round(float(np.clip(unit[a[2]] @ unit[b[2]], 0, 1)), 9) > near
    return sorted(((a[0] or 0, a[1], sum(like(a, b) for b in there)) for a in there))


@pytest.mark.parametrize(("size", "batch"), [(4096, 10_000), (16, 10_000), (16, 7)])
def test_recurrence(spark, monkeypatch, size, batch):
    """Whole tracks, tracks in parts, and parts that go over several batches."""
    monkeypatch.setattr(segments, "ALIKE", size)
    monkeypatch.setattr(segments, "MEET", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = random.Random(3)
        counts = {1: 1, 2: 30, 3: 90, 4: 15, None: 3}
        sections = [(k, i, rng.randrange(14)) for k, n in counts.items() for i in range(n)]
        # One vector is silent, two are not there.
        chroma = [(k, [0.0] * 12 if k == 0 else [rng.random() for _ in range(12)]) for k in range(12)]
        s = spark.createDataFrame(sections, "track_id long, idx int, vec_id long").repartition(4)
        got = segments.recurrence(s, spark.createDataFrame(chroma, "vec_id long, chroma array<double>"), 0.8)
        assert got.dtypes == [("track_id", "bigint"), ("idx", "int"), ("n", "bigint")]
        rows = sorted((r["track_id"] or 0, r["idx"], r["n"]) for r in got.collect())
        assert rows == plain(sections, chroma, 0.8) and sum(r[2] for r in rows) > 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_recurrence_has_no_rows_of_pairs(spark):
    """A track's sections are compared where they lie; no join makes a row of each two of them."""
    s = spark.createDataFrame([(1, i, 1) for i in range(200)], "track_id long, idx int, vec_id long")
    got = segments.recurrence(s, spark.createDataFrame([(1, [1.0] * 12)], "vec_id long, chroma array<double>"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of sections with their vectors
    assert {r["n"] for r in got.collect()} == {199}
