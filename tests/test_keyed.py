"""Keyed tables: which files a write touches, what a killed one leaves, what order of writes gives."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import keyed

SCHEMA = "id long, at int, v string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return {r["id"]: (r["at"], r["v"]) for r in keyed.state(spark, path, schema).collect()}


def test_a_small_write_leaves_other_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.merge(path, spark.range(2000).select("id", F.lit(1).alias("at"), F.lit("a").alias("v")), ["id"], ["at"])
    before, old = keyed.folders(spark, path), files(f"{path}/rows")
    few = [3, 700, 1999]
    keyed.merge(path, spark.createDataFrame([(i, 2, "b") for i in few], SCHEMA), ["id"], ["at"])
    after = keyed.folders(spark, path)
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 3 and set(before) == set(after) and old <= files(f"{path}/rows")
    got = rows(spark, path)
    assert len(got) == 2000 and all(got[i] == (2, "b") for i in few) and got[4] == (1, "a")


def test_a_killed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert rows(spark, path) == {}
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], SCHEMA)
    keyed.merge(path, first, ["id"], ["at"], buckets=4)
    broken = first.withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        keyed.merge(path, broken, ["id"], ["at"])
    assert rows(spark, path) == {1: (1, "a"), 2: (1, "a")}
    # A commit without its mark of success does not count; neither do its rows.
    keyed.merge(path, spark.createDataFrame([(1, 2, "b")], SCHEMA), ["id"], ["at"])
    os.remove(f"{path}/commits/2/_SUCCESS")
    assert rows(spark, path) == {1: (1, "a"), 2: (1, "a")}
    # The next write goes past it.
    keyed.merge(path, spark.createDataFrame([(2, 3, "c")], SCHEMA), ["id"], ["at"])
    assert keyed.commits(spark, path) == [1, 3] and rows(spark, path) == {1: (1, "a"), 2: (3, "c")}


def test_writes_in_any_order_against_a_dict(spark, tmp_path):
    rng = random.Random(4)
    path, want, stamp = str(tmp_path / "t"), {}, list(range(200))
    rng.shuffle(stamp)
    for k in range(5):
        gone = k == 3
        batch = [(rng.randrange(20), stamp.pop(), f"w{k}") for _ in range(30)]
        for i, at, v in batch:
            if i not in want or at > want[i][0]:
                want[i] = (at, None if gone else v)
        # A key may come in the same write more than once.
        df = spark.createDataFrame(batch, SCHEMA)
        keyed.merge(path, df, ["id"], ["at"], gone=gone, buckets=4 + k)
        keyed.merge(path, df, ["id"], ["at"], gone=gone)
        assert rows(spark, path) == {i: x for i, x in want.items() if x[1] is not None}
    keyed.merge(path, spark.createDataFrame([], SCHEMA), ["id"], ["at"])
    assert len(keyed.commits(spark, path)) == 10 and len(keyed.folders(spark, path)) <= 4
    keyed.merge(path, spark.createDataFrame([(None, 1, "n")], SCHEMA), ["id"], ["at"])
    assert rows(spark, path)[None] == (1, "n")
