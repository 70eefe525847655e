"""Those who follow a running stream of events: each once, keepalives between, nothing after the end."""

import os
import time

from pyspark.sql import functions as F

from cadenza.streaming import tail

SCHEMA = "event_id long, ts string, user_id long, event_type string, value double"


def write(spark, folder, name, rows):
    """Whole files only: written aside, then moved in."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    df.write.parquet(f"{folder}-{name}")
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def seen(spark, path):
    if not os.path.exists(f"{path}/frames"):
        return []
    got = spark.read.schema("job_id long, n long, frame string, batch int").option("basePath", f"{path}/frames").parquet(f"{path}/frames").collect()
    return sorted(((r["batch"], r["n"], r["job_id"], r["frame"]) for r in got))


def until(spark, path, right, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        rows = seen(spark, path)
        if right(rows):
            return rows
        time.sleep(0.5)
    raise AssertionError(f"not in time: {seen(spark, path)}")


def test_tail_with_keepalives_and_a_restart(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    day = "2024-01-01 00:00:0"
    write(spark, src, "a", [(1, day + "1", 7, "start", 50.0), (2, day + "2", 7, "half", 250.0), (3, day + "2", 8, "purchase", 500.0), (4, day + "3", 8, "late", 1.0)])
    schema = spark.read.parquet(src).schema

    def follow():
        return tail.subscribe(tail.frames(spark.readStream.schema(schema).parquet(src), 1.0), path)

    query = follow()
    try:
        # Job 7 is open and silent; job 8 is at its end.
        rows = until(spark, path, lambda rows: any(r[3] == tail.KEEPALIVE for r in rows))
    finally:
        query.stop()
    assert {r[2] for r in rows if r[3] == tail.KEEPALIVE} == {7}
    # One event comes again, and one ends the job, while no one follows.
    write(spark, src, "b", [(2, day + "2", 7, "half", 250.0), (5, day + "4", 7, "purchase", 500.0), (6, day + "5", 7, "late", 9.0)])
    query = follow()
    try:
        until(spark, path, lambda rows: any('"purchase"' in r[3] and r[2] == 7 for r in rows))
        last = max(r[0] for r in seen(spark, path) if "purchase" in r[3])
        time.sleep(3)
    finally:
        query.stop()
    rows = seen(spark, path)
    events = [(r[2], r[1], r[3].split('"stage":"')[1].split('"')[0]) for r in rows if r[3] != tail.KEEPALIVE]
    assert sorted(events) == [(7, 1, "start"), (7, 2, "half"), (7, 3, "purchase"), (8, 1, "purchase")]
    assert not [r for r in rows if r[3] == tail.KEEPALIVE and r[0] > last]
