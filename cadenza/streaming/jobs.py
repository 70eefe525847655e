"""Job events: latest state in batch, and the same as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.store import shared_path

FINISHED = ("done", "failed", "cancelled")
RETENTION_MS = 3_600_000


def status(stage):
    """The state after an event; ``cancel`` is a control event."""
    return F.when(stage == "purchase", "done").when(stage == "error", "failed").when(stage == "cancel", "cancelled").otherwise("running")


def job_events(events: DataFrame) -> DataFrame:
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 500))
    return events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("stage"), progress.alias("progress"), status(F.col("event_type")).alias("status"))


def rescaled(progress, low: float = 0.70, high: float = 0.98):
    """A part's progress as a share of the whole job's."""
    return low + (high - low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))


def shown(states: DataFrame) -> DataFrame:
    """A job as others see it: its result only once it is done."""
    return states.withColumn("result", F.when(F.col("status") == "done", F.col("result"))).withColumn("progress", F.round("progress", 4))


def latest_state(events: DataFrame) -> DataFrame:
    """Works on a batch, and on a stream in update or complete mode."""
    last = F.max_by(F.struct("stage", "status", "progress"), F.struct("ts", "event_id")).alias("s")
    return events.groupBy("job_id").agg(last, F.count(F.lit(1)).alias("n")).select("job_id", "s.stage", "s.status", F.round("s.progress", 6).alias("progress"), "n")


def sse(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct("job_id", "stage", "progress")), F.lit("\n\n")).alias("frame"))


def run_through(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream to its end into files below the shared folder; its last batch's rows (complete mode) or all (append).

    Batches are files written by their number, so a batch that runs again writes
    the same; nothing passes through the driver, and a stream that is started
    anew in one session has a folder and a checkpoint of its own.
    """
    spark = stream.sparkSession
    path = shared_path(spark)
    seen: list[int] = []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    numbers = seen[-1:] if mode == "complete" else seen
    return spark.read.schema(stream.schema).parquet(*[f"{path}/rows/batch={n}" for n in numbers])


def stream_states(source: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The latest states after a stream of raw events: replays give the batch result, doubles count once."""
    once = job_events(source).withWatermark("ts", watermark).dropDuplicates(["event_id", "ts"])
    return run_through(latest_state(once), "complete")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A finished job takes no further events, and is forgotten an hour after its end: then it starts anew."""
    if state.hasTimedOut:
        state.remove()
        return
    stage, status_, progress, n, ended = state.get if state.exists else (None, "pending", 0.0, 0, None)
    rows, at = pd.concat(list(frames)).sort_values(["ts", "event_id"]), None
    for r in rows.itertuples():
        if status_ in FINISHED:
            if r.ts.timestamp() * 1000 - ended < RETENTION_MS:
                continue
            n = 0
        stage, status_, progress, n, at = r.stage, r.status, float(r.progress), n + 1, int(r.ts.timestamp() * 1e6)
        ended = int(r.ts.timestamp() * 1000) if status_ in FINISHED else None
    state.update((stage, status_, progress, n, ended))
    if ended is not None:
        state.setTimeoutTimestamp(max(ended, state.getCurrentWatermarkMs()) + RETENTION_MS)
    if at is not None:
        yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "status": [status_], "progress": [round(progress, 6)], "n": [n], "at": [at]})


def stream_machine(source: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The state machine over a stream of raw events, run to its end: the last state of each job.

    A finished, failed or cancelled job refuses further events, cancels too. A
    job that starts anew after it was forgotten is told by its later run.
    """
    once = job_events(source).withWatermark("ts", watermark).dropDuplicates(["event_id", "ts"])
    states = once.groupBy("job_id").applyInPandasWithState(
        _advance, "job_id long, stage string, status string, progress double, n long, at long",
        "stage string, status string, progress double, n long, ended long", "append", GroupStateTimeout.EventTimeTimeout,
    )
    told = run_through(states, "append")
    return told.groupBy("job_id").agg(F.max_by(F.struct("stage", "status", "progress", "n"), F.struct("at", "n")).alias("s")).select("job_id", "s.*")
