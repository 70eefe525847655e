"""Events of running jobs as frames for those who follow them, with keepalives while nothing happens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.streaming.jobs import FINISHED, job_events

# The frame that keeps a connection open, and how long nothing has happened by then.
KEEPALIVE, IDLE_SECONDS = ": keepalive\n\n", 15.0


def frames(source: DataFrame, idle_seconds: float | None = IDLE_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """``job_id, n, frame`` of a stream of raw events: each event once, in the order of its batch, up to the job's end.

    Whoever starts the stream gets a job's events from the first on. ``n``
    numbers a job's events; a job that is not finished and has been silent for
    ``idle_seconds`` sends a keepalive with the number of its last event. With
    ``None`` there are no keepalives.
    """
    idle_ms = None if idle_seconds is None else max(1, int(idle_seconds * 1000))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ended = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.setTimeoutDuration(idle_ms)
            yield pd.DataFrame({"job_id": [key[0]], "n": [n], "frame": [KEEPALIVE]})
            return
        rows, sent = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        for status, frame in zip(rows["status"], rows["frame"], strict=True):
            if not ended:
                n += 1
                sent.append((key[0], n, frame))
                ended = status in FINISHED
        state.update((n, ended))
        if idle_ms and not ended:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(sent, columns=["job_id", "n", "frame"])

    told = job_events(source).withColumn("frame", F.concat(F.lit("data: "), F.to_json(F.struct("job_id", "stage", "progress")), F.lit("\n\n")))
    once = told.withWatermark("ts", watermark).dropDuplicates(["event_id", "ts"]).select("job_id", "ts", "event_id", "status", "frame")
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return once.groupBy("job_id").applyInPandasWithState(follow, "job_id long, n long, frame string", "n long, ended boolean", "append", timeout)


def subscribe(stream: DataFrame, path: str, every: str = "1 second") -> StreamingQuery:
    """Follow ``frames`` into files below ``path``, a folder a batch that has any, until the query is stopped.

    Started again on the same path, it goes on where it ended; a batch that
    runs twice writes the same folder.
    """

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/frames/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep).trigger(processingTime=every).start()
