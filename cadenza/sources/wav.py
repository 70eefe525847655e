"""WAV files from long tables of samples, as binary parts: 16-bit PCM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

FRAMES = 1 << 15


def little_endian(x: Column, n_bytes: int) -> Column:
    """The hex digits of a whole number, lowest byte first; negative ones wrap."""
    digits = F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << (8 * n_bytes)))), 2 * n_bytes, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n_bytes))])


def pcm16(v: Column) -> Column:
    """A sample of -1 to 1 as a 16-bit whole number; louder ones are cut, null and NaN are silence."""
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))) * 32767).cast("int")


def wav_parts(samples: DataFrame, rate: int, channels: int = 1) -> DataFrame:
    """``clip_id, part, bytes``: a clip's file is its parts in order, of which 0 is the header.

    ``samples`` has ``clip_id, i, v`` and, for more channels, ``ch`` (from 0); ``i`` is dense from 0.
    A part holds ``FRAMES`` frames at most.
    """
    ch = F.col("ch") if channels > 1 else F.lit(0)
    told = samples.select("clip_id", "i", ch.alias("ch"), little_endian(pcm16(F.col("v")), 2).alias("h"))
    body = told.groupBy("clip_id", (F.expr(f"i div {FRAMES}") + 1).alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", "ch", "h"))).alias("a"))
    data = body.select("clip_id", "part", F.unhex(F.array_join(F.col("a.h"), "")).alias("bytes"))
    size = told.groupBy("clip_id").agg((2 * F.count(F.lit(1))).alias("n"))
    name = lambda x: F.lit(x.encode().hex())
    whole = lambda x, n: little_endian(F.lit(x), n)
    form = F.concat(name("WAVEfmt "), whole(16, 4), whole(1, 2), whole(channels, 2), whole(rate, 4), whole(2 * channels * rate, 4), whole(2 * channels, 2), whole(16, 2))
    header = F.concat(name("RIFF"), little_endian(F.col("n") + 36, 4), form, name("data"), little_endian(F.col("n"), 4))
    return size.select("clip_id", F.lit(0).cast("long").alias("part"), F.unhex(header).alias("bytes")).unionByName(data)


def write_files(parts: DataFrame, path: str) -> DataFrame:
    """Join ``wav_parts`` into one file a clip below ``path``, a folder that executors share or a store's address: ``clip_id, path, bytes``.

    A clip's parts meet in one task, in order, one at a time. A file takes its
    name when it is whole, so a task that runs again leaves the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        mine, clip, out, size, done = f"{root}/part-{TaskContext.get().taskAttemptId()}.tmp", None, None, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(mine, f"{root}/{clip}.wav")
                done.append((clip, f"{root}/{clip}.wav", size))

        for batch in batches:
            for c, held in zip(batch["clip_id"], batch["bytes"], strict=True):
                if c != clip:
                    close()
                    clip, out, size = c, store.open_output_stream(mine), 0
                out.write(held)
                size += len(held)
        close()
        yield pd.DataFrame(done, columns=["clip_id", "path", "bytes"])

    return parts.select("clip_id", "part", "bytes").repartition("clip_id").sortWithinPartitions("clip_id", "part").mapInPandas(run, "clip_id long, path string, bytes long")


def sidecars(tracklists: DataFrame, group: str = "set_id") -> DataFrame:
    """``group, value``: each set's events in order as one JSON text, with its letters unescaped."""
    events = F.array_sort(F.collect_list(F.struct("place", "time", "timecode", "kind", "label", "track_id")))
    return tracklists.groupBy(group).agg(F.to_json(events).alias("value"))
