"""Samples as long tables ``clip_id, ch, i, v``: levels, channels, envelopes, decoded WAV files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.functions import music

FRAMES_A_BATCH = 1 << 16


def decoded(files: DataFrame, mono: bool = False) -> DataFrame:
    """``path, rate, ch, i, v`` of 16-bit PCM files in ``path, content``; files that cannot be read give no rows.

    A file is decoded ``FRAMES_A_BATCH`` frames at a time; ``mono`` takes the mean of the channels.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    source = wave.open(io.BytesIO(content))
                except (wave.Error, EOFError):
                    continue
                channels, rate, at = source.getnchannels(), source.getframerate(), 0
                if source.getsampwidth() != 2:
                    continue
                while raw := source.readframes(FRAMES_A_BATCH):
                    # A file that was cut off may end within a frame.
                    x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels) / 32767.0
                    x = x.mean(axis=1, keepdims=True) if mono else x
                    frames = np.repeat(np.arange(at, at + len(x)), x.shape[1])
                    yield pd.DataFrame({"path": path, "rate": rate, "ch": np.tile(np.arange(x.shape[1], dtype=np.int32), len(x)), "i": frames, "v": x.ravel()})
                    at += len(x)

    return files.select("path", "content").mapInPandas(run, "path string, rate int, ch int, i long, v double")


def peak(samples: DataFrame) -> DataFrame:
    """``clip_id, peak, peak_db``; silence is minus infinity."""
    return samples.groupBy("clip_id").agg(F.max(F.abs("v")).alias("peak")).withColumn("peak_db", music.gain_db(F.col("peak")))


def normalized_peak(samples: DataFrame, target: float) -> DataFrame:
    """Samples scaled so that the largest is ``target``; silence stays."""
    p = peak(samples).select("clip_id", "peak")
    return samples.join(p, "clip_id").withColumn("v", F.when(F.col("peak") > 0, F.col("v") * target / F.col("peak")).otherwise(F.col("v"))).drop("peak")


def stereo(samples: DataFrame) -> DataFrame:
    """Two channels: one is heard on both, those beyond two go."""
    most = F.max("ch").over(Window.partitionBy("clip_id"))
    return samples.filter("ch < 2").withColumn("_most", most).withColumn("ch", F.explode(F.when(F.col("_most") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array("ch")))).drop("_most")


def target_gain(lufs: Column, target: float, most_db: float = 18.0) -> Column:
    """The gain that brings a loudness to ``target``, by 18 dB at most; silence is left alone."""
    delta = F.greatest(F.lit(-most_db), F.least(F.lit(most_db), target - lufs))
    return F.when(F.abs(lufs) < float("inf"), music.db_gain(delta)).otherwise(1.0)


def pump(i: Column, rate: int, bpm: Column, depth: float = 0.45, recovery: float = 0.62) -> Column:
    """Gain of a sample: a dip on each beat that recovers before the next; 1 without a tempo."""
    beat = F.greatest(F.lit(1), F.floor(60.0 / F.nullif(bpm, F.lit(0.0)) * rate))
    depth = max(0.0, min(0.95, depth))
    phase = F.pmod(i, beat) / beat
    return F.when(bpm > 0, 1 - depth + depth * (1 - F.exp(-phase / max(recovery * 0.25, 1e-4)))).otherwise(1.0)


def pumped(samples: DataFrame, rate: int, bpm: Column, depth: float = 0.45, offset: float = 0.0) -> DataFrame:
    """Samples under the pump, whose dips begin ``offset`` seconds early; no depth, no change."""
    if depth <= 0:
        return samples
    return samples.withColumn("v", F.col("v") * pump(F.col("i") + int(max(0.0, offset) * rate), rate, bpm, depth))


def sweep_cutoff(i: Column, n: Column, rate: int, start_hz: float, end_hz: float, block: int = 2048, low: float = 20.0, share: float = 0.99) -> Column:
    """The filter's corner for a sample: geometric from block to block, within hearing and half the rate."""
    blocks = F.ceil(n / block)
    step = F.floor(i / block) / F.greatest(blocks - 1, F.lit(1))
    return F.greatest(F.lit(low), F.least(F.lit(rate / 2 * share), start_hz * F.pow(F.lit(end_hz / start_hz), step)))


def crossfade(i: Column, n: Column) -> Column:
    """struct(out, into): equal-power gains over an overlap of ``n`` samples."""
    x = F.lit(np.pi / 2) * i / F.greatest(n - 1, F.lit(1))
    return F.struct(F.cos(x).alias("out"), F.sin(x).alias("into"))


def rendered(samples: DataFrame, clips: DataFrame) -> DataFrame:
    """Samples as they sound: faded first, then at their clip's gain; ``clips``: ``clip_id, n, fade_in, fade_out`` (in samples) and ``gain_db``."""
    quarter = lambda at, n: F.sin(F.lit(np.pi / 2) * at / F.nullif(n - 1, F.lit(0)))
    i, n = F.col("i"), F.col("n")
    up, down = F.least("fade_in", "n"), F.least("fade_out", "n")
    gain = F.when((up > 1) & (i < up), quarter(i, up)).otherwise(1.0) * F.when((down > 1) & (n - 1 - i < down), quarter(n - 1 - i, down)).otherwise(1.0)
    return samples.join(clips, "clip_id").withColumn("v", F.col("v") * gain * music.db_gain(F.col("gain_db"))).select(*samples.columns)


def summed(layers: DataFrame) -> DataFrame:
    """The sum of a clip's layers over the samples that all of them have: ``clip_id, layer, i, v`` in, ``clip_id, i, v`` out."""
    n = layers.groupBy("clip_id").agg(F.countDistinct("layer").alias("n"))
    return layers.groupBy("clip_id", "i").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("c")).join(n, "clip_id").filter("c = n").select("clip_id", "i", "v")


def decimated(points: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th point."""
    return points.filter(F.pmod("i", F.lit(max(1, step))) == 0)


def beat_features(frames: DataFrame, repeats: dict[str, int], width: int = 4) -> DataFrame:
    """``track_id, i, features``: medians of each feature between beats, standardised, repeated by weight, and smoothed over beats.

    ``frames``: ``track_id, i`` (the beat), ``name, k, v``; a feature's row ``k``
    is standardised over its track's beats. Beyond the ends the nearest beat counts.
    """
    synced = frames.groupBy("track_id", "i", "name", "k").agg(F.percentile("v", 0.5).alias("v"))
    row = Window.partitionBy("track_id", "name", "k")
    sd = F.stddev_pop("v").over(row)
    z = synced.withColumn("z", (F.col("v") - F.avg("v").over(row)) / F.when(sd < 1e-9, 1.0).otherwise(sd))
    times = F.lit(1)
    for name, n in repeats.items():
        times = F.when(F.col("name") == name, n).otherwise(times)
    ordered = row.orderBy("i")
    first, last = F.first("z").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("z").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    back, ahead = width // 2, width - 1 - width // 2
    near = [F.coalesce((F.lag if o < 0 else F.lead)("z", abs(o)).over(ordered), first if o < 0 else last) for o in range(-back, ahead + 1)]
    smooth = z.withColumn("s", sum(near[1:], near[0]) / width)
    return smooth.withColumn("_r", F.explode(F.sequence(F.lit(1), times))).groupBy("track_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "k", "_r", "s"))), lambda x: x["s"]).alias("features"))
