"""Treatments of a join by name: what leaves and what comes, over their overlap.

A side is half of a clip at most, and is treated by itself: one may be silence while
the other is made elsewhere. ``filters`` has the same filters for samples of any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cadenza.operators import blocks

KEYS = ["join_id"]
#: The options each treatment has unless others are given, and the samples for which a gliding corner stays.
OPTIONS = {
    "bass_swap": {"crossover_hz": 220.0, "swap_at": 0.5},
    "filter_sweep": {"start_hz": 20000.0, "end_hz": 400.0},
    "echo_out": {"delay_beats": 0.75, "feedback": 0.45, "mix": 0.35},
}
DEFAULT = "bass_swap"
GLIDE = 2048


def filtered(x: np.ndarray, hz: float, rate: float, kind: str, order: int = 1) -> np.ndarray:
    """From rest through ``filters.first_order`` or ``second_order``."""
    k = math.tan(math.pi * hz / rate)
    if order == 1:
        b = (k if kind == "low" else 1.0) / (1 + k)
        b0, b1, b2, a1, a2 = b, b if kind == "low" else -b, 0.0, (k - 1) / (k + 1), 0.0
    else:
        whole = 1 + math.sqrt(2) * k + k * k
        b = (k * k if kind == "low" else 1.0) / whole
        b0, b1, b2, a1, a2 = b, 2 * b if kind == "low" else -2 * b, b, 2 * (k * k - 1) / whole, (1 - math.sqrt(2) * k + k * k) / whole
    if not x.any():
        return np.zeros(len(x))
    s1 = s2 = 0.0
    y = []
    for v in x.tolist():
        w = b0 * v + s1
        s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
        y.append(w)
    return np.array(y)


def glided(x: np.ndarray, rate: float, start_hz: float, end_hz: float, kind: str, order: int, low: float, share: float) -> np.ndarray:
    """Through a filter whose corner glides (``sound.sweep_cutoff``), each ``GLIDE`` samples from rest."""
    steps = max(math.ceil(len(x) / GLIDE) - 1, 1)
    corner = lambda j: max(low, min(rate / 2 * share, start_hz * (end_hz / start_hz) ** (j / steps)))
    return np.concatenate([x[:0], *[filtered(x[a : a + GLIDE], corner(a // GLIDE), rate, kind, order) for a in range(0, len(x), GLIDE)]])


def bass_swap(gone: np.ndarray, come: np.ndarray, rate: float, bpm: float, crossover_hz: float, swap_at: float) -> tuple[np.ndarray, np.ndarray]:
    """Only one side has its low end: what leaves loses it at the swap, what comes has none before."""
    swap = math.floor(len(gone) * swap_at)
    high = lambda x: filtered(x, crossover_hz, rate, "high")
    return np.concatenate([gone[:swap], high(gone[swap:])]), np.concatenate([high(come[:swap]), come[swap:]])


def filter_sweep(gone: np.ndarray, come: np.ndarray, rate: float, bpm: float, start_hz: float, end_hz: float) -> tuple[np.ndarray, np.ndarray]:
    """A low-pass closes over what leaves while it opens over what comes."""
    swept = lambda x, a, b: glided(x, rate, a, b, "low", 1, 20.0, 0.99)
    return swept(gone, start_hz, end_hz), swept(come, end_hz, start_hz)


def echo_out(gone: np.ndarray, come: np.ndarray, rate: float, bpm: float, delay_beats: float, feedback: float, mix: float) -> tuple[np.ndarray, np.ndarray]:
    """What leaves goes into a delay on the beat."""
    d = max(1, math.floor(delay_beats * 60.0 / max(bpm, 1e-6) * rate))
    late = np.zeros(len(gone))
    for a in range(d, len(gone), d):
        m = min(d, len(gone) - a)
        late[a : a + m] = gone[a - d : a - d + m] + feedback * late[a - d : a - d + m]
    return (1 - mix) * gone + mix * late, come


TREATMENTS: dict[str, Callable] = {"bass_swap": bass_swap, "filter_sweep": filter_sweep, "echo_out": echo_out}


def treat(name: str | None, gone: np.ndarray, come: np.ndarray, rate: float, bpm: float, options: dict[str, dict] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both sides after the treatment ``name`` and the equal-power crossfade. A name that is not known, or none, is the default's."""
    known = name if name in TREATMENTS else DEFAULT
    gone, come = TREATMENTS[known](gone, come, rate, bpm, **OPTIONS[known] | (options or {}).get(known, {}))
    x = np.pi / 2 * np.arange(len(gone)) / max(len(gone) - 1, 1)
    return gone * np.cos(x), come * np.sin(x)


def built(x: np.ndarray, rate: float, bpm: float, bars: int) -> np.ndarray:
    """``filters.filter_build`` of a join's side."""
    from_ = max(0, len(x) - math.floor(bars * 240.0 / max(bpm, 1e-6) * rate)) if bars > 0 else len(x)
    return np.concatenate([x[:from_], glided(x[from_:], rate, 30.0, 1800.0, "high", 2, 25.0, 0.95)])


def treated(samples: DataFrame, rate: float, options: dict[str, dict] | None = None) -> DataFrame:
    """``join_id, i, gone, come`` after each join's treatment and the equal-power crossfade.

    ``samples``: ``join_id, i, n, gone, come, bpm, name``, ``i`` dense from 0 to ``n`` - 1.
    """
    at = F.struct("i", F.coalesce("gone", F.lit(0.0)).alias("gone"), F.coalesce("come", F.lit(0.0)).alias("come"))
    met = samples.groupBy(*KEYS).agg(F.first("bpm").alias("bpm"), F.first("name").alias("name"), F.array_sort(F.collect_list(at)).alias("z"))
    rows = met.select(*KEYS, "bpm", "name", F.col("z.gone").alias("gone"), F.col("z.come").alias("come"))
    done = blocks.by_row(rows, {"gone": "array<double>", "come": "array<double>"}, lambda row: treat(row.name, row.gone, row.come, rate, row.bpm, options), ("bpm", "name"))
    return done.select(*KEYS, F.posexplode(F.arrays_zip("gone", "come")).alias("i", "z")).select(*KEYS, F.col("i").cast("long").alias("i"), "z.gone", "z.come")
