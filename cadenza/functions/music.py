"""Tempo, key, chroma and energy arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from cadenza.config import DEFAULT


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bind(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def rank_score(rank: Column, size: int = DEFAULT.chart_size) -> Column:
    """1 for the first place, falling with the logarithm to 0 at ``size``."""
    return F.when(rank < 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.ln(rank.cast("double")) / math.log(size)))


def tempo(a: Column, b: Column, tolerance: float = DEFAULT.tempo_tolerance, three_two: bool = False) -> Column:
    """struct(score, ratio, stretch): the best allowed ratio of ``b`` to ``a``, the first listed on ties."""
    ratios = [(1.0, 1.0), (2.0, 0.92), (0.5, 0.92)] + ([(1.5, 0.82), (2 / 3, 0.82)] if three_two else [])
    dev = lambda ratio: F.abs(b * ratio - a) / a
    scores = [F.when((a > 0) & (b > 0) & (dev(ratio) <= tolerance), (1 - dev(ratio) / tolerance) * penalty).otherwise(0.0) for ratio, penalty in ratios]
    best = F.greatest(*scores)
    found = F.when(best > 0, F.lit(None).cast("double"))
    for (ratio, _), score in zip(reversed(ratios), reversed(scores), strict=True):
        found = F.when(score == best, F.lit(ratio)).otherwise(found)
    ratio = F.when(best > 0, found).otherwise(1.0)
    return F.struct(best.alias("score"), ratio.alias("ratio"), F.when(best > 0, a / (b * ratio)).otherwise(1.0).alias("stretch"))


def fold_tempo(bpm: Column, low: float = 82.0, high: float = 164.0) -> Column:
    """struct(bpm, factor): up to four doublings or halvings into [low, high]; 0 or less gives (0, 1)."""
    by = lambda x: F.when(x["bpm"] < low, 2.0).when(x["bpm"] > high, 0.5).otherwise(1.0)
    x = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(bpm.cast("double").alias("bpm"), F.lit(1.0).alias("factor")), lambda x, _: F.struct((x["bpm"] * by(x)).alias("bpm"), (x["factor"] * by(x)).alias("factor")))
    return F.when(bpm > 0, x).otherwise(F.struct(F.lit(0.0).alias("bpm"), F.lit(1.0).alias("factor")))


def stretch_to(bpm: Column, target: Column) -> Column:
    """struct(rate, deviation): the gentlest stretch to ``target`` over octave ratios; invalid tempi give (1, 1)."""
    options = []
    for i, ratio in enumerate((0.25, 0.5, 1.0, 2.0, 4.0)):
        rate = target / (bpm * ratio)
        options.append(F.struct((F.greatest(rate, 1 / rate) - 1).alias("deviation"), F.lit(i).alias("ord"), rate.alias("rate")))
    best = F.array_min(F.array(*options))
    return F.when((bpm > 0) & (target > 0), F.struct(best["rate"].alias("rate"), best["deviation"].alias("deviation"))).otherwise(F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("deviation")))


def camelot_number(pc: Column, minor: Column) -> Column:
    """1 to 12: the wheel's hour; a minor key has that of its relative major."""
    return F.pmod(F.pmod(F.when(minor, pc + 3).otherwise(pc), F.lit(12)) * 7 % 12 + 7, F.lit(12)) + 1


def camelot(pc: Column, minor: Column) -> Column:
    return F.concat(camelot_number(pc, minor).cast("int").cast("string"), F.when(minor, "A").otherwise("B"))


def pitch_of(code: Column) -> Column:
    """The inverse: struct(pitch_class, mode)."""
    hour, minor = F.regexp_extract(code, r"^(\d+)", 1).cast("int"), F.upper(F.right(code, F.lit(1))) == "A"
    major = F.pmod((hour - 8) * 7, F.lit(12))
    return F.struct(F.when(minor, F.pmod(major - 3, F.lit(12))).otherwise(major).alias("pitch_class"), F.when(minor, "minor").otherwise("major").alias("mode"))


def wheel_distance(na: Column, ma: Column, nb: Column, mb: Column) -> Column:
    hours = F.least(F.pmod(na - nb, F.lit(12)), F.pmod(nb - na, F.lit(12)))
    return F.when(ma == mb, hours).when(na == nb, F.lit(1)).otherwise(hours + 2)


def wheel_score(d: Column) -> Column:
    return F.when(d == 0, 1.0).when(d == 1, 0.85).when(d == 2, 0.55).when(d == 3, 0.3).otherwise(F.greatest(F.lit(0.0), 0.2 - 0.05 * (d - 4)))


def best_shifts(max_shift: int) -> list[tuple[float, int, int]]:
    """(score, shift, distance) of any two keys: pitches and modes (major, minor, unknown) of ``a``, then of ``b``, in this order."""

    def hour(pitch, mode):
        return ((pitch + 3 if mode == 1 else pitch) % 12 * 7 % 12 + 7) % 12 + 1

    def far(a, ma, b, mb):
        hours = min((a - b) % 12, (b - a) % 12)
        return hours if ma == mb != 2 else 1 if a == b else hours + 2

    def told(pa, ma, pb, mb):
        options = []
        for shift in range(-max_shift, max_shift + 1):
            d = far(hour(pa, ma), ma, hour((pb + shift) % 12, mb), mb)
            options.append(({0: 1.0, 1: 0.85, 2: 0.55, 3: 0.3}.get(d, max(0.0, 0.2 - 0.05 * (d - 4))) - 0.04 * abs(shift), -shift, d))
        score, turned, d = max(options)
        return min(1.0, max(0.0, score)), -turned, d

    return [told(pa, ma, pb, mb) for pa in range(12) for ma in range(3) for pb in range(12) for mb in range(3)]


def key_match(pa: Column, ma: Column, pb: Column, mb: Column, ca: Column, cb: Column, max_shift: int = DEFAULT.max_pitch_shift, floor: float = DEFAULT.key_floor) -> Column:
    """struct(score, shift, distance): the best shift of ``b``, the lowest on ties; weak estimates fade to 0.5. All pairs of keys are a literal."""
    mode = lambda m: F.when(m.isNull(), 2).when(m, 1).otherwise(0)
    at = ((F.pmod(pa, F.lit(12)) * 3 + mode(ma)) * 12 + F.pmod(pb, F.lit(12))) * 3 + mode(mb)
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(ca, cb) / floor)) if floor > 0 else F.lit(1.0)
    raw, shift, distance = (F.get(F.lit(list(x)), at.cast("int")) for x in zip(*best_shifts(max_shift), strict=True))
    return F.struct((weight * raw + (1 - weight) * 0.5).alias("score"), shift.alias("shift"), distance.alias("distance"))


def rotate(a: Column, s: Column) -> Column:
    """The array turned ``s`` places to the right."""
    k = F.pmod(s, F.size(a))
    return F.when(k == 0, a).otherwise(F.concat(F.slice(a, F.size(a) - k + 1, k), F.slice(a, F.lit(1), F.size(a) - k)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for another length than 12 or a zero norm; otherwise clipped to 0..1."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 12) & (F.size(b) == 12) & (norms > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / F.nullif(norms, F.lit(0.0))))).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length 1; null for another length than 12 or a zero norm."""
    norm = F.sqrt(dot(a, a))
    return bind(norm, lambda n: F.when((F.size(a) == 12) & (n > 0), F.transform(a, lambda x: x / n)))


def turned_dot(a: Column, b: Column, s: Column) -> Column:
    """The cosine of two unit vectors of 12, ``b`` turned ``s`` places right; clipped to 0..1, 0 if one is null."""
    total = sum((F.get(a, F.lit(i)) * F.get(b, F.pmod(F.lit(i) - s, F.lit(12)).cast("int")) for i in range(1, 12)), F.get(a, F.lit(0)) * F.get(b, F.pmod(-s, F.lit(12)).cast("int")))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), F.lit(0.0))


def energy(a: Column, b: Column, intent: str = "match", tolerance: float = DEFAULT.match_tolerance, target: float = DEFAULT.build_target) -> Column:
    delta = b - a
    error = {"build": F.abs(delta - target) / target, "drop": F.abs(delta + target) / target}.get(intent, F.abs(delta) / tolerance)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - error))


def db_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def gain_db(gain: Column) -> Column:
    """Silence is minus infinity."""
    return F.when(gain <= 0, F.lit(float("-inf"))).otherwise(20 * F.log10(gain))


def arc(i: Column, n: Column) -> Column:
    """The energy wanted at slot ``i`` of ``n``: up to 0.95 at three quarters, then down to 0.6."""
    x = i / F.nullif(n - 1, F.lit(0))
    return F.when(n <= 1, 0.6).when(x <= 0.75, 0.45 + (x / 0.75) * 0.5).otherwise(0.95 - (x - 0.75) / 0.25 * 0.35)
