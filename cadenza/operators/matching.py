"""Pair scores, set tempo, running order, plans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from cadenza.config import DEFAULT, Tuning
from cadenza.functions import music
from cadenza.operators.store import kept as stored


def score_tracks(pairs: DataFrame, tuning: Tuning = DEFAULT) -> DataFrame:
    """Tempo and key terms, once per track pair (columns ``a_*`` and ``b_*``)."""
    c = F.col
    return pairs.withColumn("tempo", music.tempo(c("a_bpm"), c("b_bpm"), tuning.tempo_tolerance)).withColumn(
        "key", music.key_match(c("a_pitch_class"), c("a_minor"), c("b_pitch_class"), c("b_minor"), c("a_confidence"), c("b_confidence"), tuning.max_pitch_shift, tuning.key_floor)
    )


def side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(x).alias(f"{prefix}_{x}") for x in df.columns])


#: Sections of a track that meet in one row, and pairs of sections that a task scores at a time.
BLOCK, AT_ONCE = 128, 1 << 18
IDS = ("a_track_id", "b_track_id")


def packed(sections: DataFrame, chroma: DataFrame, extra: tuple[str, ...] = (), tuning: Tuning = DEFAULT) -> DataFrame:
    """``track_id`` and arrays of its long sections (with columns ``extra``), ``BLOCK`` at most a row; ``units`` holds twelve values a section.

    A section's ``bonus_a`` and ``bonus_b`` count where it comes first or second; without such columns they are 0.
    """
    told = {x: F.col(x).cast("double") if x in sections.columns else F.lit(0.0) for x in ("bonus_a", "bonus_b")}
    units = chroma.select("vec_id", F.coalesce(music.unit(F.col("chroma")), F.array(*[F.lit(0.0)] * 12)).alias("units"))
    long = sections.filter(F.col("end") - F.col("start") >= tuning.min_section).withColumns(told).select("track_id", "vec_id", F.col("idx").cast("long").alias("idx"), *[F.col(x).cast("double").alias(x) for x in ("start", "end", "energy")], *told, *extra)
    names = ("idx", "start", "end", "energy", *told, *extra)
    rows = long.join(units, "vec_id").groupBy("track_id", F.expr(f"idx div {BLOCK}").alias("_block")).agg(F.collect_list(F.struct(*names, "units")).alias("z"))
    return rows.select("track_id", *[F.col(f"z.{x}").alias(x) for x in names], F.flatten("z.units").alias("units"))


def parted(scored: DataFrame, sections: DataFrame, chroma: DataFrame, extra: tuple[str, ...] = (), tuning: Tuning = DEFAULT) -> DataFrame:
    """Long sections (with columns ``extra``) as rows of the track pairs that they belong to: ``a_track_id, b_track_id, first``; ``units`` holds twelve values.

    ``bonus`` is a section's ``bonus_a`` where it comes first, else its ``bonus_b``;
    without such columns 0. Rows go to their vectors before they go to their pair,
    so a vector's rows travel together and it takes next to no room in the shuffle.
    """
    told = {x: F.col(x).cast("double") if x in sections.columns else F.lit(0.0) for x in ("bonus_a", "bonus_b")}
    role = lambda x, first: F.struct(F.col(f"{x}_track_id").alias("track_id"), F.lit(first).alias("first"))
    roles = scored.select(*IDS, F.explode(F.array(role("a", True), role("b", False))).alias("r")).select(*IDS, "r.*")
    units = chroma.select("vec_id", F.coalesce(music.unit(F.col("chroma")), F.array(*[F.lit(0.0)] * 12)).alias("units"))
    long = sections.filter(F.col("end") - F.col("start") >= tuning.min_section).withColumns(told).select("track_id", "vec_id", F.col("idx").cast("long").alias("idx"), *[F.col(x).cast("double").alias(x) for x in ("start", "end", "energy")], *told, *extra)
    met = long.join(roles, "track_id").withColumn("bonus", F.when(F.col("first"), F.col("bonus_a")).otherwise(F.col("bonus_b")))
    return met.select(*IDS, "first", "vec_id", "idx", "start", "end", "energy", "bonus", *extra).repartition("vec_id").join(units, "vec_id").drop("vec_id")


def whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, those of a track pair in one batch; they come one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = pair_starts(batch)
        fresh = bool(held) and any(held[-1].column(x)[-1] != batch.column(x)[0] for x in IDS)
        cut = int(begins[-1])
        if held and (fresh or cut):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pair_starts(batch: pa.RecordBatch) -> np.ndarray:
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for x in IDS:
        column = batch.column(x)
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def blocks_met(batch: pa.RecordBatch, told: list[str], extra: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks of sections, of ``BLOCK`` at most, from the sections of whole pairs (those that come first, then the others): columns ``told`` once, sections as lists."""
    column = lambda x: batch.column(batch.schema.get_field_index(x))
    begin = pair_starts(batch)
    size = np.diff(np.append(begin, batch.num_rows))
    na = np.add.reduceat(column("first").to_numpy(zero_copy_only=False).astype(np.int64), begin)
    n = {"a": na, "b": size - na}
    ka, kb = (-(-n[p] // BLOCK) for p in "ab")
    rows = ka * kb
    pair = np.repeat(np.arange(len(begin)), rows)
    k = np.arange(len(pair)) - (np.cumsum(rows) - rows)[pair]
    at = {"a": k // np.maximum(kb, 1)[pair] * BLOCK, "b": k % np.maximum(kb, 1)[pair] * BLOCK}
    lengths = {p: np.minimum(BLOCK, n[p][pair] - at[p]) for p in "ab"}
    low = {"a": begin[pair] + at["a"], "b": (begin + na)[pair] + at["b"]}
    units = column("units").flatten().to_numpy(zero_copy_only=False).reshape(-1, 12)
    part = np.cumsum(lengths["a"] * lengths["b"]) // AT_ONCE
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(pair)]])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo == hi:
            continue
        of = pa.array(begin[pair[lo:hi]])
        out = {x: column(x).take(of) for x in told}
        for p in "ab":
            until = np.cumsum(lengths[p][lo:hi])
            ends = np.concatenate([[0], until])
            take = np.repeat(low[p][lo:hi] - ends[:-1], lengths[p][lo:hi]) + np.arange(ends[-1])
            listed = lambda values, ends=ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            chosen = pa.array(take)
            out |= {f"{p}_{x}": listed(column(x).take(chosen)) for x in ("idx", "start", "end", "energy")} | {f"{p}_bonus_{p}": listed(column("bonus").take(chosen))}
            out |= {f"{p}_{x}": listed(column(x).take(chosen)) for x in extra}
            out[f"{p}_units"] = listed(pa.array(units[take].ravel()), ends * 12)
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def paired(batch: pa.RecordBatch, extra: tuple[str, ...], by: tuple[str, ...], n: int | None, least: float, tuning: Tuning) -> Iterator[pa.RecordBatch]:
    """The pairs of each row's sections: all, or those among its ``n`` best by any of ``by``; whole slices of rows at a time. Totals below ``least`` are left out before bonuses count."""
    w = tuning.weights.normalized()
    column = lambda x: batch.column(batch.schema.get_field_index(x))
    plain = lambda x: column(x).to_numpy(zero_copy_only=False)
    ends = {p: column(f"{p}_idx").offsets.to_numpy().astype(np.int64) for p in "ab"}
    held = {f"{p}_{x}": column(f"{p}_{x}").values.to_numpy(zero_copy_only=False) for p in "ab" for x in ("idx", "start", "end", "energy", f"bonus_{p}")}
    units = {p: (column(f"{p}_units").values.to_numpy(zero_copy_only=False), column(f"{p}_units").offsets.to_numpy()) for p in "ab"}
    sizes = {p: np.diff(ends[p]) for p in "ab"}
    part = np.cumsum(sizes["a"] * sizes["b"]) // AT_ONCE
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    base, shift = w.tempo * plain("tempo") + w.key * plain("key"), plain("shift").astype(np.int64)
    rest = [x for x in batch.schema.names if x[:2] not in ("a_", "b_") or x in ("a_track_id", "b_track_id")]
    bounded = lambda x: np.where(np.isnan(x), 1.0, np.minimum(1.0, np.maximum(0.0, x)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        na, nb = sizes["a"][lo:hi], sizes["b"][lo:hi]
        count = na * nb
        if not count.sum():
            continue
        first = np.cumsum(count) - count
        row = np.repeat(np.arange(hi - lo), count)
        k = np.arange(len(row)) - first[row]
        # Places of both sections within the slice.
        ia, ib = (ends["a"][lo:hi] - ends["a"][lo])[row] + k // nb[row], (ends["b"][lo:hi] - ends["b"][lo])[row] + k % nb[row]
        ua, ub = (units[p][0][units[p][1][lo] : units[p][1][hi]].reshape(-1, 12) for p in "ab")
        turned = np.take_along_axis(ub, (np.arange(12) - np.repeat(shift[lo:hi], nb)[:, None]) % 12, 1)
        total = ua[ia, 0] * turned[ib, 0]
        for i in range(1, 12):
            total = total + ua[ia, i] * turned[ib, i]
        like = bounded(total)
        told = {x: v[ends[x[0]][lo] : ends[x[0]][hi]][ia if x[0] == "a" else ib] for x, v in held.items()}
        delta = told["b_energy"] - told["a_energy"]
        near = {"match": np.abs(delta) / tuning.match_tolerance, "build": np.abs(delta - tuning.build_target) / tuning.build_target}
        shorter = np.minimum(told["a_end"] - told["a_start"], told["b_end"] - told["b_start"])
        sums = base[lo:hi][row] + w.chroma * like
        chosen = np.ones(len(row), dtype=bool) if n is None else np.zeros(len(row), dtype=bool)
        for name in by if n is not None else ():
            score = np.round(sums + w.energy * bounded(1 - near["match" if name == "placed" else name]), 9)
            score[score < least] = -np.inf
            if name == "placed":
                score = np.round(score + (told["a_bonus_a"] + told["b_bonus_b"]), 9)
            chosen[best_places(score, np.zeros(len(row)) if name == "placed" else shorter, told["a_idx"], told["b_idx"], row, count, n)] = True
        at = np.flatnonzero(chosen)
        rows = pa.array(row[at] + lo)
        out = {x: column(x).take(rows) for x in rest} | {"chroma": pa.array(like[at])}
        out |= {x: pa.array(v[at], from_pandas=x.endswith("energy")) for x, v in told.items()}
        out |= {f"{p}_{x}": column(f"{p}_{x}").values.take(pa.array(i[at] + ends[p][lo])) for p, i in (("a", ia), ("b", ib)) for x in extra}
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def best_places(score: np.ndarray, then: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Where the ``n`` best of each row lie: by ``score``, by ``then``, and in the order of ``a`` and ``b``."""
    some = count > 0
    first = (np.cumsum(count) - count)[some]
    if n == 1:
        least = np.maximum.reduceat(score, first)
    else:
        least = np.array([-np.inf if c <= n else np.partition(score[f : f + c], c - n)[c - n] for f, c in zip(first, count[some], strict=True)])
    reach = np.zeros(len(count))
    reach[some] = least
    at = np.flatnonzero((score >= reach[row]) & (score > -np.inf))
    at = at[np.lexsort((b[at], a[at], -then[at], -score[at], row[at]))]
    taken = np.bincount(row[at], minlength=len(count))
    return at[np.arange(len(at)) - (np.cumsum(taken) - taken)[row[at]] < n]


def section_pairs(pairs: DataFrame, tracks: DataFrame, sections: DataFrame, chroma: DataFrame, keep: tuple[str, ...] = (), tuning: Tuning = DEFAULT, by: tuple[str, ...] = (), n: int | None = None, least: float = -math.inf, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of long sections of the track pairs ``a_track_id, b_track_id`` (and columns ``keep``), scored.

    Two levels: tempo and key once per track pair, and pairs of incompatible
    tempo go before any section is read; what is left of the pairs is written
    once. Sections go from their track straight to each pair that needs them,
    once a track pair, and meet there in rows of ``BLOCK`` by ``BLOCK``.
    ``match`` and ``build`` are the totals for either intent, ``placed`` is
    ``match`` with both bonuses. All pairs come, or with ``n`` those among the
    ``n`` best of any two blocks by each of the totals ``by``, as far as these
    reach ``least``. ``extra``: further columns of the sections.
    """
    w = tuning.weights.normalized()
    t = tracks.select("track_id", "bpm", "pitch_class", "minor", "confidence")
    two = pairs.select(*IDS, *keep).join(side(t, "a"), "a_track_id").join(side(t, "b"), "b_track_id")
    told = ["tempo", "ratio", "stretch", "key", "shift", "distance"]
    scored = score_tracks(two, tuning).filter("tempo.score > 0").select(*IDS, *keep, F.col("tempo.score").alias("tempo"), "tempo.ratio", "tempo.stretch", F.col("key.score").alias("key"), "key.shift", "key.distance")
    scored = stored(scored.filter("key is not null"))
    once = scored.select(*IDS, *told).distinct()
    # The window keeps a pair's sections together and in order, whatever way they were joined.
    place = F.row_number().over(Window.partitionBy(*IDS).orderBy(F.desc("first"), "idx"))
    # As many tasks as the session says: few bytes on their way are many rows here, so tasks must not be put together by size.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parted(once, sections, chroma, extra, tuning).repartition(tasks, *IDS).join(once, list(IDS)).withColumn("place", place)
    names = [f"{p}_{x}" for p in "ab" for x in ("idx", "start", "end", "energy", f"bonus_{p}")]
    kind = ", ".join(f"{x} {'long' if x.endswith('idx') else 'double'}" for x in ["chroma", *names])
    more = [StructField(f"{p}_{x}", sections.schema[x].dataType) for p in "ab" for x in extra]
    schema = StructType([*once.schema.fields, *StructType.fromDDL(kind).fields, *more])
    met = rows.mapInArrow(lambda batches: (out for batch in whole_pairs(batches) for two in blocks_met(batch, [*IDS, *told], extra) for out in paired(two, extra, by, n, least, tuning)), schema)
    told = met.join(scored.select(*IDS, *keep), list(IDS))
    e = lambda intent: music.energy(F.col("a_energy"), F.col("b_energy"), intent, tuning.match_tolerance, tuning.build_target)
    terms = told.withColumns({"energy_match": e("match"), "energy_build": e("build"), "shorter": F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))})
    base = w.tempo * F.col("tempo") + w.key * F.col("key") + w.chroma * F.col("chroma")
    totals = terms.withColumns({"match": F.round(base + w.energy * F.col("energy_match"), 9), "build": F.round(base + w.energy * F.col("energy_build"), 9)})
    return totals.withColumn("placed", F.round(F.col("match") + (F.col("a_bonus_a") + F.col("b_bonus_b")), 9)).drop("a_bonus_a", "b_bonus_b")


def best_of(pairs: DataFrame, total: str, keep: tuple[str, ...] = (), n: int = 1) -> DataFrame:
    """The ``n`` best of each track pair by ``total``, then by the shorter section, then in the sections' order, with ``place``."""
    order = Window.partitionBy("a_track_id", "b_track_id", *keep).orderBy(F.desc(total), F.desc("shorter"), "a_idx", "b_idx")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def rank_pairs(pairs: DataFrame, tracks: DataFrame, sections: DataFrame, chroma: DataFrame, intent: str = "match", tuning: Tuning = DEFAULT) -> DataFrame:
    """The best ``top_n`` viable section pairs of each track pair; an equal score passes the least one."""
    viable = section_pairs(pairs, tracks, sections, chroma, tuning=tuning, by=(intent,), n=tuning.top_n, least=tuning.min_score).filter(F.col(intent) >= tuning.min_score)
    return best_of(viable, intent, n=tuning.top_n).drop("placed").withColumnRenamed(f"energy_{intent}", "energy").withColumnRenamed(intent, "total")


def mashup_pick(pairs: DataFrame, tracks: DataFrame, labelled: DataFrame, chroma: DataFrame, tuning: Tuning = DEFAULT) -> DataFrame:
    """The section of ``a`` to sing over one of ``b``: choruses and drops first; the bonus orders, the total stays. ``labelled``: sections with their ``label``."""
    bonus = lambda x, *names: F.when(F.col("label").isin(*names), x).otherwise(0.0)
    ready = labelled.withColumns({"bonus_a": bonus(0.12, "chorus", "drop"), "bonus_b": bonus(0.05, "chorus", "drop", "verse")})
    viable = section_pairs(pairs, tracks, ready, chroma, tuning=tuning, by=("placed",), n=1, least=tuning.min_score, extra=("label",)).filter(F.col("match") >= tuning.min_score)
    order = Window.partitionBy("a_track_id", "b_track_id").orderBy(F.desc("placed"), "a_idx", "b_idx")
    best = viable.withColumn("n", F.row_number().over(order)).filter("n = 1")
    return best.withColumnRenamed("match", "total").drop("n", "build", "energy_build")


# How ratios, steps on the wheel and terms are put in words.
RATIOS = ((1.0, "same tempo"), (2.0, "double-time"), (0.5, "half-time"), (1.5, "3:2 polyrhythm"), (2 / 3, "2:3 polyrhythm"))
STEPS = ((0, "same key"), (1, "harmonically compatible"))
FAR, SHIFTED, UNSURE = "%d steps apart on the wheel", ", shift %+d semitone%s", " (low key confidence, de-weighted)"
MOVE_SAID = "%s -> %s"
TEMPO_SAID = "tempo: %s, stretch %+.1f%% to %.1f BPM (score %.2f, contributes %.3f)"
KEY_SAID = "key: %s vs %s -> %s, %s (score %.2f, contributes %.3f)"
CHROMA_SAID = "chroma similarity %.2f at %+d semitones (contributes %.3f)"
ENERGY_SAID = "energy %s %+.2f (score %.2f, contributes %.3f)"
TOO_LOW, TOO_FAR = "score %.3f below minimum %.2f", "tempo incompatible: %.1f vs %.1f BPM exceeds +/-%.0f%% at every metrical level tried"
REJECTED = "REJECTED: %s"


def explained(pairs: DataFrame, tracks: DataFrame, intent: str = "match", tuning: Tuning = DEFAULT) -> DataFrame:
    """``pairs`` with each term's share of ``intent``, ``rejected`` and the sentences (``reasons``) that say why.

    ``pairs`` come from ``section_pairs`` with both sections' ``label``. A pair
    below the least score is told as rejected in a last sentence.
    """
    w = tuning.weights.normalized()
    c = F.col
    scores = {"tempo": c("tempo"), "key": c("key"), "chroma": c("chroma"), "energy": c(f"energy_{intent}")}
    part = {x: getattr(w, x) * score for x, score in scores.items()}
    ratio, steps = F.lit(RATIOS[0][1]), F.format_string(FAR, "distance")
    for value, said in RATIOS[1:]:
        ratio = F.when(F.abs(c("ratio") - value) < 1e-9, said).otherwise(ratio)
    for value, said in STEPS:
        steps = F.when(c("distance") == value, said).otherwise(steps)
    shifted = F.when(c("shift") == 0, "").otherwise(F.format_string(SHIFTED, "shift", F.when(F.abs("shift") == 1, "").otherwise("s")))
    unsure = F.when(F.least("_a_confidence", "_b_confidence") < tuning.key_floor, UNSURE).otherwise("")
    code = lambda x, turn=0: music.camelot(F.pmod(c(f"_{x}_pitch_class") + turn, F.lit(12)), c(f"_{x}_minor"))
    reasons = [
        F.format_string(MOVE_SAID, "a_label", "b_label"),
        F.format_string(TEMPO_SAID, ratio, (c("stretch") - 1) * 100, "_a_bpm", scores["tempo"], part["tempo"]),
        F.format_string(KEY_SAID, code("a"), code("b"), code("b", c("shift")), F.concat(steps, shifted, unsure), scores["key"], part["key"]),
        F.format_string(CHROMA_SAID, "chroma", "shift", part["chroma"]),
        F.format_string(ENERGY_SAID, F.lit(intent), c("b_energy") - c("a_energy"), scores["energy"], part["energy"]),
    ]
    low = F.when(c(intent) < tuning.min_score, F.format_string(TOO_LOW, intent, F.lit(tuning.min_score)))
    own = lambda x: tracks.select(F.col("track_id").alias(f"{x}_track_id"), *[F.col(y).alias(f"_{x}_{y}") for y in ("bpm", "pitch_class", "minor", "confidence")])
    both = pairs.join(own("a"), "a_track_id").join(own("b"), "b_track_id")
    told = both.withColumns({**{f"share_{x}": F.round(y, 4) for x, y in part.items()}, "reasons": F.array(*reasons), "rejected": low})
    said = F.when(c("rejected").isNull(), c("reasons")).otherwise(F.concat("reasons", F.array(F.format_string(REJECTED, "rejected"))))
    return told.withColumn("reasons", said).select(*pairs.columns, *[f"share_{x}" for x in part], "reasons", "rejected")


def refusals(pairs: DataFrame, tracks: DataFrame, sections: DataFrame, chroma: DataFrame, intent: str = "match", tuning: Tuning = DEFAULT) -> DataFrame:
    """``a_track_id, b_track_id, best, rejected``: the track pairs without a viable pair of sections, and why.

    Tempi too far apart come first; then the best section pair's score, which
    is too low. Both are null where a track has no section that is long enough.
    """
    two = pairs.select("a_track_id", "b_track_id").distinct()
    t = tracks.select("track_id", "bpm")
    tempi = two.join(side(t, "a"), "a_track_id").join(side(t, "b"), "b_track_id").withColumn("_score", music.tempo(F.col("a_bpm"), F.col("b_bpm"), tuning.tempo_tolerance)["score"])
    best = section_pairs(two, tracks, sections, chroma, tuning=tuning, by=(intent,), n=1).groupBy("a_track_id", "b_track_id").agg(F.max(intent).alias("best"))
    far = F.when(F.col("_score") <= 0, F.format_string(TOO_FAR, "a_bpm", "b_bpm", F.lit(tuning.tempo_tolerance * 100)))
    low = F.when(F.col("best").isNotNull(), F.format_string(TOO_LOW, "best", F.lit(tuning.min_score)))
    refused = tempi.join(best, ["a_track_id", "b_track_id"], "left").filter(F.coalesce(F.col("best") < tuning.min_score, F.lit(True)))
    return refused.select("a_track_id", "b_track_id", "best", F.coalesce(far, low).alias("rejected"))


#: Folded tempi lie in one octave, so there are some 8,200 buckets of this width; any beyond the octave share bucket -1.
TEMPO_STEP, FIRST_BUCKET, LAST_BUCKET = 0.01, 8_200, 16_400


def cluster_sizes(folded: DataFrame, tolerance: float) -> DataFrame:
    """``f, first, size``: for each distinct tempo, how many lie within ``tolerance`` of it.

    Buckets wholly inside a tempo's band are counted by prefix sums over the
    bounded number of buckets; only the buckets about the band's ends are
    compared tempo by tempo.
    """
    at = lambda x: F.floor(x / TEMPO_STEP).cast("long")
    tally = folded.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("track_id").alias("first"))
    tally = tally.withColumn("k", F.when(at(F.col("f")).between(FIRST_BUCKET, LAST_BUCKET), at(F.col("f"))).otherwise(-1))
    every = folded.sparkSession.range(FIRST_BUCKET, LAST_BUCKET + 1).withColumnRenamed("id", "k")
    sums = every.join(tally.groupBy("k").agg(F.sum("n").alias("n")), "k", "left").withColumn("until", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    prefix = F.broadcast(sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "until"))), lambda x: x["until"]).alias("until")))  # one row
    lo, hi = at(F.col("f") * (1 - tolerance)), at(F.col("f") * (1 + tolerance))
    asked = tally.select("f", "first", lo.alias("lo"), hi.alias("hi"))
    before = lambda k: F.when(k < FIRST_BUCKET, 0).otherwise(F.get("until", (F.least(k, F.lit(LAST_BUCKET)) - FIRST_BUCKET).cast("int")))
    inside = asked.join(prefix, F.lit(True)).select("f", "first", F.greatest(F.lit(0), before(F.col("hi") - 2) - before(F.col("lo") + 1)).alias("n"))
    ends = F.array_distinct(F.array(F.lit(-1).cast("long"), *[F.col(x) + d for x in ("lo", "hi") for d in (-1, 0, 1)]))
    # Ends that the whole buckets hold already do not arise: these begin two buckets inside.
    near = asked.select("f", "first", F.explode(ends).alias("k")).join(tally.select("k", F.col("f").alias("o"), "n"), "k").filter(F.abs(F.col("o") - F.col("f")) / F.col("f") <= tolerance)
    return inside.unionByName(near.select("f", "first", "n")).groupBy("f", "first").agg(F.sum("n").alias("size"))


def set_tempo(tracks: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """The median of the densest tempo cluster; the first candidate by id on ties."""
    folded = tracks.filter("bpm > 0").select("track_id", music.fold_tempo(F.col("bpm"))["bpm"].alias("f"))
    best = cluster_sizes(folded, tolerance).orderBy(F.desc("size"), "first").limit(1).select(F.col("f").alias("best"))
    inside = folded.join(F.broadcast(best), F.abs(F.col("f") - F.col("best")) / F.col("best") <= tolerance)  # one row
    return inside.agg(F.coalesce(F.round(F.median("f"), 6), F.lit(0.0)).alias("tempo"), F.count(F.lit(1)).alias("n"))


def set_tempi(tracks: DataFrame, group: str = "set_id", tolerance: float = 0.08) -> DataFrame:
    """``group, tempo``: the same for each set; a set's tracks, some forty at most, are compared with each other."""
    folded = tracks.filter("bpm > 0").select(group, "track_id", music.fold_tempo(F.col("bpm"))["bpm"].alias("f"))
    other = folded.select(group, F.col("f").alias("o"))
    sizes = folded.join(other, group).filter(F.abs(F.col("o") - F.col("f")) / F.col("f") <= tolerance).groupBy(group, "track_id", "f").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy(group).agg(F.max_by("f", F.struct("n", -F.col("track_id"))).alias("best"))
    return folded.join(best, group).filter(F.abs(F.col("f") - F.col("best")) / F.col("best") <= tolerance).groupBy(group).agg(F.round(F.median("f"), 6).alias("tempo"))


def keep_or_drop(tracks: DataFrame, target: float, most: float = DEFAULT.max_stretch) -> DataFrame:
    s = music.stretch_to(F.col("bpm"), F.lit(target))
    return tracks.select("track_id", F.round(s["rate"], 9).alias("rate"), F.round(s["deviation"], 9).alias("deviation")).withColumn("kept", F.col("deviation") <= most)


def track_energy(sections: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """How hard each track hits: 0.6 of its loudest section and 0.4 of their mean.

    With ``curves`` (``track_id, mean``: a row per track, the mean null where
    there is no curve) a track without sections has its curve's mean, or 0.5.
    """
    told = sections.groupBy("track_id").agg(F.round(0.6 * F.max("energy") + 0.4 * F.avg("energy"), 9).alias("energy"))
    if curves is None:
        return told
    return curves.join(told, "track_id", "left").select("track_id", F.coalesce("energy", "mean", F.lit(0.5)).alias("energy"))


def running_order(tracks: DataFrame, energies: DataFrame, group: str = "set_id", tuning: Tuning = DEFAULT) -> DataFrame:
    """Greedy order of each set: the track nearest the energy arc, with a price for tempo jumps.

    Sets hold at most some forty tracks, so a set's tracks fold in one array.
    """
    rows = tracks.join(energies, "track_id").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("track_id", "bpm", "energy"))).alias("pool"))
    n = F.size("pool")
    empty = F.struct(F.slice("pool", 1, 0).alias("done"), F.col("pool").alias("left"))

    def priced(acc, target):
        last = F.try_element_at(acc["done"], F.lit(-1))["bpm"]

        def cost(x):
            jump = lambda t: F.when(t["score"] > 0, 0.0).otherwise(0.6) + 0.25 * (1 - t["score"])
            price = F.when(last.isNull(), 0.0).otherwise(music.bind(music.tempo(last, x["bpm"], tuning.tempo_tolerance), jump))
            return F.struct(F.round(F.abs(x["energy"] - target) + price, 9).alias("c"), x["track_id"].alias("track_id"))

        return F.array_min(F.transform(acc["left"], cost))["track_id"]

    def pick(acc, i):
        def moved(best):
            chosen = F.filter(acc["left"], lambda x: x["track_id"] == best)
            return F.struct(F.concat(acc["done"], chosen).alias("done"), F.filter(acc["left"], lambda x: x["track_id"] != best).alias("left"))

        return music.bind(priced(acc, music.arc(i.cast("double"), n.cast("double"))), moved)

    done = F.aggregate(F.sequence(F.lit(0), n - 1), empty, pick, lambda acc: acc["done"])
    return rows.select(group, F.posexplode(done).alias("slot", "t")).select(group, "slot", "t.track_id")


def plan_set(order: DataFrame, tracks: DataFrame, sections: DataFrame, chroma: DataFrame, group: str = "set_id", tuning: Tuning = DEFAULT) -> DataFrame:
    """Each join of an order: the best section pair of its intent, else of the other one, else a hard cut.

    The first three quarters of a set build, the rest match. Both intents are
    scored in one pass over the section pairs. The joins themselves, one row a
    track at most, are written once.
    """
    w = Window.partitionBy(group).orderBy("slot")
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    steps = stored(order.withColumn("b_track_id", F.lead("track_id").over(w)).withColumn("wanted", F.when(F.col("slot") < 0.75 * n, "build").otherwise("match")).filter("b_track_id is not null").withColumnRenamed("track_id", "a_track_id"))
    pairs = section_pairs(steps, tracks, sections, chroma, (group, "slot", "wanted"), tuning, ("build", "match"), 1, tuning.min_score)
    either = F.explode(F.array(*[F.struct(F.lit(x).alias("intent"), F.col(x).alias("total")) for x in ("build", "match")]))
    viable = pairs.select(group, "slot", "wanted", "a_idx", "b_idx", "a_start", "b_start", "shorter", "tempo", "key", "shift", "chroma", either.alias("e")).select("*", "e.intent", "e.total").filter(F.col("total") >= tuning.min_score)
    first = Window.partitionBy(group, "slot").orderBy(F.when(F.col("intent") == F.col("wanted"), 0).otherwise(1), F.desc("total"), F.desc("shorter"), "a_idx", "b_idx")
    best = viable.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "e", "wanted", "shorter")
    return steps.join(best, [group, "slot"], "left").withColumn("hard_cut", F.col("intent").isNull())
