"""Building a set or a mashup as rows: bars, clips, joins, events, cues and hype elements on one clock of seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.config import DEFAULT, DENSITY, Tuning
from cadenza.functions import music, text
from cadenza.operators.library import hashed_unit

SLACK = 1e-6


def bar_seconds(bpm: Column) -> Column:
    return 240.0 / F.greatest(bpm, F.lit(SLACK))


def bar_grid(downbeats: Column, beats: Column, bpm: Column, duration: Column) -> Column:
    """Downbeats, else every fourth beat, else bars counted from 0 to the end (120 a minute where the tempo is unknown)."""
    bar = 240.0 / F.when(bpm > 0, bpm).otherwise(120.0)
    n = F.ceil(F.greatest(duration, bar) / bar).cast("int")
    counted = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * bar)
    fourth = F.filter(beats, lambda _, i: i % 4 == 0)
    return F.when(F.size(downbeats) > 0, downbeats).when(F.size(beats) > 0, fourth).otherwise(counted)


def first_at(grid: Column, t: Column) -> Column:
    """How many of a sorted array lie before ``t``: the place, from 0, at which it would be put."""
    return F.size(F.filter(grid, lambda x: x < t))


def snapped(grid: Column, t: Column, prefer: str = "nearest", slack: float = SLACK) -> Column:
    """The nearest of the grid (the earlier on ties), or the next or previous one; beyond its ends the last or first; no grid leaves ``t``."""
    if prefer == "next":
        found = F.coalesce(F.get(grid, first_at(grid, t - slack)), F.get(grid, F.size(grid) - 1))
    elif prefer == "prev":
        found = F.coalesce(F.get(grid, F.size(F.filter(grid, lambda x: x <= t + slack)) - 1), F.get(grid, F.lit(0)))
    else:
        found = F.array_min(F.transform(grid, lambda x: F.struct(F.abs(x - t).alias("d"), x.alias("t"))))["t"]
    return F.when(F.size(grid) > 0, found).otherwise(t)


def latest_start(grid: Column, bars: Column) -> Column:
    """The last downbeat with ``bars`` after it; 0 where the grid is too short to tell."""
    return F.when(F.size(grid) <= 1, 0.0).otherwise(F.get(grid, F.greatest(F.lit(0), F.size(grid) - 1 - bars)))


def slice_bars(grid: Column, start: Column, bars: Column, bpm: Column, duration: Column) -> Column:
    """struct(start, end, bars): from the next downbeat on, as many bars as there are; with none left, bars by the tempo."""
    at = snapped(grid, start, "next")

    def cut(begin):
        index = first_at(grid, begin - SLACK)

        def ended(i):
            left = F.greatest(F.lit(0), F.size(grid) - 1 - i)
            whole = i + bars < F.size(grid)
            got = F.when(whole | (left <= 0), bars).otherwise(left)
            end = F.when(whole, F.get(grid, i + bars)).when(left <= 0, begin + bars * bar_seconds(bpm)).otherwise(F.get(grid, i + left))
            stop = F.least(duration, end)
            return F.struct(F.least(begin, duration).alias("start"), F.greatest(F.least(begin, duration), stop).alias("end"), got.alias("bars"))

        return music.bind(index, ended)

    return music.bind(at, cut)


def segment_bars(minutes: float, tracks: Column, bpm: Column, transition_bars: int) -> Column:
    """Bars of each track: a multiple of four, eight at least; half of each overlap is added."""
    total = minutes * 60.0 / bar_seconds(bpm)
    return F.greatest(F.lit(8), (F.bround((total / F.greatest(tracks, F.lit(1)) + transition_bars * 0.5) / 4) * 4).cast("int"))


def kept_tracks(tracks: DataFrame, tempi: DataFrame, most: int | None, group: str = "set_id", tuning: Tuning = DEFAULT) -> DataFrame:
    """Each set's tracks with their stretch to its tempo, and ``fate``: kept, dropped (too far), or over (beyond ``most``, nearest first)."""
    s = music.stretch_to(F.col("bpm"), F.col("tempo"))
    told = tracks.join(tempi, group).withColumn("_s", s).withColumns({"rate": F.col("_s.rate"), "deviation": F.round("_s.deviation", 9)}).drop("_s")
    near = F.col("deviation") <= tuning.max_stretch
    place = F.row_number().over(Window.partitionBy(group, near).orderBy("deviation", "track_id"))
    return told.withColumn("fate", F.when(~near, "dropped").when(F.lit(bool(most)) & (place > (most or 0)), "over").otherwise("kept"))


def starts_and_ends(sections: DataFrame) -> DataFrame:
    """``track_id, default_start, duration``: the first chorus, else the first drop, else the first section, and the end of the last."""
    rank = F.when(F.col("label") == "chorus", 0).when(F.col("label") == "drop", 1).otherwise(2)
    return sections.groupBy("track_id").agg(F.min_by("start", F.struct(rank.alias("r"), F.col("idx").alias("i"))).alias("default_start"), F.max("end").alias("duration"))


def default_start(sections: DataFrame) -> DataFrame:
    """``track_id, default_start`` of ``starts_and_ends``."""
    return starts_and_ends(sections).select("track_id", "default_start")


def layout(order: DataFrame, joins: DataFrame, starts: DataFrame, minutes: float, group: str = "set_id", tuning: Tuning = DEFAULT) -> DataFrame:
    """Clips of a set in order: where each is cut from its track, and where it lies on the set's clock.

    ``order``: ``group, slot, track_id, bpm, tempo, rate, grid, duration`` of the
    kept tracks; ``joins`` from ``plan_set``; ``starts`` from ``default_start``.
    A clip overlaps the one before by ``transition_bars`` or half of itself. A
    track with nothing to cut is left out.
    """
    planned = joins.filter(~F.col("hard_cut")).select(group, (F.col("slot") + 1).alias("slot"), F.col("b_start").alias("_planned"), "shift")
    rows = order.join(planned, [group, "slot"], "left").join(starts, "track_id", "left")
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    rows = rows.withColumn("wanted_bars", segment_bars(minutes, n, F.col("tempo"), tuning.transition_bars))
    start = F.least(F.coalesce("_planned", "default_start", F.lit(0.0)), latest_start(F.col("grid"), F.col("wanted_bars")))
    rows = rows.withColumn("_start", start).withColumn("cut", slice_bars(F.col("grid"), F.col("_start"), F.col("wanted_bars"), F.col("bpm"), F.col("duration")))
    rows = rows.withColumn("seconds", (F.col("cut.end") - F.col("cut.start")) / F.col("rate")).filter("seconds > 0")
    w = Window.partitionBy(group).orderBy("slot")
    overlap = F.when(F.lag("slot").over(w).isNull(), 0.0).otherwise(F.least(tuning.transition_bars * bar_seconds(F.col("tempo")), 0.5 * F.col("seconds")))
    rows = rows.withColumn("overlap", overlap).withColumn("before", F.coalesce(F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) - F.sum("overlap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = F.array(*map(F.lit, tuning.transitions))
    return rows.select(
        group, "slot", "track_id", F.col("before").alias("start"), "seconds", "overlap", "rate", F.coalesce("shift", F.lit(0)).alias("shift"), F.col("_start").alias("cut_start"), F.col("cut.bars").alias("bars"), "tempo",
        F.when(F.col("overlap") > 0, F.element_at(names, F.pmod(F.col("slot"), F.lit(len(tuning.transitions))).cast("int") + 1)).alias("transition"),
    )


def timeline_length(clips: DataFrame, group: str = "set_id") -> DataFrame:
    """The end of the last clip that is not empty."""
    return clips.filter("seconds > 0").groupBy(group).agg(F.max(F.col("start") + F.col("seconds")).alias("length"))


def events(clips: DataFrame, sections: DataFrame, tracks: DataFrame, group: str = "set_id") -> DataFrame:
    """``group, time, ordinal, kind, label, track_id``: tracks that enter, transitions, and the drops and choruses that are heard.

    A cue lies strictly inside what is cut from its track; ``sections``:
    ``track_id, idx, start, label``; ``tracks``: ``track_id, label``.
    """
    named = clips.join(tracks.select("track_id", F.col("label").alias("name")), "track_id")
    at = F.greatest("start", F.lit(0.0))
    enter = named.select(group, at.alias("time"), (F.col("slot") * 1000 + 1).alias("ordinal"), F.lit("track_in").alias("kind"), F.col("name").alias("label"), "track_id")
    joins = clips.filter("transition is not null").select(group, F.col("start").alias("time"), (F.col("slot") * 1000).alias("ordinal"), F.lit("transition").alias("kind"), F.col("transition").alias("label"), "track_id")
    marks = sections.filter(F.col("label").isin("drop", "chorus")).select("track_id", "idx", F.col("start").alias("_at"), "label")
    offset = F.col("_at") - F.col("cut_start")
    heard = clips.join(marks, "track_id").filter((offset > 0) & (offset < F.col("seconds") * F.col("rate")))
    cues = heard.select(group, (at + offset / F.col("rate")).alias("time"), (F.col("slot") * 1000 + 2 + F.col("idx")).alias("ordinal"), F.lit("cue").alias("kind"), "label", "track_id")
    return enter.unionByName(joins).unionByName(cues)


def tracklist(marked: DataFrame, group: str = "set_id") -> DataFrame:
    """Events with their place in time, equal times in the order they were marked, and a timecode."""
    w = Window.partitionBy(group).orderBy("time", "ordinal")
    return marked.withColumns({"place": F.row_number().over(w), "timecode": text.timecode(F.col("time"))})


def hype(cues: DataFrame, tempi: DataFrame, density: str, seed: int, riser_seconds: float = 4.0, group: str = "set_id", tuning: Tuning = DEFAULT) -> DataFrame:
    """``group, time, element, start, gain_db, on_kind``: risers that end on a cue, impacts on drops and joins, horns on heavy drops.

    A cue passes by chance first, then if it lies far enough from the last one
    that got something, and not in the first bar. ``cues``: ``group, time,
    ordinal, kind, label``; ``tempi``: ``group, tempo``. A set's cues fold in order.
    """
    rules = DENSITY.get(density, DENSITY["light"])
    if density == "off":
        cues = cues.limit(0)
    kind = F.when(F.col("kind") == "transition", "transition").otherwise(F.col("label"))
    chance = F.when(F.col("on_kind") == "drop", rules["drop"]).when(F.col("on_kind") == "chorus", rules["chorus"]).when(F.col("on_kind") == "transition", rules["transition"]).otherwise(0.0)
    moments = cues.filter(F.col("kind").isin("cue", "transition")).withColumn("on_kind", kind)
    drawn = moments.join(tempi.select(group, "tempo"), group).withColumn("bar", bar_seconds(F.col("tempo"))).filter((chance > 0) & (hashed_unit(seed, group, "ordinal") <= chance) & (F.col("time") >= F.col("bar")))
    riser = F.col("time") - F.least(F.lit(riser_seconds), F.greatest(tuning.hype_lead_beats * F.col("bar") / 4, F.col("bar")))
    part = lambda name, start, gain, when: F.when(when, F.struct(F.lit(name).alias("element"), start.alias("start"), F.lit(gain).alias("gain_db")))
    g = tuning.hype_gain_db
    elements = F.array_compact(F.array(
        part("riser", riser, g, riser > 0),
        part("impact", F.col("time"), g - 1.0, F.col("on_kind").isin("drop", "transition")),
        part("airhorn", F.col("time") + F.col("bar") / 2, g - 2.0, F.lit(density == "heavy") & (F.col("on_kind") == "drop")),
    ))
    some = drawn.withColumn("elements", elements).filter(F.size("elements") > 0)
    folded = some.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("time", "ordinal", "on_kind", "elements"))).alias("m"))
    kept = F.aggregate("m", F.slice("m", 1, 0), lambda a, x: F.when((F.size(a) == 0) | (x["time"] - F.try_element_at(a, F.lit(-1))["time"] >= rules["min_gap"]), F.concat(a, F.array(x))).otherwise(a))
    return folded.select(group, F.explode(kept).alias("x")).select(group, "x.time", "x.on_kind", F.explode("x.elements").alias("e")).select(group, "time", "on_kind", "e.*")


def overlapped(clips: DataFrame, windows: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """Parts of clips inside windows, as an interval join by buckets: ``take_from``, ``write_at`` and ``n`` samples each.

    ``clips``: ``clip_id, start, n``; ``windows``: ``window_id, w_start, w_n``, in samples.
    """
    bucketed = lambda df, a, n: df.withColumn("_k", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(a) + F.col(n) - 1) / width))))
    both = bucketed(clips.filter("n > 0"), "start", "n").join(bucketed(windows, "w_start", "w_n"), [*keys, "_k"])
    # Both cover the bucket in which the later one begins, and that one alone is used.
    met = both.filter((F.col("_k") == F.floor(F.greatest("start", "w_start") / width)) & (F.col("start") + F.col("n") > F.col("w_start")) & (F.col("start") < F.col("w_start") + F.col("w_n")))
    offset = F.col("w_start") - F.col("start")
    take, write = F.greatest(F.lit(0), offset), F.greatest(F.lit(0), -offset)
    return met.select(*keys, "window_id", "clip_id", take.alias("take_from"), write.alias("write_at"), F.least(F.col("n") - take, F.col("w_n") - write).alias("n"))


def truncated(clips: DataFrame, cut: Column) -> DataFrame:
    """Clips that play past ``cut`` end there and lose their fade; those that begin after it stay."""
    keep = cut - F.col("start")
    shorter = (keep >= 0) & (keep < F.col("n"))
    return clips.withColumns({"n": F.when(shorter, keep).otherwise(F.col("n")), "fade_out": F.when(shorter, 0.0).otherwise(F.col("fade_out")), "trimmed": shorter})


def mashup(picked: DataFrame, bars: int = 32, tuning: Tuning = DEFAULT) -> DataFrame:
    """Clips of each mashup: the bed alone at first, the voice over it, and the outro's treatment of the last bars.

    ``picked``: ``a_track_id, b_track_id, a_bpm, b_bpm, a_start, b_start, stretch,
    a_grid, b_grid, a_duration, b_duration``. The first track sets the clock.
    """
    n = F.lit(bars)
    cut = lambda p: slice_bars(F.col(f"{p}_grid"), F.least(F.col(f"{p}_start"), latest_start(F.col(f"{p}_grid"), n)), n, F.col(f"{p}_bpm"), F.col(f"{p}_duration"))
    rows = picked.withColumns({"_a": cut("a"), "_b": cut("b"), "bar": bar_seconds(F.col("a_bpm"))})
    length = F.least(F.col("_a.end") - F.col("_a.start"), (F.col("_b.end") - F.col("_b.start")) / F.col("stretch"))
    intro_bars, tail_bars = min(2, max(1, bars // 8)), min(4, max(1, bars // 8))
    rows = rows.withColumn("length", length).filter("length > 0")
    intro, tail = intro_bars * F.col("bar"), tail_bars * F.col("bar")
    clip = lambda i, stem, start, seconds, gain, fade_in, fade_out: F.struct(F.lit(i).alias("i"), F.lit(stem).alias("stem"), start.alias("start"), seconds.alias("seconds"), F.lit(gain).alias("gain_db"), F.lit(fade_in).alias("fade_in"), fade_out.alias("fade_out"))
    bed = clip(0, "instrumental", F.lit(0.0), F.col("length"), tuning.bed_gain_db, 0.05, F.col("bar"))
    voice = clip(1, "vocals", intro, F.greatest(F.lit(0.0), F.col("length") - intro), tuning.vocal_gain_db, 0.08, 0.5 * F.col("bar"))
    outro = F.when(F.col("length") > tail, clip(2, "transition", F.col("length") - tail, tail, tuning.bed_gain_db, 0.0, F.lit(0.0)))
    return rows.select("a_track_id", "b_track_id", F.explode(F.array_compact(F.array(bed, voice, outro))).alias("c")).select("a_track_id", "b_track_id", "c.*")
