"""Beat grids, downbeats, keys, energy curves, section labels, timelines, loudness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cadenza.operators.joins import range_join

# Key profiles from C, major then minor.
TEMPERLEY = ((5.0, 2.0, 3.5, 2.0, 4.5, 4.0, 2.0, 4.5, 2.0, 3.5, 1.5, 4.0), (5.0, 2.0, 3.5, 4.5, 2.0, 4.0, 2.0, 4.5, 3.5, 2.0, 1.5, 4.0))
KRUMHANSL = ((6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88), (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17))


def beat_grid(beats: DataFrame) -> DataFrame:
    """``track_id, fits, period``: by a line through (index, time), fitted again without outliers.

    Uneven beats (a deviation above 0.12 of the median interval) keep that
    median, and fewer than eight beats, or no positive interval, give 0.
    """
    w = Window.partitionBy("track_id").orderBy("i")
    gaps = beats.withColumn("_g", F.col("t") - F.lag("t").over(w)).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.median("_g").alias("m"), F.stddev_pop("_g").alias("sd"))
    told = gaps.select("track_id", "n", "m", F.coalesce((F.col("n") >= 8) & (F.col("m") > 0) & (F.col("sd") <= 0.12 * F.col("m")), F.lit(False)).alias("fits"))
    even = beats.join(told.filter("fits").select("track_id"), "track_id")
    line = even.groupBy("track_id").agg(F.regr_slope("t", "i").alias("p"), F.regr_intercept("t", "i").alias("o"))
    inside = even.join(line, "track_id").filter(F.abs(F.col("t") - (F.col("o") + F.col("p") * F.col("i"))) < 0.5 * F.col("p"))
    again = inside.groupBy("track_id").agg(F.regr_slope("t", "i").alias("p2"), F.count(F.lit(1)).alias("c")).filter("c > 8")
    period = F.when((F.col("n") < 8) | (F.coalesce("m", F.lit(0.0)) <= 0), 0.0).when(~F.col("fits"), F.round("m", 6)).otherwise(F.round(F.coalesce("p2", "p"), 6))
    return told.join(line, "track_id", "left").join(again, "track_id", "left").select("track_id", "fits", period.alias("period"))


def downbeats(beats: DataFrame, per_bar: int = 4) -> DataFrame:
    """The bar phase of largest mean accent, the first on ties."""
    phase = beats.groupBy("track_id", (F.col("i") % per_bar).alias("phase")).agg(F.round(F.avg("accent"), 9).alias("accent"))
    return phase.groupBy("track_id").agg(F.max(F.struct("accent", (-F.col("phase")).alias("p"))).alias("m")).select("track_id", (-F.col("m.p")).alias("phase"), F.col("m.accent").alias("accent"))


def accents(beats: DataFrame, parts: dict[str, float]) -> DataFrame:
    """``accent``: the weighted sum of the columns ``parts``, each as a share of its track's peak; a flat one counts nothing.

    Onset, low band and twice the harmonic novelty are what tells bar one.
    """
    track = Window.partitionBy("track_id")
    share = lambda c: F.when(F.max(c).over(track) > 0, F.col(c) / F.max(c).over(track)).otherwise(F.col(c))
    terms = [weight * share(c) for c, weight in parts.items()]
    return beats.withColumn("accent", sum(terms[1:], terms[0]))


def mean_chroma(sections: DataFrame, frames: DataFrame, width: float) -> DataFrame:
    """``track_id, idx, chroma``: the mean over the frames inside each section, with sum one; uniform where there are none.

    ``sections``: ``track_id, idx, start, end``; ``frames``: ``track_id, t, chroma``.
    """
    inside = range_join(frames, sections.select("track_id", "idx", "start", "end"), "t", "start", "end", ["track_id"], width)
    means = [F.avg(F.get("chroma", F.lit(i))).alias(f"c{i}") for i in range(12)]
    held = inside.groupBy("track_id", "idx").agg(*means)
    total = sum((F.col(f"c{i}") for i in range(1, 12)), F.col("c0"))
    shares = F.when(total > 0, F.array(*[F.col(f"c{i}") / F.nullif(total, F.lit(0.0)) for i in range(12)]))
    uniform = F.array(*[F.lit(1.0 / 12)] * 12)
    return sections.select("track_id", "idx").join(held.select("track_id", "idx", shares.alias("chroma")), ["track_id", "idx"], "left").select("track_id", "idx", F.coalesce("chroma", uniform).alias("chroma"))


def intervals(beats: DataFrame) -> DataFrame:
    w = Window.partitionBy("track_id").orderBy("i")
    return beats.withColumn("d", F.col("t") - F.lag("t").over(w)).groupBy("track_id").agg(F.round(F.median("d"), 6).alias("median"), F.round(F.stddev_pop("d"), 4).alias("sd"))


def section_chroma(sections: DataFrame, chroma: DataFrame) -> DataFrame:
    """Mean chroma of a track, one row a pitch, summing to one."""
    # Twelve means at once: a section stays one row, and a track's pitches are rows only when there is one of each.
    means = sections.join(chroma, "vec_id").groupBy("track_id").agg(F.array(*[F.avg(F.get("chroma", F.lit(i))) for i in range(12)]).alias("c"))
    total = sum((F.coalesce(F.get("c", F.lit(i)), F.lit(0.0)) for i in range(1, 12)), F.coalesce(F.get("c", F.lit(0)), F.lit(0.0)))
    long = means.withColumn("_sum", total).select("track_id", "_sum", F.posexplode("c").alias("pitch", "v")).filter("v is not null")
    return long.select("track_id", "pitch", F.round(F.try_divide("v", "_sum"), 9).alias("v"))


def key_estimate(mean: DataFrame, profile: tuple = TEMPERLEY) -> DataFrame:
    """Key by correlation with 24 turned profiles; majors first on ties; confidence is the margin over all but the relative.

    ``mean``: ``track_id, pitch, v``. A track's twelve values meet once, and the
    profiles are a literal, so there is no join and no further exchange.
    """

    def standard(values):
        centre = sum(values) / 12
        norm = sum((x - centre) ** 2 for x in values) ** 0.5
        return [(x - centre) / norm for x in values]

    turned = [standard([profile[m][(p - k) % 12] for p in range(12)]) for m in (0, 1) for k in range(12)]
    rows = F.array(*[F.array(*map(F.lit, r)) for r in turned])
    c = mean.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pitch", "v"))), lambda x: x["v"]).alias("v"))
    centre = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / 12
    flat = c.withColumn("v", F.transform(F.array(centre), lambda m: F.transform("v", lambda x: x - m))[0])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda r: F.aggregate(F.zip_with(r, F.col("v"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = flat.withColumn("n", norm).withColumn("r", F.transform(rows, lambda r, i: F.struct(F.when(F.col("n") > 1e-12, F.round(dot(r) / F.col("n"), 9)).otherwise(0.0).alias("r"), (-i).alias("o"))))
    best = scored.withColumn("b", F.array_max("r")).withColumn("spread", F.col("b.r") - F.array_min("r")["r"])
    ord_, mode, tonic = -F.col("b.o"), F.expr("-b.o div 12"), F.expr("-b.o % 12")
    relative = F.when(mode == 0, (tonic + 9) % 12 + 12).otherwise((tonic + 3) % 12)
    next_ = F.array_max(F.filter("r", lambda x: (-x["o"] != ord_) & (-x["o"] != relative)))["r"]
    conf = F.coalesce(F.try_divide(F.col("b.r") - next_, F.col("spread")), F.lit(0.0))
    return best.select("track_id", tonic.cast("int").alias("pitch_class"), F.when(mode == 0, "major").otherwise("minor").alias("mode"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), 6).alias("confidence"))


def energy_curve(beats: DataFrame, m: int = 5) -> DataFrame:
    """Accents scaled from the 2nd to the 98th percentile to 0..1, then a moving mean over ``m`` (zeros beyond the ends); a track of ``m`` or fewer stays as it is."""
    p = beats.groupBy("track_id").agg(F.percentile("accent", F.array(F.lit(0.02), F.lit(0.98))).alias("q"), F.count(F.lit(1)).alias("n"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    scaled = beats.join(p, "track_id").withColumn("e", F.when(hi - lo < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("accent") - lo) / F.nullif(hi - lo, F.lit(0.0))))))
    w = Window.partitionBy("track_id").orderBy("i").rowsBetween(-(m // 2), (m - 1) // 2)
    smooth = F.when((F.col("n") > m) & F.lit(m > 1), F.sum("e").over(w) / m).otherwise(F.col("e"))
    return scaled.select("track_id", "i", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), smooth)), 6).alias("energy"))


def labelled(sections: DataFrame, recurrence: DataFrame | None = None) -> DataFrame:
    """``sections`` with a ``label`` by place and energy: quiet ends are intro and outro, the loudest drops or choruses, quiet middles bridges.

    With ``recurrence`` (``track_id, idx, n``) a section like another is never a drop.
    """
    again = F.lit(0) if recurrence is None else F.coalesce("_alike", F.lit(0))
    if recurrence is not None:
        sections = sections.join(recurrence.select("track_id", "idx", F.col("n").alias("_alike")), ["track_id", "idx"], "left")
    track = Window.partitionBy("track_id")
    told = sections.withColumns({"_p": F.percentile("energy", F.array(F.lit(0.5), F.lit(0.7))).over(track), "_top": F.max("energy").over(track), "_n": F.count(F.lit(1)).over(track)})
    e, n, p50, p70 = F.col("energy"), F.col("_n"), F.col("_p")[0], F.col("_p")[1]
    label = (
        F.when(n == 1, "verse").when((F.col("idx") == 0) & (e <= p50), "intro").when((F.col("idx") == n - 1) & (e <= p50), "outro")
        .when(e >= F.when(n > 2, p70).otherwise(p50), F.when((e >= 0.97 * F.col("_top")) & (again == 0), "drop").otherwise("chorus"))
        .when(e < 0.75 * p50, "bridge").otherwise("verse")
    )
    return told.withColumn("label", label).drop("_p", "_top", "_n", "_alike")


def label_sections(sections: DataFrame, recurrence: DataFrame | None = None) -> DataFrame:
    """``track_id, idx, label`` of ``labelled``."""
    return labelled(sections, recurrence).select("track_id", "idx", "label")


def fold_min_gap(df: DataFrame, group: str, t: str, gap: float) -> DataFrame:
    """Times that are at least ``gap`` after the last accepted one, in order."""
    times = df.groupBy(group).agg(F.array_sort(F.collect_list(t)).alias("ts"))
    kept = F.aggregate("ts", F.slice("ts", 1, 0), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= gap), F.concat(a, F.array(x))).otherwise(a))
    return times.select(group, F.explode(kept).alias(t))


def mixdown(clips: DataFrame, samples: DataFrame) -> DataFrame:
    """Sums of overlapping clips per sample; clips have ``clip_id, start`` in samples and ``gain``."""
    return clips.join(samples, "clip_id").groupBy((F.col("start") + F.col("i")).alias("at")).agg(F.round(F.sum(F.col("v") * F.col("gain")), 6).alias("v"))


def truncate(clips: DataFrame, cut: float) -> DataFrame:
    return clips.filter(F.col("start") < cut).withColumn("end", F.least("end", F.lit(cut)))


def gated_loudness(samples: DataFrame, block: int = 16, hop: int = 4) -> DataFrame:
    """Mean power of full hopping blocks above -70, then above the mean less 10; silence is minus infinity.

    With a column ``ch`` the channels' powers add up.
    """
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("i") - block + 1) / hop)).cast("int"), F.expr(f"i div {hop}").cast("int"))
    channels = F.max("ch") + 1 if "ch" in samples.columns else F.max(F.lit(1))
    b = samples.withColumn("b", F.explode(starts)).groupBy("clip_id", "b").agg((F.sum(F.col("v") * F.col("v")) / block).alias("p"), F.count(F.lit(1)).alias("n"), channels.alias("c")).filter(F.col("n") == block * F.col("c"))
    db = lambda p: F.when(p > 0, -0.691 + 10 * F.log10(p))
    loud = b.filter(db(F.col("p")) > -70)
    mean = loud.groupBy("clip_id").agg(F.avg("p").alias("m"))
    gated = loud.join(mean, "clip_id").filter(db(F.col("p")) > db(F.col("m")) - 10).groupBy("clip_id").agg(F.round(db(F.avg("p")), 6).alias("lufs"), F.count(F.lit(1)).alias("blocks"))
    return samples.select("clip_id").distinct().join(gated, "clip_id", "left").select("clip_id", F.coalesce("lufs", F.lit(float("-inf"))).alias("lufs"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def required_gain(samples: DataFrame, ceiling: float, look: int) -> DataFrame:
    """The limiter's first stage: the least gain needed within ``look`` samples either way."""
    need = samples.withColumn("g", F.least(F.lit(1.0), ceiling / F.nullif(F.abs("v"), F.lit(0.0))))
    w = Window.partitionBy("clip_id").orderBy("i").rowsBetween(-look, look)
    return need.select("clip_id", "i", F.round(F.min(F.coalesce("g", F.lit(1.0))).over(w), 9).alias("gain"))
