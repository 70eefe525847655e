"""Queries over samples: levels, channels, envelopes, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import music
from cadenza.operators import analysis, levels, matching, sound, spectra
from cadenza.plans.registry import query, v
from cadenza.sources import views, wav
from cadenza.streaming import jobs, tail


@query(v("SELECT clip_id, round(max(abs(v)), 9) AS peak, round(20 * log10(max(abs(v))), 6) AS peak_db FROM samples GROUP BY 1"))
def clip_peaks(spark, d):
    return sound.peak(views.samples(spark, d)).select("clip_id", F.round("peak", 9).alias("peak"), F.round("peak_db", 6).alias("peak_db"))


@query(v("SELECT clip_id, i, round(v * 0.9::DOUBLE / max(abs(v)) OVER (PARTITION BY clip_id), 9) AS v FROM samples"))
def normalized_peaks(spark, d):
    return sound.normalized_peak(views.samples(spark, d), 0.9).select("clip_id", "i", F.round("v", 9).alias("v"))


@query(v("SELECT clip_id, unnest([0, 1]) AS ch, i, v FROM samples WHERE clip_id % 3 = 0 UNION ALL SELECT clip_id, c, i, v * (c + 1) FROM samples, (SELECT unnest([0, 1]) AS c) WHERE clip_id % 3 <> 0"))
def stereo_samples(spark, d):
    """A third of the clips have one channel, the others four."""
    s = views.samples(spark, d)
    ch = F.explode(F.when(F.col("clip_id") % 3 == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(3))))
    return sound.stereo(s.withColumn("ch", ch).withColumn("v", F.when(F.col("clip_id") % 3 == 0, F.col("v")).otherwise(F.col("v") * (F.col("ch") + 1)))).select("clip_id", "ch", "i", "v")


@query(v("SELECT clip_id, i, round(v * (1 - 0.45::DOUBLE + 0.45::DOUBLE * (1 - exp(-((i + 2) % b) / b::DOUBLE / (0.62::DOUBLE * 0.25)))), 9) AS v FROM (SELECT *, greatest(1, floor(60.0::DOUBLE / (90 + clip_id % 60) * 20)::BIGINT) AS b FROM samples)"))
def sidechain(spark, d):
    """Samples under a pump of each clip's own tempo, at 20 samples a second."""
    return sound.pumped(views.samples(spark, d), 20, (90 + F.col("clip_id") % 60).cast("double"), offset=0.1).select("clip_id", "i", F.round("v", 9).alias("v"))


@query(v("SELECT clip_id, i, round(greatest(20.0, least(22050 * 0.99::DOUBLE, 200 * pow(8000.0::DOUBLE / 200, floor(i / 8.0) / greatest(ceil(n / 8.0) - 1, 1)))), 6) AS cutoff FROM (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM samples)"))
def filter_sweep(spark, d):
    s = views.samples(spark, d)
    n = s.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, "clip_id").select("clip_id", "i", F.round(sound.sweep_cutoff(F.col("i"), F.col("n"), 44_100, 200.0, 8000.0, 8), 6).alias("cutoff"))


@query(v("SELECT clip_id, i, round(cos(pi() / 2 * i / (n - 1)), 9) + 0.0::DOUBLE AS gone, round(sin(pi() / 2 * i / (n - 1)), 9) AS come FROM (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM samples)"))
def crossfade_gains(spark, d):
    s = views.samples(spark, d)
    n = s.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, "clip_id").withColumn("g", sound.crossfade(F.col("i"), F.col("n"))).select("clip_id", "i", (F.round("g.out", 9) + 0.0).alias("gone"), F.round("g.into", 9).alias("come"))


@query("SELECT o_orderkey AS id, round(CASE WHEN o_custkey % 10 = 0 THEN 1.0 ELSE pow(10.0::DOUBLE, greatest(-18.0, least(18.0, -14.0 + (o_orderkey % 50))) / 20) END, 9) AS gain FROM orders")
def target_gains(spark, d):
    lufs = F.when(F.col("o_custkey") % 10 == 0, F.lit(float("-inf"))).otherwise(-(F.col("o_orderkey") % 50).cast("double"))
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(sound.target_gain(lufs, -14.0), 9).alias("gain"))


@query(v("SELECT clip_id, i, sum(v) AS v FROM (SELECT clip_id // 2 AS clip_id, clip_id % 2 AS layer, i, round(v, 6) AS v FROM samples WHERE clip_id % 2 = 0 OR i < 40) GROUP BY 1, 2 HAVING count(*) = 2".replace("sum(v) AS v", "round(sum(v), 6) AS v")))
def summed_layers(spark, d):
    """Two layers of unequal length; the shorter one ends the sum."""
    s = views.samples(spark, d).filter("clip_id % 2 = 0 or i < 40")
    return sound.summed(s.select(F.expr("clip_id div 2").alias("clip_id"), (F.col("clip_id") % 2).alias("layer"), "i", F.round("v", 6).alias("v"))).select("clip_id", "i", F.round("v", 6).alias("v"))


@query(v("SELECT clip_id, i::BIGINT AS i, round(round(greatest(-1, least(1, v)) * 32767)::INT / 32767.0::DOUBLE, 9) AS v FROM samples"))
def wav_round_trip(spark, d):
    """Clips written as WAV parts, joined into files and decoded again."""
    parts = wav.wav_parts(views.samples(spark, d), 44_100)
    whole = parts.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("part", F.hex("bytes").alias("h")))).alias("p"))
    files = whole.select(F.col("clip_id").cast("string").alias("path"), F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("content"))
    return sound.decoded(files).select(F.col("path").cast("long").alias("clip_id"), "i", F.round("v", 9).alias("v"))


@query(v(", z AS (SELECT track_id, i, (accent - avg(accent) OVER w) / CASE WHEN stddev_pop(accent) OVER w < 1e-9 THEN 1 ELSE stddev_pop(accent) OVER w END AS z, first_value(i) OVER o AS lo, last_value(i) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi FROM beats WINDOW w AS (PARTITION BY track_id), o AS (PARTITION BY track_id ORDER BY i ROWS UNBOUNDED PRECEDING)), t AS (SELECT track_id, i, greatest(lo, least(hi, i + k)) AS j FROM z, (SELECT unnest([-2, -1, 0, 1]) AS k)) SELECT t.track_id, t.i, round(avg(z.z), 6) AS f FROM t JOIN z ON z.track_id = t.track_id AND z.i = t.j GROUP BY 1, 2"))
def beat_features(spark, d):
    """One feature of each beat, six times over, standardised and smoothed."""
    f = views.beats(spark, d).select("track_id", "i", F.lit("loudness").alias("name"), F.lit(0).alias("k"), F.col("accent").alias("v"))
    got = sound.beat_features(f, {"loudness": 6})
    return got.filter("size(features) = 6").select("track_id", "i", F.round(F.col("features")[5], 6).alias("f"))


@query("SELECT event_id, round(0.70::DOUBLE + 0.28::DOUBLE * greatest(0, least(1, value / 500)), 6) AS progress FROM events")
def rescaled_progress(spark, d):
    e = jobs.job_events(views.table(spark, d, "events"))
    return e.select("event_id", F.round(jobs.rescaled(F.col("progress")), 6).alias("progress"))


@query("SELECT user_id AS job_id, count(*) AS frames, bool_and(true) AS framed FROM events GROUP BY 1")
def event_frames(spark, d):
    """Each event as one frame of a push stream."""
    e = jobs.job_events(views.table(spark, d, "events"))
    frames = jobs.sse(e).withColumn("ok", F.col("frame").rlike(r"^data: \{.*\}\n\n$")).withColumn("job_id", F.get_json_object(F.substring("frame", 7, 10_000), "$.job_id").cast("long"))
    return frames.groupBy("job_id").agg(F.count(F.lit(1)).alias("frames"), F.bool_and("ok").alias("framed"))


@query("""WITH e AS (SELECT user_id AS job_id, event_type AS stage, greatest(0.0, least(1.0, value / 500)) AS progress, row_number() OVER w AS n, coalesce(bool_or(event_type IN ('purchase', 'error', 'cancel')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT job_id, n, stage, round(progress, 6) AS progress FROM e WHERE NOT ended""")
def followed_jobs(spark, d):
    """What one who follows all jobs is sent, each up to its end."""
    e = views.table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    sent = jobs.run_through(tail.frames(stream, None), "append")
    told = F.from_json(F.regexp_extract("frame", r"(?s)^data: (.*)\n\n$", 1), "stage string, progress double")
    return sent.select("job_id", "n", told.alias("t")).select("job_id", "n", "t.stage", F.round("t.progress", 6).alias("progress"))


@query("SELECT user_id AS job_id, CASE WHEN status = 'done' THEN 'r' || user_id ELSE '' END AS result, progress FROM (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, round(round(greatest(0, least(1, value / 500)), 6), 4) AS progress, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def shown_jobs(spark, d):
    """A job's result shows once it is done."""
    s = jobs.latest_state(jobs.job_events(views.table(spark, d, "events"))).withColumn("result", F.concat(F.lit("r"), "job_id"))
    return jobs.shown(s).select("job_id", F.coalesce("result", F.lit("")).alias("result"), "progress")


@query("SELECT p_partkey AS id, round(pow(10.0::DOUBLE, (p_partkey % 40 - 30) / 20.0), 9) AS gain FROM part")
def gains(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(music.db_gain((F.col("p_partkey") % 40 - 30).cast("double")), 9).alias("gain"))


@query(v(""", p AS (SELECT track_id, i, t, accent AS onset, 500 - accent AS low, abs(accent - coalesce(lag(accent) OVER (PARTITION BY track_id ORDER BY i), accent)) AS change FROM beats),
a AS (SELECT track_id, i, onset / max(onset) OVER w + low / max(low) OVER w + 2 * change / max(change) OVER w AS a FROM p WINDOW w AS (PARTITION BY track_id)),
f AS (SELECT track_id, i % 4 AS phase, round(avg(a), 9) AS accent FROM a GROUP BY 1, 2) SELECT track_id, phase, accent FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY accent DESC, phase) AS k FROM f) WHERE k = 1"""))
def bar_phase(spark, d):
    """The phase of bar one, from onset, low band and harmonic change together."""
    from pyspark.sql import Window

    before = F.lag("accent").over(Window.partitionBy("track_id").orderBy("i"))
    b = views.beats(spark, d).withColumns({"onset": F.col("accent"), "low": 500 - F.col("accent"), "change": F.abs(F.col("accent") - F.coalesce(before, F.col("accent")))})
    return analysis.downbeats(analysis.accents(b, {"onset": 1.0, "low": 1.0, "change": 2.0}))


@query(v(""", fr AS (SELECT track_id, floor(start / 90)::BIGINT AS idx, chroma FROM sections JOIN chroma USING (vec_id)), se AS (SELECT track_id, unnest(range(floor(max(start) / 90)::BIGINT + 2)) AS idx FROM sections GROUP BY 1),
lg AS (SELECT track_id, idx, unnest(range(12)) AS pitch, unnest(chroma) AS c FROM fr), m AS (SELECT track_id, idx, pitch, avg(c) AS c FROM lg GROUP BY ALL), n AS (SELECT track_id, idx, pitch, c / sum(c) OVER (PARTITION BY track_id, idx) AS c FROM m),
al AS (SELECT track_id, idx, unnest(range(12)) AS pitch FROM se)
SELECT track_id, idx, pitch, round(coalesce(n.c, 1 / 12.0::DOUBLE), 6) AS share FROM al LEFT JOIN n USING (track_id, idx, pitch)"""))
def section_chroma_means(spark, d):
    """Mean chroma of each ninety seconds of a track, to its end; the last ones have no frames."""
    s = views.sections(spark, d)
    frames = s.join(views.chroma(spark, d), "vec_id").select("track_id", F.col("start").alias("t"), "chroma")
    last = F.floor(F.max("start") / 90).cast("long") + 1
    spans = s.groupBy("track_id").agg(F.sequence(F.lit(0).cast("long"), last).alias("k")).select("track_id", F.explode("k").alias("idx")).withColumns({"start": F.col("idx") * 90.0, "end": (F.col("idx") + 1) * 90.0})
    got = analysis.mean_chroma(spans, frames, 90.0)
    return got.select("track_id", "idx", F.posexplode("chroma").alias("pitch", "v")).select("track_id", "idx", F.col("pitch").cast("long").alias("pitch"), F.round("v", 6).alias("share"))


@query(v(", cu AS (SELECT track_id, CASE WHEN track_id % 2 = 0 THEN bpm / 200 END AS mean FROM tracks), se AS (SELECT * FROM sections WHERE track_id % 3 <> 0), en AS (SELECT track_id, round(0.6::DOUBLE * max(energy) + 0.4::DOUBLE * avg(energy), 9) AS energy FROM se GROUP BY 1) SELECT track_id, coalesce(energy, mean, 0.5) AS energy FROM cu LEFT JOIN en USING (track_id)"))
def track_energy_fallback(spark, d):
    """A third of the tracks have no sections; half of these have no curve either."""
    curves = views.tracks(spark, d).select("track_id", F.when(F.col("track_id") % 2 == 0, F.col("bpm") / 200).alias("mean"))
    return matching.track_energy(views.sections(spark, d).filter("track_id % 3 <> 0"), curves)


@query()
def master_report(spark, d):
    """Each clip brought to its loudness, ridden and limited, with what that took."""
    return levels.mastered(views.samples(spark, d), 160, -14.0, -1.0)[1]


@query(v(", c AS (SELECT clip_id, count(*) AS n FROM samples GROUP BY 1) SELECT clip_id, i, round(v * CASE WHEN i < 8 THEN sin(pi() / 2 * i / 7) ELSE 1 END * CASE WHEN n - 1 - i < 16 THEN sin(pi() / 2 * (n - 1 - i) / 15) ELSE 1 END * pow(10.0::DOUBLE, (clip_id % 7 - 3) / 20.0), 9) + 0.0::DOUBLE AS v FROM samples JOIN c USING (clip_id)"))
def rendered_clips(spark, d):
    """Faded, then at the clip's gain."""
    s = views.samples(spark, d)
    clips = s.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"fade_in": F.lit(8), "fade_out": F.lit(16), "gain_db": (F.col("clip_id") % 7 - 3).cast("double")})
    return sound.rendered(s, clips).select("clip_id", "i", (F.round("v", 9) + 0.0).alias("v"))


@query(v(""", f AS (SELECT clip_id, unnest(range(count(*) // 4 + 1)) AS k FROM samples GROUP BY 1), b AS (SELECT unnest(range(3)) AS b),
t AS (SELECT f.clip_id, k, b, sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - k * 4 + 8) / 16)) * cos(2 * pi() * b * (i - k * 4 + 8) / 16)) AS re, sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - k * 4 + 8) / 16)) * sin(2 * pi() * b * (i - k * 4 + 8) / 16)) AS im
  FROM f JOIN samples s ON s.clip_id = f.clip_id AND i >= k * 4 - 8 AND i < k * 4 + 8, b GROUP BY ALL)
SELECT clip_id, k, round(sum(sqrt(re * re + im * im)), 6) AS energy FROM t GROUP BY 1, 2"""))
def low_band_energy(spark, d):
    """Magnitudes of the lowest three bins of frames of sixteen samples."""
    return spectra.band_energy(views.samples(spark, d), 64.0, 4, 16, 0.0, 8.0).select("clip_id", "k", F.round("energy", 6).alias("energy"))


def resampled_sql(a: int, b: int, zeros: int) -> str:
    step, scale = f"({a}.0::DOUBLE / {b})", min(1.0, b / a)
    half = -(-zeros * max(a, b) // b)
    x = f"(m * {step} - floor(m * {step}) - o)"
    weight = f"CASE WHEN {x} = 0 THEN 1.0::DOUBLE ELSE sin(pi() * {scale!r}::DOUBLE * {x}) / (pi() * {scale!r}::DOUBLE * {x}) END * (0.42::DOUBLE + 0.5::DOUBLE * cos(pi() * greatest(-1, least(1, {x} / {half}))) + 0.08::DOUBLE * cos(2 * pi() * greatest(-1, least(1, {x} / {half}))))"
    return f""", c AS (SELECT clip_id, count(*) AS n FROM samples GROUP BY 1), m AS (SELECT clip_id, unnest(range(ceil(n * {b} / {a}.0::DOUBLE)::BIGINT)) AS m FROM c), o AS (SELECT unnest(range(-{half}, {half} + 1)) AS o),
w AS (SELECT clip_id, m, floor(m * {step})::BIGINT + o AS i, {weight} AS w FROM m, o)
SELECT clip_id, m AS i, round(sum(coalesce(v, 0) * w) / sum(w), 6) + 0.0::DOUBLE AS v FROM w LEFT JOIN samples USING (clip_id, i) GROUP BY 1, 2"""


@query(v(resampled_sql(3, 2, 8)))
def resampled_clips(spark, d):
    """Clips at two thirds of their rate."""
    return spectra.resampled(views.samples(spark, d), 48_000, 32_000, 8).select("clip_id", "i", (F.round("v", 6) + 0.0).alias("v"))
