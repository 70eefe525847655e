"""Queries that build sets and mashups as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import music
from cadenza.operators import analysis, create, matching, mix, sets, store
from cadenza.plans import catalogue
from cadenza.plans.registry import query, v
from cadenza.sources import views

MINUTES = 30.0

BAR = "240.0::DOUBLE / {bpm}"
#: Sets of twenty: tempo, stretch and what is kept (the eight nearest).
KEPT = """ft AS (SELECT track_id, (track_id - 1) // 20 AS set_id, bpm, CASE WHEN bpm < 82 THEN bpm * 2 WHEN bpm > 164 THEN bpm / 2 ELSE bpm END AS f FROM tracks),
cs AS (SELECT a.set_id, a.track_id, a.f, count(*) AS n FROM ft a JOIN ft b ON a.set_id = b.set_id AND abs(b.f - a.f) / a.f <= 0.08::DOUBLE GROUP BY ALL),
ct AS (SELECT set_id, arg_max(f, struct_pack(n := n, i := -track_id)) AS best FROM cs GROUP BY 1),
tt AS (SELECT ft.set_id, round(median(f), 6) AS tempo FROM ft JOIN ct USING (set_id) WHERE abs(f - best) / best <= 0.08::DOUBLE GROUP BY 1),
st0 AS (SELECT ft.set_id, track_id, bpm, tempo, list_min([struct_pack(d := greatest(tempo / (bpm * q[1]), bpm * q[1] / tempo) - 1, o := q[2], r := tempo / (bpm * q[1])) FOR q IN [[0.25, 0], [0.5, 1], [1, 2], [2, 3], [4, 4]]::DOUBLE[][]]) AS m FROM ft JOIN tt USING (set_id)),
st AS (SELECT set_id, track_id, bpm, tempo, m.r AS rate, round(m.d, 9) AS deviation, row_number() OVER (PARTITION BY set_id, round(m.d, 9) <= 0.12 ORDER BY round(m.d, 9), track_id) AS k FROM st0),
fate AS (SELECT *, CASE WHEN deviation > 0.12 THEN 'dropped' WHEN k > 8 THEN 'over' ELSE 'kept' END AS fate FROM st)"""


def kept(spark, d):
    t = views.tracks(spark, d).withColumn("set_id", F.expr(catalogue.SET))
    return sets.kept_tracks(t, matching.set_tempi(t), 8)


@query(v(f", {KEPT} SELECT set_id, track_id, round(tempo, 6) AS tempo, round(rate, 6) AS rate, deviation, fate FROM fate"))
def kept_tracks(spark, d):
    return kept(spark, d).select("set_id", "track_id", "tempo", F.round("rate", 6).alias("rate"), "deviation", "fate")


#: Layout: everything up to each clip's place; the set's order and joins come from the catalogue's text.
DUR = 'du AS (SELECT track_id, max("end") AS duration FROM sections GROUP BY 1)'
STARTS = "ds AS (SELECT track_id, arg_min(start, struct_pack(r := CASE label WHEN 'chorus' THEN 0 WHEN 'drop' THEN 1 ELSE 2 END, i := idx)) AS d0 FROM sections JOIN lab USING (track_id, idx) GROUP BY 1)"
PLAN = catalogue.ORDER.replace("FROM tracks JOIN en USING (track_id) GROUP BY 1)", "FROM tracks JOIN en USING (track_id) JOIN (SELECT track_id AS kt FROM fate WHERE fate = 'kept') ON kt = track_id GROUP BY 1)")
LAID = f"""{KEPT}, {PLAN}, so AS (SELECT set_id, slot, track_id AS a, lead(track_id) OVER w AS b, CASE WHEN slot < 0.75 * count(*) OVER (PARTITION BY set_id) THEN 'build' ELSE 'match' END AS wanted FROM ordered WINDOW w AS (PARTITION BY set_id ORDER BY slot)),
js AS (SELECT * FROM so WHERE b IS NOT NULL), {catalogue.scored_sql('js')}, {catalogue.LABELS}, {DUR}, {STARTS},
ei AS (SELECT js.set_id, js.slot, js.wanted, sp.*, unnest([struct_pack(i := 'build', v := build), struct_pack(i := 'match', v := match)]) AS e FROM js JOIN sp ON sp.a = js.a AND sp.b = js.b),
vi AS (SELECT *, row_number() OVER (PARTITION BY set_id, slot ORDER BY CASE WHEN e.i = wanted THEN 0 ELSE 1 END, e.v DESC, shorter DESC, a_idx, b_idx) AS k FROM ei WHERE e.v >= 0.45),
l0 AS (SELECT o.set_id, o.slot, o.track_id, f.bpm, f.tempo, f.rate, duration, coalesce(b_start, d0, 0.0) AS want, coalesce(shift, 0) AS shift, 240.0::DOUBLE / f.bpm AS bar, ceil(greatest(duration, 240.0::DOUBLE / f.bpm) / (240.0::DOUBLE / f.bpm))::INT AS g,
  greatest(8, (round_even(((30.0 * 60 / (240.0::DOUBLE / f.tempo)) / count(*) OVER (PARTITION BY o.set_id) + 4) / 4, 0) * 4)::INT) AS nb
  FROM ordered o JOIN fate f USING (track_id) JOIN du USING (track_id) LEFT JOIN ds USING (track_id) LEFT JOIN (SELECT set_id, slot + 1 AS slot, b_start, shift FROM vi WHERE k = 1) z ON z.set_id = o.set_id AND z.slot = o.slot),
l1 AS (SELECT *, least(want, CASE WHEN g <= 1 THEN 0.0 ELSE greatest(0, g - 1 - nb) * bar END) AS s0 FROM l0),
l2 AS (SELECT *, least(greatest(0, ceil((s0 - 1e-6) / bar)::INT), g - 1) AS ix FROM l1),
l3 AS (SELECT *, ix * bar AS s1, CASE WHEN ix + nb < g THEN nb WHEN g - 1 - ix > 0 THEN g - 1 - ix ELSE nb END AS bars, CASE WHEN ix + nb < g THEN (ix + nb) * bar WHEN g - 1 - ix > 0 THEN (g - 1) * bar ELSE ix * bar + nb * bar END AS e1 FROM l2),
l4 AS (SELECT *, (greatest(least(s1, duration), least(duration, e1)) - least(s1, duration)) / rate AS seconds FROM l3),
l5 AS (SELECT *, CASE WHEN lag(slot) OVER w IS NULL THEN 0.0 ELSE least(8 * 240.0::DOUBLE / tempo, 0.5 * seconds) END AS overlap FROM l4 WHERE seconds > 0 WINDOW w AS (PARTITION BY set_id ORDER BY slot)),
laid AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY set_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - sum(overlap) OVER (PARTITION BY set_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS start FROM l5)"""


def labelled(spark, d):
    return analysis.labelled(views.sections(spark, d))


def counted_grid(bpm, duration):
    none = F.array().cast("array<double>")
    return sets.bar_grid(none, none, bpm, duration)


def laid(spark, d, minutes=MINUTES):
    """What many steps read, a row a track at most, is written to the shared folder once."""
    t, s, c = catalogue.music_tables(spark, d)
    k = store.kept(kept(spark, d).filter("fate = 'kept'").select("set_id", "track_id", "bpm", "tempo", "rate"))
    order = store.kept(matching.running_order(k.select("set_id", "track_id", "bpm"), matching.track_energy(s)))
    joins = matching.plan_set(order, t, s, c)
    told = store.kept(sets.starts_and_ends(analysis.labelled(s)))
    rows = order.join(k, ["set_id", "track_id"]).join(told.select("track_id", "duration"), "track_id").withColumn("grid", counted_grid(F.col("bpm"), F.col("duration")))
    return sets.layout(rows, joins, told.select("track_id", "default_start"), minutes)


def recursive(sql):
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query(recursive(v(f", {LAID} SELECT set_id, slot, track_id, round(start, 4) AS start, round(seconds, 4) AS seconds, round(overlap, 4) AS overlap, round(rate, 6) AS rate, shift, round(s0, 4) AS cut_start, bars::INT AS bars, CASE WHEN overlap > 0 THEN 'bass_swap' ELSE '' END AS transition FROM laid")))
def set_layout(spark, d):
    """Where each clip of each set lies."""
    rounded = [F.round(x, 4).alias(x) for x in ("start", "seconds", "overlap")]
    return laid(spark, d).select("set_id", "slot", "track_id", *rounded, F.round("rate", 6).alias("rate"), "shift", F.round("cut_start", 4).alias("cut_start"), "bars", F.coalesce("transition", F.lit("")).alias("transition"))


@query(recursive(v(f", {LAID} SELECT set_id, round(max(start + seconds), 4) AS length FROM laid GROUP BY 1")))
def set_length(spark, d):
    return sets.timeline_length(laid(spark, d)).select("set_id", F.round("length", 4).alias("length"))


EVENTS = f"""{LAID}, ev AS (SELECT set_id, greatest(start, 0.0) AS time, slot * 1000 + 1 AS ordinal, 'track_in' AS kind, artist || ' - ' || title AS label, track_id FROM laid JOIN tracks USING (track_id)
  UNION ALL SELECT set_id, start, slot * 1000, 'transition', 'bass_swap', track_id FROM laid WHERE overlap > 0
  UNION ALL SELECT set_id, greatest(laid.start, 0.0) + (s.start - s0) / rate, slot * 1000 + 2 + s.idx, 'cue', lab.label, track_id FROM laid JOIN sections s USING (track_id) JOIN lab USING (track_id, idx) WHERE lab.label IN ('drop', 'chorus') AND s.start - s0 > 0 AND s.start - s0 < seconds * rate)"""


def marked(spark, d):
    names = views.tracks(spark, d).select("track_id", F.concat_ws(" - ", "artist", "title").alias("label"))
    # Three kinds of events are made of the clips.
    return sets.events(store.kept(laid(spark, d)), labelled(spark, d), names)


@query(recursive(v(f", {EVENTS} SELECT set_id, round(time, 3) AS time, kind, label, track_id, row_number() OVER (PARTITION BY set_id ORDER BY round(time, 6), ordinal)::INT AS place FROM ev")))
def tracklist(spark, d):
    """Everything that happens in each set, in order."""
    m = marked(spark, d).withColumn("time", F.round("time", 6))
    return sets.tracklist(m).select("set_id", F.round("time", 3).alias("time"), "kind", "label", "track_id", "place")


@query(recursive(v(f""", {EVENTS}, hc AS (SELECT set_id, round(time, 6) AS time, ordinal, CASE WHEN kind = 'transition' THEN 'transition' ELSE label END AS k, tempo, 240.0::DOUBLE / tempo AS bar FROM ev JOIN tt USING (set_id) WHERE kind IN ('cue', 'transition')),
hp AS (SELECT * FROM hc WHERE time >= bar AND (('0x' || substr(md5('5:' || set_id || ':' || ordinal), 1, 8))::BIGINT::DOUBLE + 1) / 4294967296.0 <= CASE k WHEN 'transition' THEN 0.8::DOUBLE ELSE 1.0 END AND (time - least(4.0, bar) > 0 OR k IN ('drop', 'transition'))),
hs AS (SELECT set_id, list(struct_pack(t := time, o := ordinal, k := k, bar := bar) ORDER BY time, ordinal) AS m FROM hp GROUP BY 1),
hr AS (SELECT set_id, m, 1 AS i, m[1] AS x, true AS ok, m[1].t AS last FROM hs
  UNION ALL SELECT set_id, m, i + 1, m[i + 1], m[i + 1].t - last >= 10, CASE WHEN m[i + 1].t - last >= 10 THEN m[i + 1].t ELSE last END FROM hr WHERE i < len(m)),
he AS (SELECT set_id, x.t AS time, x.k AS on_kind, unnest(list_filter([CASE WHEN x.t - least(4.0, x.bar) > 0 THEN struct_pack(element := 'riser', start := x.t - least(4.0, x.bar), g := -6.0) END, CASE WHEN x.k IN ('drop', 'transition') THEN struct_pack(element := 'impact', start := x.t, g := -7.0) END, CASE WHEN x.k = 'drop' THEN struct_pack(element := 'airhorn', start := x.t + x.bar / 2, g := -8.0) END], lambda e: e IS NOT NULL)) AS e FROM hr WHERE ok)
SELECT set_id, round(time, 4) AS time, on_kind, e.element AS element, round(e.start, 4) AS start, e.g::DOUBLE AS gain_db FROM he""")))
def hype_elements(spark, d):
    """Risers, impacts and horns of heavily hyped sets."""
    m = marked(spark, d).withColumn("time", F.round("time", 6))
    t = views.tracks(spark, d).withColumn("set_id", F.expr(catalogue.SET))
    got = sets.hype(m, matching.set_tempi(t), "heavy", 5)
    return got.select("set_id", F.round("time", 4).alias("time"), "on_kind", "element", F.round("start", 4).alias("start"), "gain_db")


SPANS = "cl AS (SELECT o_orderkey AS clip_id, o_custkey % 8 AS deck, o_orderkey * 37 % 5000 AS start, o_custkey * 13 % 400 AS n FROM orders), wn AS (SELECT k AS window_id, dk AS deck, k * 90 AS w_start, 100 AS w_n FROM (SELECT unnest(range(55)) AS k), (SELECT unnest(range(8)) AS dk))"


def spans(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("clip_id"), (F.col("o_custkey") % 8).alias("deck"), (F.col("o_orderkey") * 37 % 5000).alias("start"), (F.col("o_custkey") * 13 % 400).alias("n"))
    w = spark.range(55).select(F.col("id").alias("window_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("deck"), (F.col("id") * 90).alias("w_start"), F.lit(100).cast("long").alias("w_n"))
    return o, w


@query(f"WITH {SPANS} SELECT deck, window_id, clip_id, greatest(0, w_start - start) AS take_from, greatest(0, start - w_start) AS write_at, least(n - greatest(0, w_start - start), w_n - greatest(0, start - w_start)) AS n FROM cl JOIN wn USING (deck) WHERE n > 0 AND start + n > w_start AND start < w_start + w_n")
def consume_tail(spark, d):
    """What of each clip sounds in each window."""
    return sets.overlapped(*spans(spark, d), 256.0, ["deck"])


@query(f"WITH {SPANS} SELECT clip_id, start, CASE WHEN 2500 - start >= 0 AND 2500 - start < n THEN 2500 - start ELSE n END AS n, CASE WHEN 2500 - start >= 0 AND 2500 - start < n THEN 0.0 ELSE 1.0 END AS fade_out FROM cl")
def truncate_timeline(spark, d):
    return sets.truncated(spans(spark, d)[0].withColumn("fade_out", F.lit(1.0)), F.lit(2500)).select("clip_id", "start", "n", "fade_out")


@query(v(", g AS (SELECT track_id, list(t - t0 ORDER BY i) FILTER (i % 4 = 0) AS grid, max(t - t0) AS duration FROM (SELECT *, min(t) OVER (PARTITION BY track_id) AS t0 FROM beats) GROUP BY 1), a AS (SELECT *, len(grid) AS n, duration * 0.6 AS want FROM g), b AS (SELECT *, coalesce(list_filter(grid, lambda x: x >= want - 1e-6)[1], grid[n]) AS nxt, coalesce(list_filter(grid, lambda x: x <= want + 1e-6)[-1], grid[1]) AS prv, list_min(list_transform(grid, lambda x: struct_pack(d := abs(x - want), t := x))).t AS nst, CASE WHEN n <= 1 THEN 0.0 ELSE grid[greatest(0, n - 1 - 8) + 1] END AS late FROM a), c AS (SELECT *, len(list_filter(grid, lambda x: x < nxt - 1e-6)) AS ix FROM b) SELECT track_id, round(nxt, 3) AS nxt, round(prv, 3) AS prv, round(nst, 3) AS nst, round(late, 3) AS late, CASE WHEN ix + 8 < n OR n - 1 - ix <= 0 THEN 8 ELSE n - 1 - ix END::INT AS bars, round(greatest(least(nxt, duration), least(duration, CASE WHEN ix + 8 < n THEN grid[ix + 9] WHEN n - 1 - ix <= 0 THEN nxt + 8 * 2.0 ELSE grid[n] END)), 3) AS until FROM c"))
def slice_on_bars(spark, d):
    """Snaps, the latest start and a cut of eight bars, on each track's own downbeats."""
    b = views.beats(spark, d)
    first = b.groupBy("track_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.array_sort(F.collect_list(F.struct("i", "t"))).alias("b"))
    grid = F.transform(F.filter("b", lambda x: x["i"] % 4 == 0), lambda x: x["t"] - F.col("t0"))
    g = first.select("track_id", (F.col("t1") - F.col("t0")).alias("duration"), grid.alias("grid")).withColumn("want", F.col("duration") * 0.6)
    c = F.col
    cut = sets.slice_bars(c("grid"), c("want"), F.lit(8), F.lit(120.0), c("duration"))
    r = lambda x, name: F.round(x, 3).alias(name)
    return g.withColumn("cut", cut).select("track_id", r(sets.snapped(c("grid"), c("want"), "next"), "nxt"), r(sets.snapped(c("grid"), c("want"), "prev"), "prv"), r(sets.snapped(c("grid"), c("want")), "nst"), r(sets.latest_start(c("grid"), F.lit(8)), "late"), c("cut.bars").alias("bars"), r(c("cut.end"), "until"))


@query(v(f""", {catalogue.PICKED}, {DUR}, m0 AS (SELECT mp.a, mp.b, a_start, b_start, mp.stretch, x.bpm AS abpm, y.bpm AS bbpm, p.duration AS ad, q.duration AS bd FROM mp JOIN tracks x ON x.track_id = mp.a JOIN tracks y ON y.track_id = mp.b JOIN du p ON p.track_id = mp.a JOIN du q ON q.track_id = mp.b),
m1 AS (SELECT *, unnest([struct_pack(w := 'a', s := a_start, bpm := abpm, d := ad), struct_pack(w := 'b', s := b_start, bpm := bbpm, d := bd)]) AS z FROM m0),
m2 AS (SELECT *, 240.0::DOUBLE / z.bpm AS bar, ceil(greatest(z.d, 240.0::DOUBLE / z.bpm) / (240.0::DOUBLE / z.bpm))::INT AS g FROM m1),
m3 AS (SELECT *, least(z.s, CASE WHEN g <= 1 THEN 0.0 ELSE greatest(0, g - 1 - 32) * bar END) AS s0 FROM m2),
m4 AS (SELECT *, least(greatest(0, ceil((s0 - 1e-6) / bar)::INT), g - 1) AS ix FROM m3),
m5 AS (SELECT *, greatest(least(ix * bar, z.d), least(z.d, CASE WHEN ix + 32 < g THEN (ix + 32) * bar WHEN g - 1 - ix > 0 THEN (g - 1) * bar ELSE ix * bar + 32 * bar END)) - least(ix * bar, z.d) AS span FROM m4),
m6 AS (SELECT a, b, any_value(abpm) AS abpm, min(CASE WHEN z.w = 'a' THEN span ELSE span / stretch END) AS length FROM m5 GROUP BY 1, 2),
m7 AS (SELECT a, b, length, 240.0::DOUBLE / abpm AS bar FROM m6 WHERE length > 0)
SELECT a, b, c.stem AS stem, round(c.start, 4) AS start, round(c.seconds, 4) AS seconds, c.gain AS gain_db, c.fi AS fade_in, round(c.fo, 4) AS fade_out FROM (SELECT a, b, unnest(list_filter([struct_pack(stem := 'instrumental', start := 0.0::DOUBLE, seconds := length, gain := -1.5::DOUBLE, fi := 0.05::DOUBLE, fo := bar), struct_pack(stem := 'vocals', start := 2 * bar, seconds := greatest(0.0, length - 2 * bar), gain := 1.5::DOUBLE, fi := 0.08::DOUBLE, fo := 0.5 * bar), CASE WHEN length > 4 * bar THEN struct_pack(stem := 'transition', start := length - 4 * bar, seconds := 4 * bar, gain := -1.5::DOUBLE, fi := 0.0::DOUBLE, fo := 0.0::DOUBLE) END], lambda e: e IS NOT NULL)) AS c FROM m7)"""))
def mashup_clips(spark, d):
    """The clips of a mashup of each two neighbours that have one."""
    length = views.sections(spark, d).groupBy("track_id").agg(F.max("end").alias("duration"))
    t = views.tracks(spark, d).select("track_id", "bpm").join(length, "track_id").withColumn("grid", counted_grid(F.col("bpm"), F.col("duration")))
    best = catalogue.picked(spark, d).select("a_track_id", "b_track_id", "a_start", "b_start", "stretch")
    got = sets.mashup(best.join(matching.side(t, "a"), "a_track_id").join(matching.side(t, "b"), "b_track_id"))
    return got.select(F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), "stem", F.round("start", 4).alias("start"), F.round("seconds", 4).alias("seconds"), "gain_db", "fade_in", F.round("fade_out", 4).alias("fade_out"))


@query(v(f", {catalogue.NEXT}, {catalogue.scored_sql('nx')}, r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY match DESC, shorter DESC, a_idx, b_idx) AS k FROM sp WHERE match >= 0.45) SELECT a, b, a_idx, b_idx, round(match, 6) AS total FROM r WHERE k = 1"))
def best_pair_per_track(spark, d):
    pairs = matching.section_pairs(catalogue.neighbours(spark, d), *catalogue.music_tables(spark, d), by=("match",), n=1, least=0.45).filter("match >= 0.45")
    return matching.best_of(pairs, "match").select(F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), "a_idx", "b_idx", F.round("match", 6).alias("total"))


CODE = "((((CASE WHEN {m} THEN {p} + 3 ELSE {p} END) % 12 + 12) % 12 * 7 % 12 + 7) % 12 + 1)::INT || CASE WHEN {m} THEN 'A' ELSE 'B' END"


def code_sql(pitch: str, minor: str) -> str:
    return CODE.replace("{p}", pitch).replace("{m}", minor)


@query(v(f""", {catalogue.PICKED}, w AS (SELECT mp.*, x.bpm AS x_bpm, {code_sql('x.pitch_class', 'x.minor')} AS ca, {code_sql('y.pitch_class', 'y.minor')} AS cb, {code_sql('(y.pitch_class + shift)', 'y.minor')} AS cs, least(x.confidence, y.confidence) < 0.11::DOUBLE AS unsure FROM mp JOIN tracks x ON x.track_id = a JOIN tracks y ON y.track_id = b)
SELECT a, b, a_label || ' -> ' || b_label AS move, 'tempo: ' || CASE ratio WHEN 2.0 THEN 'double-time' WHEN 0.5 THEN 'half-time' ELSE 'same tempo' END || printf(', stretch %+.1f%% to %.1f BPM (score %.2f, contributes %.3f)', (stretch - 1) * 100, x_bpm::DOUBLE, tempo, 0.30::DOUBLE * tempo) AS tempo_reason,
'key: ' || ca || ' vs ' || cb || ' -> ' || cs || ', ' || CASE distance WHEN 0 THEN 'same key' WHEN 1 THEN 'harmonically compatible' ELSE distance || ' steps apart on the wheel' END || CASE WHEN shift = 0 THEN '' ELSE printf(', shift %+d semitone', shift) || CASE WHEN abs(shift) = 1 THEN '' ELSE 's' END END
  || CASE WHEN unsure THEN ' (low key confidence, de-weighted)' ELSE '' END || printf(' (score %.2f, contributes %.3f)', key, 0.25::DOUBLE * key) AS key_reason,
printf('chroma similarity %.2f at %+d semitones (contributes %.3f)', chroma, shift, 0.30::DOUBLE * chroma) AS chroma_reason, printf('energy match %+.2f (score %.2f, contributes %.3f)', eb - ea, em, 0.15::DOUBLE * em) AS energy_reason,
round(0.30::DOUBLE * tempo, 4) AS share_tempo, round(0.25::DOUBLE * key, 4) AS share_key, round(0.15::DOUBLE * em, 4) AS share_energy FROM w"""))
def pair_explanations(spark, d):
    """Why each pick scored what it did."""
    told = matching.explained(catalogue.picked(spark, d).withColumnsRenamed({"total": "match", "energy": "energy_match"}), views.tracks(spark, d))
    said = [F.col("reasons")[i].alias(x) for i, x in enumerate(("move", "tempo_reason", "key_reason", "chroma_reason", "energy_reason"))]
    return told.select(F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), *said, "share_tempo", "share_key", "share_energy")


@query(v(f""", {catalogue.NEXT}, {catalogue.scored_sql('nx')}, best AS (SELECT a, b, max(match) AS best FROM sp GROUP BY 1, 2)
SELECT nx.a, nx.b, round(coalesce(best, 0), 6) AS best, CASE WHEN tk.a IS NULL THEN printf('tempo incompatible: %.1f vs %.1f BPM exceeds +/-8%% at every metrical level tried', x.bpm::DOUBLE, y.bpm::DOUBLE) WHEN best IS NOT NULL THEN printf('score %.3f below minimum 0.45', best) ELSE '' END AS rejected
FROM (SELECT DISTINCT a, b FROM nx) nx JOIN tracks x ON x.track_id = nx.a JOIN tracks y ON y.track_id = nx.b LEFT JOIN tk ON tk.a = nx.a AND tk.b = nx.b LEFT JOIN best ON best.a = nx.a AND best.b = nx.b WHERE best IS NULL OR best < 0.45"""))
def pair_refusals(spark, d):
    """Neighbours that cannot follow each other, and why."""
    told = matching.refusals(catalogue.neighbours(spark, d), *catalogue.music_tables(spark, d))
    return told.select(F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"), F.coalesce("rejected", F.lit("")).alias("rejected"))


#: Samples a second of the sets that are rendered, and their minutes.
RATE, SHORT = 16, 10.0


def set_audio(spark, d, clips):
    """Each section's sound is its embedding, again and again, a sample each sixteenth of a second. Sections that no clip reaches are not rendered."""
    s = views.sections(spark, d).withColumns({"first": F.ceil(F.col("start") * RATE).cast("long"), "until": F.ceil(F.col("end") * RATE).cast("long")}).filter("until > first")
    # A second to spare on both sides: reading between samples takes the next one along.
    heard = clips.select("track_id", (F.col("cut_start") * RATE - RATE).alias("_low"), (F.col("cut_start") * RATE + F.col("n") * F.col("rate") + RATE).alias("_high"))
    s = s.alias("s").join(heard.alias("h"), (F.col("s.track_id") == F.col("h.track_id")) & (F.col("first") <= F.col("_high")) & (F.col("until") >= F.col("_low")), "left_semi")
    e = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    return s.join(e, "vec_id").select("track_id", "first", (F.col("until") - F.col("first")).alias("m"), F.col("embedding").alias("x"))


PLACED = LAID.replace("30.0 * 60", f"{SHORT} * 60") + f""", g0 AS (SELECT *, floor(round(seconds, 9) * {RATE})::BIGINT AS n, floor(round(overlap, 9) * {RATE})::BIGINT AS m FROM laid),
g1 AS (SELECT *, CASE WHEN lag(slot) OVER w IS NULL THEN 0 ELSE least(m, n) END AS wish FROM g0 WHERE n > 0 WINDOW w AS (PARTITION BY set_id ORDER BY slot)),
g2 AS (SELECT *, greatest(0, least(wish, coalesce(lag(n - wish) OVER w, 0))) AS head FROM g1 WINDOW w AS (PARTITION BY set_id ORDER BY slot)),
g3 AS (SELECT *, coalesce(lag(n) OVER w - head, 0) AS step, n - coalesce(lead(head) OVER w, 0) AS keep FROM g2 WINDOW w AS (PARTITION BY set_id ORDER BY slot))"""


def mix_clips(spark, d):
    rows = laid(spark, d, SHORT).withColumns({"seconds": F.round("seconds", 9), "overlap": F.round("overlap", 9)})
    return mix.placed(rows, RATE)


@query(recursive(v(f", {PLACED} SELECT set_id, slot, track_id, sum(step) OVER (PARTITION BY set_id ORDER BY slot)::BIGINT AS first, n, head::BIGINT AS head, keep::BIGINT AS keep FROM g3")))
def set_mix_clips(spark, d):
    """Where each clip of each set begins and ends in samples, and what it shares with the one before."""
    return mix_clips(spark, d).select("set_id", "slot", "track_id", "first", "n", "head", "keep")


def set_mixes(spark, d):
    clips = store.kept(mix_clips(spark, d))
    return mix.pieces(clips, set_audio(spark, d, clips), RATE, options={"bass_swap": {"crossover_hz": 2.0}})


@query()
def set_mix(spark, d):
    """Every set as samples: cut, trimmed, joined, summed, mastered."""
    return mix.mastered(set_mixes(spark, d), RATE)[0].select("set_id", "i", F.round("v", 9).alias("v"))


@query()
def set_mix_report(spark, d):
    """What the master of every set did."""
    return mix.mastered(set_mixes(spark, d), RATE)[1]


#: The create flow: the tracks that a sample of the charts resolves to are one set.
CREATED = f"""{catalogue.MERGED}, {catalogue.LIB}, hits AS (SELECT * FROM (SELECT merged.*, lib.track_id, row_number() OVER (PARTITION BY lib.track_id ORDER BY merged.rank, key) AS k FROM merged JOIN lib USING (key)) WHERE k = 1),
draws AS (SELECT key, region, score, track_id, round(ln((('0x' || substr(md5('7:' || key), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0::DOUBLE) / greatest(score, 1e-6), 6) AS draw FROM hits),
cut_ AS (SELECT track_id, region, row_number() OVER (PARTITION BY region ORDER BY draw DESC, key) AS k FROM draws),
h AS (SELECT count(*) FILTER (region = 'IL') AS il, count(*) FILTER (region = 'global') AS gl FROM hits),
w0 AS (SELECT least(il, round_even(16 * 0.7, 0)::INT) AS wi, least(gl, 16 - least(il, round_even(16 * 0.7, 0)::INT)) AS wg, il, gl FROM h),
w1 AS (SELECT CASE WHEN il > wi THEN least(il, wi + 16 - wi - wg) ELSE wi END AS ti, CASE WHEN il > wi OR gl <= wg THEN wg ELSE least(gl, wg + 16 - wi - wg) END AS tg FROM w0),
picked AS (SELECT track_id AS pt FROM cut_, w1 WHERE k <= CASE WHEN region = 'IL' THEN ti ELSE tg END)"""
ONE_SET = LAID.replace("(track_id - 1) // 20 AS set_id, bpm, CASE", "0 AS set_id, bpm, CASE").replace("AS f FROM tracks)", "AS f FROM tracks JOIN picked ON pt = track_id)").replace("(track_id - 1) // 20 AS set_id, list(", "0 AS set_id, list(").replace("scored AS", "scored_ AS")


def created(spark, d):
    t, s, c = catalogue.music_tables(spark, d)
    length = s.groupBy("track_id").agg(F.max("end").alias("duration"))
    grids = t.select("track_id", "bpm").join(length, "track_id").select("track_id", counted_grid(F.col("bpm"), F.col("duration")).alias("grid"), "duration")
    return create.create_set(views.charts(spark, d), t, s, c, grids, MINUTES, 8)


@query(recursive(v(f", {CREATED}, {ONE_SET} SELECT slot, track_id, round(start, 4) AS start, round(seconds, 4) AS seconds, round(overlap, 4) AS overlap, round(rate, 6) AS rate, shift, bars::INT AS bars FROM laid")))
def create_set(spark, d):
    """From the charts to the clips of one set."""
    rounded = [F.round(x, 4).alias(x) for x in ("start", "seconds", "overlap")]
    return created(spark, d)["clips"].select("slot", "track_id", *rounded, F.round("rate", 6).alias("rate"), "shift", "bars")
