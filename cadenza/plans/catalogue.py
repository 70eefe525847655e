"""Queries over the fixture views, each with the DuckDB text that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cadenza.functions import music, text
from cadenza.operators import analysis, charts, joins, levels, matching, segments, store
from cadenza.plans.registry import ORACLES, QUERIES, query, v
from cadenza.sources import views, wav
from cadenza.streaming import jobs

def norm(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '[\\(\\[\\{{][^\\)\\]\\}}]*[\\)\\]\\}}]', ' ', 'g')"
    x = f"regexp_replace({x}, '\\b(official|video|audio|lyrics?|lyric|hd|4k|remaster(ed)?|feat\\.?|ft\\.?|prod\\.?|explicit|radio edit|full|clip|music)\\b', ' ', 'gi')"
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s\\x{{0590}}-\\x{{05FF}}]', ' ', 'g')"
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def key_of(title: str, artist: str) -> str:
    return f"trim({norm(artist)} || ' ' || {norm(title)})"


MERGED = f"""keyed AS (SELECT *, {key_of('title', 'artist')} AS key FROM charts),
grouped AS (SELECT key, arg_min(struct_pack(t := title, a := artist), struct_pack(a := rank, b := provider, c := region, d := song)) AS best, list_sort(list_distinct(list(provider))) AS ps, min(CASE WHEN region = 'IL' THEN rank END) AS il, min(rank) AS r FROM keyed WHERE key <> '' GROUP BY key),
scored AS (SELECT key, best.t AS title, best.a AS artist, array_to_string(ps, ',') AS providers, CASE WHEN il IS NOT NULL THEN 'IL' ELSE 'global' END AS region, coalesce(il, r) AS best_rank,
  round(greatest(0.0::DOUBLE, 1 - ln(coalesce(il, r)::DOUBLE) / ln(50.0::DOUBLE)) * CASE WHEN il IS NOT NULL THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * CASE WHEN len(ps) > 1 THEN 1 + 0.15::DOUBLE * (len(ps) - 1) ELSE 1.0 END, 9) AS score FROM grouped),
merged AS (SELECT *, row_number() OVER (ORDER BY score DESC, key)::INT AS rank FROM scored ORDER BY score DESC, key LIMIT 200)"""
LIB = f"lib AS (SELECT {key_of('title', 'artist')} AS key, max(track_id) AS track_id FROM tracks GROUP BY 1)"


def merged(spark, d):
    return charts.merge_trends(views.charts(spark, d))


@query(f"{MERGED} SELECT * FROM merged")
def merge_trends(spark, d):
    return merged(spark, d)


@query(v("SELECT provider, region, song, rank FROM charts"))
def chart_union(spark, d):
    c = views.charts(spark, d)
    return charts.chart_union([c.filter(F.col("provider") == p) for p in "abc"]).select("provider", "region", "song", "rank")


@query(v("SELECT provider, count(*) FILTER (region = 'IL') AS il, count(*) FILTER (region = 'global') AS world FROM charts GROUP BY provider"))
def provider_status(spark, d):
    return charts.provider_status(views.charts(spark, d))


@query(v("SELECT provider, region, song, round(greatest(0.0, 1 - ln(rank::DOUBLE) / ln(50.0::DOUBLE)), 9) AS score FROM charts"))
def rank_score(spark, d):
    return views.charts(spark, d).select("provider", "region", "song", F.round(music.rank_score(F.col("rank")), 9).alias("score"))


@query(f"""{MERGED}, draws AS (SELECT key, region, score, round(ln((('0x' || substr(md5('7:' || key), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0::DOUBLE) / greatest(score, 1e-6), 6) AS draw FROM merged),
placed AS (SELECT key, region, score, row_number() OVER (PARTITION BY region ORDER BY draw DESC, key) AS k FROM draws),
h AS (SELECT count(*) FILTER (region = 'IL') AS il, count(*) FILTER (region = 'global') AS gl FROM merged),
w AS (SELECT least(il, round_even(25 * 0.7, 0)::INT) AS wi, least(gl, 25 - least(il, round_even(25 * 0.7, 0)::INT)) AS wg, il, gl FROM h),
z AS (SELECT CASE WHEN il > wi THEN least(il, wi + 25 - wi - wg) ELSE wi END AS ti, CASE WHEN il > wi OR gl <= wg THEN wg ELSE least(gl, wg + 25 - wi - wg) END AS tg FROM w)
SELECT key, region, row_number() OVER (ORDER BY score DESC, key)::INT AS place FROM placed, z WHERE k <= CASE WHEN region = 'IL' THEN ti ELSE tg END""")
def weighted_sample(spark, d):
    return charts.weighted_sample(merged(spark, d), 25, 0.7, 7).select("key", "region", "place")


@query(f"{MERGED}, {LIB} SELECT key, track_id, rank, 100.0::DOUBLE AS match_score FROM merged JOIN lib USING (key)")
def resolve_exact(spark, d):
    return charts.resolve_exact(merged(spark, d), views.tracks(spark, d))


@query(f"{MERGED}, {LIB} SELECT key, rank FROM merged WHERE key NOT IN (SELECT {key_of('title', 'artist')} FROM tracks WHERE album <> 'PROMO')")
def missing_trends(spark, d):
    """Charted songs of which the library holds nothing but promos."""
    return charts.missing(merged(spark, d), views.tracks(spark, d).filter("album <> 'PROMO'")).select("key", "rank")


@query(f"{MERGED}, {LIB}, hits AS (SELECT key, rank, track_id // 7 AS track_id FROM merged JOIN lib USING (key)) SELECT key, rank, track_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY rank, key) AS n FROM hits) WHERE n = 1")
def claim_once(spark, d):
    hits = charts.resolve_exact(merged(spark, d), views.tracks(spark, d)).select("key", "rank", F.expr("track_id div 7").alias("track_id"))
    return charts.claim_once(hits)


@query(f"{MERGED}, {LIB} SELECT count(*) AS n, coalesce(round(avg(CASE WHEN lib.key IS NULL THEN 0 ELSE 1 END), 9), 0.0) AS coverage FROM merged LEFT JOIN lib USING (key)")
def coverage(spark, d):
    m, t = merged(spark, d), views.tracks(spark, d)
    return charts.coverage(charts.resolve_exact(m, t), charts.missing(m, t))


@query(v("SELECT track_id, artist || ' - ' || title AS label, bpm, CASE WHEN bpm > 0 THEN round(60 / bpm, 9) ELSE 0.0 END AS beat FROM tracks"))
def scan_library(spark, d):
    return views.tracks(spark, d).select("track_id", F.concat_ws(" - ", "artist", "title").alias("label"), "bpm", F.when(F.col("bpm") > 0, F.round(60 / F.col("bpm"), 9)).otherwise(0.0).alias("beat"))


@query("SELECT l.o_custkey AS key, l.o_orderkey AS seq, l.o_orderstatus AS payload FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) l WHERE n = 1")
def upsert_latest(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("payload"))
    return store.upsert_latest(o, "key", ["at", "seq"]).select("key", "seq", "payload")


@query(v("SELECT track_id FROM tracks WHERE track_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"))
def delete_override(spark, d):
    gone = views.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("track_id"))
    return store.delete(views.tracks(spark, d).select("track_id"), gone, "track_id")


@query(v("SELECT t.track_id, coalesce(o.pc, t.pitch_class)::INT AS pitch_class, coalesce(o.mi, t.minor) AS minor, CASE WHEN o.pc IS NOT NULL THEN 1.0 ELSE t.confidence END AS confidence, CASE WHEN o.pc IS NOT NULL THEN 'manual' ELSE 'detected' END AS source FROM tracks t LEFT JOIN (SELECT s_suppkey AS track_id, s_nationkey % 12 AS pc, s_nationkey % 2 = 0 AS mi FROM supplier) o USING (track_id)"))
def key_override(spark, d):
    o = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("track_id"), (F.col("s_nationkey") % 12).alias("pitch_class"), (F.col("s_nationkey") % 2 == 0).alias("minor"))
    return store.with_overrides(views.tracks(spark, d).select("track_id", "pitch_class", "minor", "confidence"), o, "track_id")


@query("SELECT event_id FROM events WHERE 1706000000 - epoch_us(ts) / 1e6 <= 24 * 3600")
def cache_ttl(spark, d):
    e = views.table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return store.fresh(e, "at", 1706000000.0, 24).select("event_id")


@query(f"SELECT p_partkey AS id, {norm('p_name')} AS name, {key_of('p_name', 'p_brand')} AS key FROM part")
def normalize_text(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.normalize(F.col("p_name")).alias("name"), text.match_key(F.col("p_name"), F.col("p_brand")).alias("key"))


@query("SELECT page_id, CASE WHEN s LIKE '%riser%' THEN 'riser' WHEN s LIKE '%impact%' THEN 'impact' WHEN s LIKE '%airhorn%' THEN 'airhorn' WHEN s LIKE '%shout%' THEN 'shout' WHEN s LIKE '%sweep%' THEN 'sweep' WHEN s LIKE '%build%' THEN 'riser' WHEN s LIKE '%up%' THEN 'riser' WHEN s LIKE '%hit%' OR s LIKE '%boom%' THEN 'impact' WHEN s LIKE '%downlifter%' THEN 'sweep' WHEN s LIKE '%horn%' THEN 'airhorn' WHEN s LIKE '%vox%' OR s LIKE '%voice%' THEN 'shout' END AS kind FROM (SELECT page_id, lower(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '')) AS s FROM pages)")
def classify_sample(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.classify(F.col("url")).alias("kind"))


@query("SELECT o_orderkey AS id, printf('%02d:%05.2f', (o_orderkey // 60)::BIGINT, (o_orderkey % 60)::DOUBLE + 0.25::DOUBLE) AS code FROM orders")
def timecode(spark, d):
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.timecode(F.col("o_orderkey") + F.lit(0.25)).alias("code"))


PAIRS = "p AS (SELECT a.track_id AS a, b.track_id AS b, a.bpm AS x, b.bpm AS y, a.pitch_class AS pa, b.pitch_class AS pb, a.minor AS ma, b.minor AS mb, least(a.confidence, b.confidence) AS cf FROM tracks a JOIN tracks b ON (a.track_id - 1) // 20 = (b.track_id - 1) // 20 AND a.track_id <> b.track_id)"
TEMPO = "t AS (SELECT a, b, pa, pb, ma, mb, cf, list_max([CASE WHEN abs(y * q[1] - x) / x <= 0.08::DOUBLE THEN struct_pack(s := (1 - abs(y * q[1] - x) / x / 0.08::DOUBLE) * q[2], o := -q[3], r := q[1], st := x / (y * q[1])) END FOR q IN [[1.0, 1.0, 0.0], [2.0, 0.92, 1.0], [0.5, 0.92, 2.0]]::DOUBLE[][]]) AS m FROM p)"


#: The whole library, dealt into sets of twenty.
SET = "(track_id - 1) div 20"


def set_pairs(spark, d):
    """Each two tracks of one set, in as many partitions as the session says: a small file of tracks is one task's, its pairs are not."""
    t = views.tracks(spark, d)
    a, b = (matching.side(t, p).withColumn("set_id", F.expr(SET.replace("track_id", f"{p}_track_id"))) for p in "ab")
    return a.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "set_id").join(b, "set_id").filter("a_track_id <> b_track_id")


@query(f"{PAIRS}, {TEMPO} SELECT a, b, round(CASE WHEN m.s > 0 THEN m.s ELSE 0 END, 9) AS score, CASE WHEN m.s > 0 THEN m.r ELSE 1.0 END AS ratio, round(CASE WHEN m.s > 0 THEN m.st ELSE 1.0 END, 9) AS stretch FROM t")
def tempo_compat(spark, d):
    t = music.tempo(F.col("a_bpm"), F.col("b_bpm"))
    return set_pairs(spark, d).select(F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), t.alias("t")).select("a", "b", F.round("t.score", 9).alias("score"), "t.ratio", F.round("t.stretch", 9).alias("stretch"))


@query(v("SELECT a.track_id AS a, count(DISTINCT b.track_id) AS n FROM tracks a, tracks b, (SELECT unnest([1.0, 2.0, 0.5]::DOUBLE[]) AS r) WHERE abs(b.bpm * r - a.bpm) <= 0.02::DOUBLE * a.bpm GROUP BY 1"))
def tempo_band_join(spark, d):
    t = views.tracks(spark, d)
    a, b = (t.select(F.col("track_id").alias(f"{p}_id"), F.col("bpm").alias(f"{p}_bpm")) for p in "ab")
    return joins.tempo_band_counts(a, b, 0.02).withColumnRenamed("a_id", "a")


@query(v("SELECT track_id, CASE WHEN bpm * 4 < 82 THEN bpm * 8 WHEN bpm * 2 < 82 THEN bpm * 4 WHEN bpm < 82 THEN bpm * 2 WHEN bpm > 164 THEN bpm / 2 ELSE bpm END AS folded FROM tracks"))
def fold_tempo(spark, d):
    return views.tracks(spark, d).select("track_id", music.fold_tempo(F.col("bpm"))["bpm"].alias("folded"))


@query(v(", f AS (SELECT track_id, CASE WHEN bpm < 82 THEN bpm * 2 WHEN bpm > 164 THEN bpm / 2 ELSE bpm END AS f FROM tracks), c AS (SELECT a.f, min(a.track_id) AS first, count(*) / count(DISTINCT a.track_id) AS n FROM f a JOIN f b ON abs(b.f - a.f) / a.f <= 0.08::DOUBLE GROUP BY a.f), best AS (SELECT * FROM c ORDER BY n DESC, first LIMIT 1) SELECT round(median(f.f), 6) AS tempo, count(*) AS n FROM f, best WHERE abs(f.f - best.f) / best.f <= 0.08::DOUBLE"))
def set_tempo(spark, d):
    return matching.set_tempo(views.tracks(spark, d))


STRETCH = "s AS (SELECT track_id, list_min([struct_pack(d := greatest(120 / (bpm * q[1]), bpm * q[1] / 120) - 1, o := q[2], r := 120 / (bpm * q[1])) FOR q IN [[0.25, 0], [0.5, 1], [1, 2], [2, 3], [4, 4]]::DOUBLE[][]]) AS m FROM tracks)"


@query(f"{STRETCH} SELECT track_id, round(m.r, 9) AS rate, round(m.d, 9) AS deviation, round(m.d, 9) <= 0.12 AS kept FROM s")
def keep_drop_cap(spark, d):
    return matching.keep_or_drop(views.tracks(spark, d), 120.0)


WHEEL = "((CASE WHEN {m} THEN ({p} + 3) % 12 ELSE {p} % 12 END * 7) % 12 + 7) % 12 + 1"


@query(v(f"SELECT track_id, ({WHEEL.format(m='minor', p='pitch_class')})::VARCHAR || CASE WHEN minor THEN 'A' ELSE 'B' END AS code, pitch_class::INT AS pitch_class, CASE WHEN minor THEN 'minor' ELSE 'major' END AS mode FROM tracks"))
def camelot_codes(spark, d):
    code = music.camelot(F.col("pitch_class"), F.col("minor"))
    return views.tracks(spark, d).select("track_id", code.alias("code")).select("track_id", "code", music.pitch_of(F.col("code"))["pitch_class"].cast("int").alias("pitch_class"), music.pitch_of(F.col("code"))["mode"].alias("mode"))


KEYS = f"""k0 AS (SELECT a, b, cf, ma, mb, s.s AS s, {WHEEL.format(m='ma', p='pa')} AS na, {WHEEL.format(m='mb', p='((pb + s.s + 12) % 12)')} AS nb FROM p, (SELECT unnest([-2, -1, 0, 1, 2]) AS s) s),
k1 AS (SELECT *, CASE WHEN ma = mb THEN least((na - nb + 12) % 12, (nb - na + 12) % 12) WHEN na = nb THEN 1 ELSE least((na - nb + 12) % 12, (nb - na + 12) % 12) + 2 END AS dist FROM k0),
k2 AS (SELECT *, CASE dist WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.55::DOUBLE WHEN 3 THEN 0.3::DOUBLE ELSE greatest(0.0::DOUBLE, 0.2::DOUBLE - 0.05::DOUBLE * (dist - 4)) END - 0.04::DOUBLE * abs(s) AS raw FROM k1),
k AS (SELECT a, b, any_value(cf) AS cf, max(struct_pack(raw := raw, o := -s, d := dist)) AS m FROM k2 GROUP BY a, b)"""


@query(f"{PAIRS}, {KEYS} SELECT a, b, round(least(1, cf / 0.11::DOUBLE) * greatest(0.0::DOUBLE, least(1.0::DOUBLE, m.raw)) + (1 - least(1, cf / 0.11::DOUBLE)) * 0.5::DOUBLE, 9) AS score, (-m.o)::INT AS shift, m.d::INT AS distance FROM k")
def key_compat(spark, d):
    c = F.col
    k = music.key_match(c("a_pitch_class"), c("a_minor"), c("b_pitch_class"), c("b_minor"), c("a_confidence"), c("b_confidence"))
    return set_pairs(spark, d).select(c("a_track_id").alias("a"), c("b_track_id").alias("b"), k.alias("k")).select("a", "b", F.round("k.score", 9).alias("score"), c("k.shift").cast("int").alias("shift"), c("k.distance").cast("int").alias("distance"))


@query(v("SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0.0, least(1.0, list_cosine_similarity(a.chroma, b.chroma[11:12] || b.chroma[1:10]))), 6) AS cosine FROM chroma a JOIN chroma b ON b.vec_id = a.vec_id + 1"))
def chroma_cosine(spark, d):
    c = views.chroma(spark, d)
    b = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("chroma").alias("other"))
    return c.join(b, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(music.cosine(F.col("chroma"), music.rotate(F.col("other"), F.lit(2))), 6).alias("cosine"))


@query(v("SELECT track_id, idx, round(greatest(0.0, least(1.0, 1 - abs(nx - energy) / 0.15::DOUBLE)), 9) AS m, round(greatest(0.0, least(1.0, 1 - abs(nx - energy - 0.25::DOUBLE) / 0.25::DOUBLE)), 9) AS b, round(greatest(0.0, least(1.0, 1 - abs(nx - energy + 0.25::DOUBLE) / 0.25::DOUBLE)), 9) AS dr FROM (SELECT *, lead(energy) OVER (PARTITION BY track_id ORDER BY idx) AS nx FROM sections) WHERE nx IS NOT NULL"))
def energy_compat(spark, d):
    nx = F.lead("energy").over(Window.partitionBy("track_id").orderBy("idx"))
    s = views.sections(spark, d).withColumn("nx", nx).filter("nx is not null")
    e = lambda intent: F.round(music.energy(F.col("energy"), F.col("nx"), intent), 9)
    return s.select("track_id", "idx", e("match").alias("m"), e("build").alias("b"), e("drop").alias("dr"))


#: Neighbours of each set, in the library's order.
NEXT = "nx AS (SELECT a.track_id AS a, b.track_id AS b FROM tracks a JOIN tracks b ON b.track_id = a.track_id + 1 AND (a.track_id - 1) // 20 = (b.track_id - 1) // 20)"


def scored_sql(pairs: str) -> str:
    """Section pairs of ``pairs(a, b)`` with all terms; from tempo and key tables over the same pairs."""
    return f"""p AS (SELECT {pairs}.a, {pairs}.b, x.bpm AS x, y.bpm AS y, x.pitch_class AS pa, y.pitch_class AS pb, x.minor AS ma, y.minor AS mb, least(x.confidence, y.confidence) AS cf FROM {pairs} JOIN tracks x ON x.track_id = a JOIN tracks y ON y.track_id = b),
{TEMPO}, {KEYS},
tk AS (SELECT t.a, t.b, t.m.s AS tempo, t.m.r AS ratio, t.m.st AS stretch, least(1, k.cf / 0.11::DOUBLE) * greatest(0.0::DOUBLE, least(1.0::DOUBLE, k.m.raw)) + (1 - least(1, k.cf / 0.11::DOUBLE)) * 0.5::DOUBLE AS key, (-k.m.o)::INT AS shift, k.m.d::INT AS distance FROM (SELECT t.a, t.b, t.m FROM t) t JOIN k ON k.a = t.a AND k.b = t.b WHERE t.m.s > 0),
long AS (SELECT track_id, idx, start, "end", energy, chroma FROM sections JOIN chroma USING (vec_id) WHERE "end" - start >= 8),
sp0 AS (SELECT tk.*, u.idx AS a_idx, w.idx AS b_idx, u.start AS a_start, w.start AS b_start, least(u."end" - u.start, w."end" - w.start) AS shorter, u.energy AS ea, w.energy AS eb,
  greatest(0.0, least(1.0, list_cosine_similarity(u.chroma, w.chroma[13 - (shift + 12) % 12:12] || w.chroma[1:12 - (shift + 12) % 12]))) AS chroma
  FROM tk JOIN long u ON u.track_id = tk.a JOIN long w ON w.track_id = tk.b),
sp1 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs(eb - ea) / 0.15::DOUBLE)) AS em, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs(eb - ea - 0.25::DOUBLE) / 0.25::DOUBLE)) AS eu FROM sp0),
sp AS (SELECT *, round(0.30::DOUBLE * tempo + 0.25::DOUBLE * key + 0.30::DOUBLE * chroma + 0.15::DOUBLE * em, 9) AS match, round(0.30::DOUBLE * tempo + 0.25::DOUBLE * key + 0.30::DOUBLE * chroma + 0.15::DOUBLE * eu, 9) AS build FROM sp1)"""


def neighbours(spark, d):
    t = views.tracks(spark, d).select("track_id")
    b = t.select(F.col("track_id").alias("b_track_id"), (F.col("track_id") - 1).alias("a_track_id"))
    return t.withColumnRenamed("track_id", "a_track_id").join(b, "a_track_id").filter(f"{SET.replace('track_id', 'a_track_id')} = {SET.replace('track_id', 'b_track_id')}")


def music_tables(spark, d):
    return views.tracks(spark, d), views.sections(spark, d), views.chroma(spark, d)


@query(v(f", {NEXT}, {scored_sql('nx')}, r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY match DESC, shorter DESC, a_idx, b_idx)::INT AS place FROM sp WHERE match >= 0.45) SELECT a, b, place, a_idx, b_idx, round(tempo, 6) AS tempo, round(key, 6) AS key, round(chroma, 6) AS chroma, round(em, 6) AS energy, round(match, 6) AS total FROM r WHERE place <= 20"))
def rank_pairs(spark, d):
    """The best section pairs of all neighbours."""
    got = matching.rank_pairs(neighbours(spark, d), *music_tables(spark, d))
    return got.select(F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), "place", "a_idx", "b_idx", *[F.round(x, 6).alias(x) for x in ("tempo", "key", "chroma", "energy", "total")])


ENERGY = "en AS (SELECT track_id, round(0.6::DOUBLE * max(energy) + 0.4::DOUBLE * avg(energy), 9) AS energy FROM sections GROUP BY 1)"


@query(f"{ENERGY} SELECT * FROM en")
def track_energy(spark, d):
    return matching.track_energy(views.sections(spark, d))


def ordered(spark, d):
    t = views.tracks(spark, d).withColumn("set_id", F.expr(SET))
    return matching.running_order(t.select("set_id", "track_id", "bpm"), matching.track_energy(views.sections(spark, d)))


SCORE = "greatest(0.0::DOUBLE, CASE WHEN abs({y} - {x}) / {x} <= 0.08::DOUBLE THEN 1 - abs({y} - {x}) / {x} / 0.08::DOUBLE ELSE 0 END, CASE WHEN abs({y} * 2 - {x}) / {x} <= 0.08::DOUBLE THEN (1 - abs({y} * 2 - {x}) / {x} / 0.08::DOUBLE) * 0.92::DOUBLE ELSE 0 END, CASE WHEN abs({y} * 0.5::DOUBLE - {x}) / {x} <= 0.08::DOUBLE THEN (1 - abs({y} * 0.5::DOUBLE - {x}) / {x} / 0.08::DOUBLE) * 0.92::DOUBLE ELSE 0 END)"
ARC = "CASE WHEN n <= 1 THEN 0.6 WHEN slot / (n - 1)::DOUBLE <= 0.75 THEN 0.45 + slot / (n - 1)::DOUBLE / 0.75 * 0.5 ELSE 0.95 - (slot / (n - 1)::DOUBLE - 0.75) / 0.25 * 0.35 END"
_S = SCORE.format(x="last", y="c.bpm")
ORDER = f"""{ENERGY},
pool AS (SELECT (track_id - 1) // 20 AS set_id, list(struct_pack(id := track_id, bpm := bpm, e := energy) ORDER BY track_id) AS tail, count(*) AS n FROM tracks JOIN en USING (track_id) GROUP BY 1),
rec AS (SELECT set_id, n, 0 AS slot, tail, NULL::DOUBLE AS last, NULL::BIGINT AS track_id FROM pool
  UNION ALL SELECT set_id, n, slot + 1, list_filter(tail, lambda c: c.id <> b.id), b.bpm, b.id FROM (SELECT *, list_min(list_transform(tail, lambda c: struct_pack(c := round(abs(c.e - ({ARC})) + CASE WHEN last IS NULL THEN 0 ELSE CASE WHEN {_S} > 0 THEN 0 ELSE 0.6 END + 0.25 * (1 - {_S}) END, 9), id := c.id, bpm := c.bpm))) AS b FROM rec WHERE slot < n)),
ordered AS (SELECT set_id, (slot - 1)::INT AS slot, track_id FROM rec WHERE slot > 0)"""


@query(v(f", {ORDER} SELECT * FROM ordered").replace("WITH", "WITH RECURSIVE", 1))
def order_energy_flow(spark, d):
    return ordered(spark, d)


@query(v(f""", {ORDER}, st AS (SELECT set_id, slot, track_id AS a, lead(track_id) OVER w AS b, CASE WHEN slot < 0.75 * count(*) OVER (PARTITION BY set_id) THEN 'build' ELSE 'match' END AS wanted FROM ordered WINDOW w AS (PARTITION BY set_id ORDER BY slot)),
js AS (SELECT * FROM st WHERE b IS NOT NULL), {scored_sql('js')},
ei AS (SELECT js.set_id, js.slot, js.wanted, sp.*, unnest([struct_pack(i := 'build', v := build), struct_pack(i := 'match', v := match)]) AS e FROM js JOIN sp ON sp.a = js.a AND sp.b = js.b),
vi AS (SELECT *, row_number() OVER (PARTITION BY set_id, slot ORDER BY CASE WHEN e.i = wanted THEN 0 ELSE 1 END, e.v DESC, shorter DESC, a_idx, b_idx) AS k FROM ei WHERE e.v >= 0.45)
SELECT js.set_id, js.slot, js.a, js.b, coalesce(e.i, '') AS intent, coalesce(a_idx, -1) AS a_idx, coalesce(b_idx, -1) AS b_idx, coalesce(round(e.v, 6), 0.0) AS score, e.i IS NULL AS hard_cut FROM js LEFT JOIN (SELECT * FROM vi WHERE k = 1) z ON z.set_id = js.set_id AND z.slot = js.slot""").replace("WITH", "WITH RECURSIVE", 1))
def plan_set(spark, d):
    got = matching.plan_set(ordered(spark, d), *music_tables(spark, d))
    return got.select("set_id", "slot", F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), F.coalesce("intent", F.lit("")).alias("intent"), F.coalesce("a_idx", F.lit(-1)).alias("a_idx"), F.coalesce("b_idx", F.lit(-1)).alias("b_idx"), F.coalesce(F.round("total", 6), F.lit(0.0)).alias("score"), "hard_cut")


@query("SELECT id, i, n, round(CASE WHEN n <= 1 THEN 0.6 WHEN i / (n - 1)::DOUBLE <= 0.75 THEN 0.45 + i / (n - 1)::DOUBLE / 0.75 * 0.5 ELSE 0.95 - (i / (n - 1)::DOUBLE - 0.75) / 0.25 * 0.35 END, 6) AS target FROM (SELECT o_orderkey AS id, o_custkey % 16 + 1 AS n, o_orderkey % (o_custkey % 16 + 1) AS i FROM orders)")
def energy_arc(spark, d):
    """Where the arc stands at a place of each set of one to sixteen tracks."""
    n = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 16 + 1).alias("n")).withColumn("i", F.col("id") % F.col("n"))
    return n.select("id", "i", "n", F.round(music.arc(F.col("i").cast("double"), F.col("n").cast("double")), 6).alias("target"))


@query(v("SELECT track_id, phase, accent FROM (SELECT track_id, i % 4 AS phase, round(avg(accent), 9) AS accent, row_number() OVER (PARTITION BY track_id ORDER BY round(avg(accent), 9) DESC, i % 4) AS n FROM beats GROUP BY track_id, i % 4) WHERE n = 1"))
def infer_downbeats(spark, d):
    return analysis.downbeats(views.beats(spark, d))


@query(v("SELECT track_id, round(median(x), 6) AS median, round(stddev_pop(x), 4) AS sd FROM (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY i) AS x FROM beats) GROUP BY 1"))
def beat_intervals(spark, d):
    return analysis.intervals(views.beats(spark, d))


@query(v(", q AS (SELECT track_id, quantile_cont(accent, 0.02) AS lo, quantile_cont(accent, 0.98) AS hi FROM beats GROUP BY 1), e AS (SELECT track_id, i, CASE WHEN hi - lo < 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, (accent - lo) / (hi - lo))) END AS e FROM beats JOIN q USING (track_id)) SELECT track_id, i, round(sum(e) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS energy FROM e"))
def energy_curve(spark, d):
    return analysis.energy_curve(views.beats(spark, d))


CHROMA = "sc0 AS (SELECT track_id, unnest(range(12)) AS pitch, unnest(chroma) AS v FROM sections JOIN chroma USING (vec_id)), sc1 AS (SELECT track_id, pitch::INT AS pitch, avg(v) AS v FROM sc0 GROUP BY ALL), sc AS (SELECT track_id, pitch, round(v / sum(v) OVER (PARTITION BY track_id), 9) AS v FROM sc1)"


@query(f"{CHROMA} SELECT * FROM sc")
def section_chroma(spark, d):
    return analysis.section_chroma(views.sections(spark, d), views.chroma(spark, d))


@query(f"""{CHROMA}, pf AS (SELECT m.m, k.k, p.p, (CASE WHEN m.m = 0 THEN {list(analysis.TEMPERLEY[0])} ELSE {list(analysis.TEMPERLEY[1])} END)[(p.p - k.k + 12) % 12 + 1]::DOUBLE AS w FROM (SELECT unnest(range(2)) AS m) m, (SELECT unnest(range(12)) AS k) k, (SELECT unnest(range(12)) AS p) p),
co AS (SELECT track_id, m, k, m * 12 + k AS ord, round(coalesce(corr(v, w), 0), 9) AS r FROM sc JOIN pf ON p = pitch GROUP BY ALL),
be AS (SELECT track_id, max(struct_pack(r := r, o := -ord, m := m, k := k)) AS b, max(r) - min(r) AS spread FROM co GROUP BY 1),
nx AS (SELECT track_id, b, spread, max(r) AS nxt FROM co JOIN be USING (track_id) WHERE ord <> -b.o AND NOT (k = (b.k + CASE WHEN b.m = 0 THEN 9 ELSE 3 END) % 12 AND m <> b.m) GROUP BY ALL)
SELECT track_id, b.k::INT AS pitch_class, CASE WHEN b.m = 0 THEN 'major' ELSE 'minor' END AS mode, round(greatest(0.0, least(1.0, coalesce((b.r - nxt) / nullif(spread, 0), 0))), 6) AS confidence FROM nx""")
def key_estimate(spark, d):
    return analysis.key_estimate(analysis.section_chroma(views.sections(spark, d), views.chroma(spark, d)))


@query(v(", q AS (SELECT track_id, quantile_cont(energy, 0.5) AS p50, quantile_cont(energy, 0.7) AS p70, max(energy) AS top, count(*) AS n FROM sections GROUP BY 1) SELECT track_id, idx, CASE WHEN n = 1 THEN 'verse' WHEN idx = 0 AND energy <= p50 THEN 'intro' WHEN idx = n - 1 AND energy <= p50 THEN 'outro' WHEN energy >= CASE WHEN n > 2 THEN p70 ELSE p50 END THEN CASE WHEN energy >= 0.97::DOUBLE * top THEN 'drop' ELSE 'chorus' END WHEN energy < 0.75::DOUBLE * p50 THEN 'bridge' ELSE 'verse' END AS label FROM sections JOIN q USING (track_id)"))
def label_sections(spark, d):
    return analysis.label_sections(views.sections(spark, d))


@query(v(", k AS (SELECT track_id, min(t) AS t FROM beats GROUP BY 1 UNION ALL SELECT k.track_id, (SELECT min(b.t) FROM beats b WHERE b.track_id = k.track_id AND b.t - k.t >= 259200) FROM k WHERE k.t IS NOT NULL) SELECT track_id, t FROM k WHERE t IS NOT NULL").replace("WITH", "WITH RECURSIVE", 1))
def hype_place(spark, d):
    return analysis.fold_min_gap(views.beats(spark, d), "track_id", "t", 259200.0)


@query(v('SELECT track_id, round(list_min([struct_pack(d := abs(x - 20), t := x) FOR x IN list_sort(list("end"))]).t, 6) AS at FROM sections GROUP BY 1'))
def snap_to_bar(spark, d):
    ends = views.sections(spark, d).groupBy("track_id").agg(F.array_sort(F.collect_list("end")).alias("g"))
    return ends.select("track_id", F.round(joins.nearest(F.col("g"), F.lit(20.0)), 6).alias("at"))


@query(v("SELECT track_id, array_to_string(list_transform(list_sort(list_distinct(list_concat([0.0::DOUBLE], list(\"end\")))), lambda x: x::BIGINT::VARCHAR), ',') AS edges FROM sections GROUP BY 1"))
def edge_union(spark, d):
    e = views.sections(spark, d).groupBy("track_id").agg(F.array_sort(F.array_union(F.array(F.lit(0.0)), F.collect_set("end"))).alias("e"))
    return e.select("track_id", F.array_join(F.transform("e", lambda x: x.cast("long").cast("string")), ",").alias("edges"))


CLIPS = "clips AS (SELECT vec_id AS clip_id, (vec_id * 17) % 4096 AS start, pow(10.0, (vec_id % 13 - 6) / 20.0) AS gain FROM embeddings)"


@query(f"{CLIPS} SELECT start + i AS at, round(sum(v * gain), 6) AS v FROM clips JOIN samples USING (clip_id) GROUP BY 1")
def mixdown(spark, d):
    s = views.samples(spark, d)
    clips = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), (F.col("vec_id") * 17 % 4096).alias("start"), music.db_gain((F.col("vec_id") % 13 - 6).cast("double")).alias("gain"))
    return analysis.mixdown(clips, s)


@query('SELECT o_orderkey AS clip_id, (o_orderkey % 600)::DOUBLE AS start, least(o_orderkey % 600 + 1 + o_custkey % 30, 300)::DOUBLE AS "end" FROM orders WHERE o_orderkey % 600 < 300')
def truncate_clips(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("clip_id"), (F.col("o_orderkey") % 600).cast("double").alias("start"), (F.col("o_orderkey") % 600 + 1 + F.col("o_custkey") % 30).cast("double").alias("end"))
    return analysis.truncate(o, 300.0)


@query(v(", b AS (SELECT clip_id, k, avg(v * v) AS p FROM samples, (SELECT unnest(range(13)) AS k) WHERE i >= k * 4 AND i < k * 4 + 16 GROUP BY ALL HAVING count(*) = 16), l AS (SELECT * FROM b WHERE p > 0 AND -0.691 + 10 * log10(p) > -70), m AS (SELECT clip_id, avg(p) AS m FROM l GROUP BY 1), g AS (SELECT clip_id, round(-0.691 + 10 * log10(avg(p)), 6) AS lufs, count(*) AS blocks FROM l JOIN m USING (clip_id) WHERE 10 * log10(p) > 10 * log10(m) - 10 GROUP BY 1) SELECT DISTINCT clip_id, coalesce(lufs, '-inf'::DOUBLE) AS lufs, coalesce(blocks, 0) AS blocks FROM samples LEFT JOIN g USING (clip_id)"))
def loudness_gated(spark, d):
    return analysis.gated_loudness(views.samples(spark, d))


@query(v("SELECT clip_id, i, round(min(CASE WHEN v = 0 THEN 1.0 ELSE least(1.0, 0.1 / abs(v)) END) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 9) AS gain FROM samples"))
def peak_and_limit(spark, d):
    return analysis.required_gain(views.samples(spark, d), 0.1, 5)


@query("SELECT job_id, stage, status, progress, n FROM (SELECT user_id AS job_id, event_type AS stage, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, round(greatest(0, least(1, value / 500)), 6) AS progress, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def job_latest_state(spark, d):
    return jobs.latest_state(jobs.job_events(views.table(spark, d, "events")))


@query(ORACLES["job_latest_state"])
def job_stream(spark, d):
    e = views.table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    return jobs.stream_states(stream)


@query("SELECT o_custkey AS artist, o_orderkey AS item FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def one_per_artist(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return views.table(spark, d, "orders").withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.col("o_custkey").alias("artist"), F.col("o_orderkey").alias("item"))


@query("SELECT o_custkey AS item, o_orderkey AS file FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE n = c // 2 + 1")
def pick_middle(spark, d):
    p = Window.partitionBy("o_custkey")
    o = views.table(spark, d, "orders").withColumn("n", F.row_number().over(p.orderBy("o_orderkey"))).withColumn("c", F.count(F.lit(1)).over(p))
    return o.filter("n = c div 2 + 1").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("file"))


@query("SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def payload_json(spark, d):
    return views.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


ALPHA = 0.8
POLE = f"y AS (SELECT a.clip_id, a.i, sum(b.v * pow({ALPHA}::DOUBLE, a.i - b.i)) * (1 - {ALPHA}::DOUBLE) AS y FROM samples a JOIN samples b ON a.clip_id = b.clip_id AND b.i <= a.i GROUP BY ALL)"


@query(f"{POLE} SELECT clip_id, i, round(y, 9) AS smooth FROM y")
def one_pole(spark, d):
    return levels.one_pole(views.samples(spark, d), "v", ALPHA).select("clip_id", "i", F.round("smooth", 9).alias("smooth"))


@query(v(f""", need AS (SELECT clip_id, i, v, CASE WHEN v = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 0.1::DOUBLE / abs(v)) END AS need FROM samples),
g AS (SELECT *, min(need) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS g FROM need),
s AS (SELECT a.clip_id, a.i, a.v, a.need, sum(b.g * pow({ALPHA}::DOUBLE, a.i - b.i)) * (1 - {ALPHA}::DOUBLE) AS s FROM g a JOIN g b ON a.clip_id = b.clip_id AND b.i <= a.i GROUP BY ALL)
SELECT clip_id, i, round(greatest(-0.1::DOUBLE, least(0.1::DOUBLE, v * least(s, need))), 9) AS v FROM s"""))
def limiter(spark, d):
    return levels.limit(views.samples(spark, d), 0.1, 5, ALPHA).select("clip_id", "i", F.round("v", 9).alias("v"))


@query(v(""", l AS (SELECT clip_id, max(i) + 1 AS n FROM samples GROUP BY 1), k AS (SELECT clip_id, unnest(range((n - 16) // 2 + 1)) AS k FROM l WHERE n >= 32),
p AS (SELECT clip_id, k, avg(v * v) AS p FROM k JOIN samples USING (clip_id) WHERE i >= k * 2 AND i < k * 2 + 16 GROUP BY ALL),
dv AS (SELECT clip_id, k, CASE WHEN p > 0 THEN -0.691::DOUBLE + 10 * log10(p) + 20 ELSE 0 END AS d FROM p),
c AS (SELECT clip_id, k, greatest(-8::DOUBLE, least(3::DOUBLE, CASE WHEN d > 1.5 THEN 1.5 - d WHEN d < -1.5 THEN -1.5 - d ELSE 0 END)) AS c FROM dv),
m AS (SELECT clip_id, max(k) AS m FROM c GROUP BY 1),
t AS (SELECT clip_id, k, o, greatest(0, least(m, k + o)) AS t FROM c JOIN m USING (clip_id), (SELECT unnest([-2, -1, 0, 1, 2]) AS o)),
s AS (SELECT t.clip_id, t.k, avg(c.c) AS s FROM t JOIN c ON c.clip_id = t.clip_id AND c.k = t.t GROUP BY ALL),
x AS (SELECT clip_id, i, v, m, greatest(0::DOUBLE, least(m::DOUBLE, (i - 8) / 2.0::DOUBLE)) AS x FROM samples LEFT JOIN m USING (clip_id))
SELECT x.clip_id, i, round(v * coalesce(pow(10.0::DOUBLE, (lo.s + (x - floor(x)) * (hi.s - lo.s)) / 20), 1), 6) AS v FROM x LEFT JOIN s lo ON lo.clip_id = x.clip_id AND lo.k = floor(x) LEFT JOIN s hi ON hi.clip_id = x.clip_id AND hi.k = least(m, floor(x) + 1)"""))
def level_ride(spark, d):
    return levels.level_ride(views.samples(spark, d), -20.0, 16, 2, 5).select("clip_id", "i", F.round("v", 6).alias("v"))


@query(v(", n AS (SELECT clip_id, max(i) + 1 AS n FROM samples GROUP BY 1) SELECT clip_id, i, round(v * CASE WHEN i < 8 THEN sin(pi() / 2 * i / 7) ELSE 1 END * CASE WHEN n - 1 - i < 16 THEN sin(pi() / 2 * (n - 1 - i) / 15) ELSE 1 END, 9) + 0.0::DOUBLE AS v FROM samples JOIN n USING (clip_id)"))
def apply_fades(spark, d):
    s = views.samples(spark, d)
    n = s.groupBy("clip_id").agg((F.max("i") + 1).alias("n"))
    return s.join(n, "clip_id").select("clip_id", "i", F.round(F.col("v") * levels.fade(F.col("i"), F.col("n"), 8, 16), 9).alias("v"))


@query(v("SELECT a.track_id, a.idx, count(b.idx) AS n FROM (SELECT * FROM sections JOIN chroma USING (vec_id)) a LEFT JOIN (SELECT * FROM sections JOIN chroma USING (vec_id)) b ON a.track_id = b.track_id AND a.idx <> b.idx AND round(greatest(0.0, least(1.0, list_cosine_similarity(a.chroma, b.chroma))), 9) > 0.92 GROUP BY 1, 2"))
def section_recurrence(spark, d):
    return segments.recurrence(views.sections(spark, d), views.chroma(spark, d))


@query(v("SELECT track_id, idx, round(coalesce(1 - list_cosine_similarity(chroma, lag(chroma) OVER (PARTITION BY track_id ORDER BY idx)), 0), 6) AS novelty FROM sections JOIN chroma USING (vec_id)"))
def chroma_novelty(spark, d):
    s = views.sections(spark, d).join(views.chroma(spark, d), "vec_id")
    return segments.novelty(s, "track_id", "idx").select("track_id", "idx", F.round("novelty", 6).alias("novelty"))


@query(v("SELECT track_id, i, round((accent - avg(accent) OVER w) / CASE WHEN stddev_pop(accent) OVER w < 1e-9 THEN 1 ELSE stddev_pop(accent) OVER w END, 6) AS z FROM beats WINDOW w AS (PARTITION BY track_id)"))
def feature_zscore(spark, d):
    return segments.zscored(views.beats(spark, d), ["track_id"], "accent").select("track_id", "i", F.round("z", 6).alias("z"))


@query()
def segment_tracks(spark, d):
    """Sections of each track from its beats, on its downbeats, with their labels."""
    s = views.sections(spark, d).join(views.chroma(spark, d), "vec_id")
    beats = s.select("track_id", F.col("idx").alias("i"), F.col("start").alias("t"), F.col("chroma").alias("features"))
    found = segments.segment(beats, s.groupBy("track_id").agg(F.max("end").alias("duration")), 30.0, beats.filter("i % 4 = 0").select("track_id", "t"))
    spans = found.select("track_id", "idx", "start", "end")
    loud = joins.range_join(s.select("track_id", F.col("start").alias("t"), "energy"), spans, "t", "start", "end", ["track_id"], 60.0).groupBy("track_id", "idx").agg(F.avg("energy").alias("energy"))
    told = found.join(loud, ["track_id", "idx"], "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))
    return analysis.labelled(told)


LABELS = "lq AS (SELECT track_id, quantile_cont(energy, 0.5) AS p50, quantile_cont(energy, 0.7) AS p70, max(energy) AS top, count(*) AS n FROM sections GROUP BY 1), lab AS (SELECT track_id, idx, CASE WHEN n = 1 THEN 'verse' WHEN idx = 0 AND energy <= p50 THEN 'intro' WHEN idx = n - 1 AND energy <= p50 THEN 'outro' WHEN energy >= CASE WHEN n > 2 THEN p70 ELSE p50 END THEN CASE WHEN energy >= 0.97::DOUBLE * top THEN 'drop' ELSE 'chorus' END WHEN energy < 0.75::DOUBLE * p50 THEN 'bridge' ELSE 'verse' END AS label FROM sections JOIN lq USING (track_id))"
PICKED = f"""{NEXT}, {scored_sql('nx')}, {LABELS},
mp0 AS (SELECT sp.*, la.label AS a_label, lb.label AS b_label, round(match + CASE WHEN la.label IN ('chorus', 'drop') THEN 0.12 ELSE 0 END + CASE WHEN lb.label IN ('chorus', 'drop', 'verse') THEN 0.05 ELSE 0 END, 9) AS placed FROM sp JOIN lab la ON la.track_id = a AND la.idx = a_idx JOIN lab lb ON lb.track_id = b AND lb.idx = b_idx WHERE match >= 0.45),
mp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY placed DESC, a_idx, b_idx) AS k FROM mp0) WHERE k = 1)"""


def picked(spark, d):
    t, s, c = music_tables(spark, d)
    return matching.mashup_pick(neighbours(spark, d), t, analysis.labelled(s), c)


@query(v(f", {PICKED} SELECT a, b, a_idx, b_idx, a_label, b_label, round(match, 6) AS total, round(placed, 6) AS placed FROM mp"))
def mashup_pick(spark, d):
    """For all neighbours."""
    return picked(spark, d).select(F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), "a_idx", "b_idx", "a_label", "b_label", F.round("total", 6).alias("total"), F.round("placed", 6).alias("placed"))


@query("SELECT c_custkey AS id, strip_accents('é' || c_name || 'ñ') AS name FROM customer")
def strip_diacritics(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.strip_diacritics(F.concat(F.lit("é"), "c_name", F.lit("ñ"))).alias("name"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS job_id, event_type AS stage, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, greatest(0, least(1, value / 500)) AS progress, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT job_id, k, stage, status, progress, tm, 1::BIGINT AS n FROM e WHERE k = 1
  UNION ALL SELECT e.job_id, e.k, CASE WHEN held THEN r.stage ELSE e.stage END, CASE WHEN held THEN r.status ELSE e.status END, CASE WHEN held THEN r.progress ELSE e.progress END, CASE WHEN held THEN r.tm ELSE e.tm END, CASE WHEN held THEN r.n WHEN r.status = 'running' THEN r.n + 1 ELSE 1 END
  FROM (SELECT e.job_id, e.k, e.stage, e.status, e.progress, e.tm, r.status <> 'running' AND e.tm // 1000 - r.tm // 1000 < 3600000 AS held, r AS r FROM e JOIN r ON r.job_id = e.job_id AND e.k = r.k + 1) e)
SELECT job_id, stage, status, round(progress, 6) AS progress, n FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS z FROM r) WHERE z = 1""")
def job_machine(spark, d):
    e = views.table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    return jobs.stream_machine(stream)


ALIKE = "(SELECT a.track_id, a.idx, count(b.idx) AS alike FROM (SELECT * FROM sections JOIN chroma USING (vec_id)) a LEFT JOIN (SELECT * FROM sections JOIN chroma USING (vec_id)) b ON a.track_id = b.track_id AND a.idx <> b.idx AND round(list_cosine_similarity(a.chroma, b.chroma), 9) > 0.92 GROUP BY ALL)"


@query(v(f", q AS (SELECT track_id, quantile_cont(energy, 0.5) AS p50, quantile_cont(energy, 0.7) AS p70, max(energy) AS top, count(*) AS n FROM sections GROUP BY 1) SELECT track_id, idx, CASE WHEN n = 1 THEN 'verse' WHEN idx = 0 AND energy <= p50 THEN 'intro' WHEN idx = n - 1 AND energy <= p50 THEN 'outro' WHEN energy >= CASE WHEN n > 2 THEN p70 ELSE p50 END THEN CASE WHEN energy >= 0.97::DOUBLE * top AND coalesce(alike, 0) = 0 THEN 'drop' ELSE 'chorus' END WHEN energy < 0.75::DOUBLE * p50 THEN 'bridge' ELSE 'verse' END AS label FROM sections JOIN q USING (track_id) LEFT JOIN {ALIKE} USING (track_id, idx)"))
def label_recurring(spark, d):
    s = views.sections(spark, d)
    return analysis.label_sections(s, segments.recurrence(s, views.chroma(spark, d)))


@query(v(", h AS (SELECT clip_id, i, printf('%04X', (round(greatest(-1, least(1, v)) * 32767)::INT + 65536) % 65536) AS h FROM samples) SELECT clip_id, 1::BIGINT AS part, string_agg(substr(h, 3, 2) || substr(h, 1, 2), '' ORDER BY i) AS digits FROM h GROUP BY 1"))
def wav_data(spark, d):
    return wav.wav_parts(views.samples(spark, d), 44_100).filter("part > 0").select("clip_id", F.col("part").cast("long").alias("part"), F.hex("bytes").alias("digits"))


@query()
def k_weighted_loudness(spark, d):
    return levels.loudness(views.samples(spark, d), 160)


# The other modules register theirs.
from cadenza.plans import library, sets, sound  # noqa: E402, F401
