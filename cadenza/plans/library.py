"""Queries about the library, its providers, caches and samples."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cadenza.functions import music, text
from cadenza.operators import analysis, charts, fuzzy, joins, keyed, library, store
from cadenza.plans.registry import query, v
from cadenza.sources import views

NAMES = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"


@query(f"""WITH s AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_brand || ' - ' || p_name WHEN 1 THEN p_brand || ' – ' || p_name || ' - live' WHEN 2 THEN p_brand || ' — ' || p_name WHEN 3 THEN p_brand || ' | ' || p_name ELSE p_name END AS stem,
  CASE WHEN p_partkey % 7 = 0 THEN 'T' || p_partkey ELSE '' END AS tt, CASE WHEN p_partkey % 11 = 0 THEN 'A' || p_partkey END AS ta FROM part),
g AS (SELECT *, CASE WHEN contains(stem, ' - ') THEN ' - ' WHEN contains(stem, ' – ') THEN ' – ' WHEN contains(stem, ' — ') THEN ' — ' WHEN contains(stem, ' | ') THEN ' | ' END AS sep FROM s)
SELECT id, CASE WHEN tt <> '' THEN tt WHEN sep IS NULL THEN trim(stem) ELSE trim(substr(stem, instr(stem, sep) + 3)) END AS title, CASE WHEN coalesce(ta, '') <> '' THEN ta WHEN sep IS NULL THEN '' ELSE trim(substr(stem, 1, instr(stem, sep) - 1)) END AS artist FROM g""")
def file_tags(spark, d):
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    c = F.concat
    stem = F.when(k % 5 == 0, c(brand, F.lit(" - "), name)).when(k % 5 == 1, c(brand, F.lit(" – "), name, F.lit(" - live"))).when(k % 5 == 2, c(brand, F.lit(" — "), name)).when(k % 5 == 3, c(brand, F.lit(" | "), name)).otherwise(name)
    tags = library.named_by_file(stem, F.when(k % 7 == 0, c(F.lit("T"), k)).otherwise(""), F.when(k % 11 == 0, c(F.lit("A"), k)))
    return views.table(spark, d, "part").select(k.alias("id"), tags.alias("t")).select("id", "t.title", "t.artist")


def analyses(spark, d):
    """Analyses of most tracks, some of an older version."""
    t = views.tracks(spark, d).filter("track_id % 3 <> 0")
    return t.select(F.concat(F.lit("h"), "track_id").alias("file_hash"), F.when(F.col("track_id") % 5 == 0, 3).otherwise(4).alias("version"), F.col("bpm"), "pitch_class", F.when(F.col("minor"), "minor").otherwise("major").alias("mode"), music.camelot(F.col("pitch_class"), F.col("minor")).alias("camelot"))


WHEEL = "((CASE WHEN minor THEN (pitch_class + 3) % 12 ELSE pitch_class % 12 END * 7) % 12 + 7) % 12 + 1"


@query(v(f"SELECT track_id, track_id % 3 <> 0 AND track_id % 5 <> 0 AS analyzed, CASE WHEN track_id % 3 <> 0 AND track_id % 5 <> 0 THEN round(bpm, 2) ELSE 0 END AS bpm, CASE WHEN track_id % 3 <> 0 AND track_id % 5 <> 0 THEN {NAMES}[pitch_class + 1] || ' ' || CASE WHEN minor THEN 'minor' ELSE 'major' END END AS key, CASE WHEN track_id % 3 <> 0 AND track_id % 5 <> 0 THEN ({WHEEL})::VARCHAR || CASE WHEN minor THEN 'A' ELSE 'B' END END AS camelot FROM tracks"))
def library_listing(spark, d):
    t = views.tracks(spark, d).select("track_id", F.concat(F.lit("h"), "track_id").alias("file_hash"))
    return library.listing(t, analyses(spark, d), 4).select("track_id", "analyzed", F.coalesce("bpm", F.lit(0.0)).alias("bpm"), "key", "camelot")


@query(v("SELECT track_id, count(*) AS beats, count(*) FILTER (i % 4 = 0) AS downbeat_count, array_to_string((list(round(t, 2) ORDER BY i) FILTER (i % 4 = 0))[1:64].list_transform(lambda x: printf('%.2f', x)), ',') AS downbeats FROM beats GROUP BY 1"))
def analysis_view(spark, d):
    """What a track's page shows: counts, and the first 64 downbeats."""
    b = views.beats(spark, d).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("b"))
    down = F.filter("b", lambda x: x["i"] % 4 == 0)
    return b.select("track_id", F.size("b").cast("long").alias("beats"), F.size(down).cast("long").alias("downbeat_count"), F.array_join(F.transform(F.slice(down, 1, 64), lambda x: F.format_string("%.2f", F.round(x["t"], 2))), ",").alias("downbeats"))


@query("SELECT o_orderkey AS id, ((o_custkey % 40 - 20) % 12 + 12) % 12 AS pitch_class, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][((o_custkey % 40 - 20) % 12 + 12) % 12 + 1] || ' minor' AS name, 1.0::DOUBLE AS confidence, 'manual' AS source FROM orders")
def manual_keys(spark, d):
    k = library.manual_key(F.col("o_custkey") % 40 - 20, F.lit("minor"))
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), k.alias("k")).select("id", F.col("k.pitch_class").cast("long").alias("pitch_class"), library.key_name(F.col("k.pitch_class"), F.col("k.mode")).alias("name"), "k.confidence", "k.source")


ATTEMPTS = [("a", "IL", True, None), ("a", "global", True, None), ("b", "IL", True, "timeout"), ("b", "global", True, None), ("c", "IL", True, None), ("c", "global", True, None), ("d", "IL", False, None), ("e", "global", True, None)]


@query(v(""", att AS (SELECT * FROM (VALUES ('a', 'IL', true, NULL), ('a', 'global', true, NULL), ('b', 'IL', true, 'timeout'), ('b', 'global', true, NULL), ('c', 'IL', true, NULL), ('c', 'global', true, NULL), ('d', 'IL', false, NULL), ('e', 'global', true, NULL)) t(provider, region, available, failure)),
n AS (SELECT provider, region, count(*) AS n FROM charts GROUP BY ALL),
r AS (SELECT att.*, CASE WHEN available AND failure IS NULL THEN coalesce(n, 0) ELSE 0 END AS n FROM att LEFT JOIN n USING (provider, region))
SELECT provider, region, n, CASE WHEN NOT available THEN 'no API key configured' WHEN failure IS NOT NULL THEN failure WHEN n = 0 THEN 'provider returned an empty chart' END AS error FROM r"""))
def provider_errors(spark, d):
    return library.provider_report(spark.createDataFrame(ATTEMPTS, "provider string, region string, available boolean, failure string"), views.charts(spark, d))


CACHE = "cache AS (SELECT provider, region, rank, song, 1700000000 - (ascii(provider) % 7 * 5 + length(region)) * 3600 AS fetched_at FROM charts)"


def chart_cache(spark, d):
    age = (F.ascii("provider") % 7 * 5 + F.length("region")) * 3600
    return views.charts(spark, d).select("provider", "region", "rank", "song", (F.lit(1_700_000_000) - age).cast("double").alias("fetched_at"))


def asked(spark):
    return spark.createDataFrame([(p, r) for p in "abcd" for r in ("IL", "global")], "provider string, region string")


@query(v(f", {CACHE} SELECT provider, region, rank, song FROM cache WHERE 1700000000 - fetched_at <= 6 * 3600 AND rank <= 20"))
def charts_from_cache(spark, d):
    return library.cached_charts(asked(spark), chart_cache(spark, d), 1_700_000_000.0, 6.0, 20)[0].select("provider", "region", "rank", "song")


@query(v(f", {CACHE}, a AS (SELECT * FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS provider), (SELECT unnest(['IL', 'global']) AS region)) SELECT provider, region FROM a WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.provider = a.provider AND c.region = a.region AND 1700000000 - fetched_at <= 6 * 3600)"))
def charts_to_fetch(spark, d):
    return library.cached_charts(asked(spark), chart_cache(spark, d), 1_700_000_000.0, 6.0, 20)[1]


@query("""WITH f AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, CASE WHEN l_linestatus = 'O' THEN 'http://creativecommons.org/by' ELSE 'all rights reserved' END AS licence, l_returnflag AS format, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_quantity * 12 END AS seconds FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY place) AS n, count(*) OVER (PARTITION BY item) AS c FROM f WHERE licence LIKE '%creativecommons%' AND format IN ('A', 'N') AND (seconds = 0 OR seconds BETWEEN 90 AND 480))
SELECT item, place FROM g WHERE n = c // 2 + 1""")
def pick_file(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    length = F.when(F.col("l_linenumber") == 3, "").otherwise((F.col("l_quantity") * 12).cast("string"))
    files = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.row_number().over(w).alias("place"), F.when(F.col("l_linestatus") == "O", "http://creativecommons.org/by").otherwise("all rights reserved").alias("licence"), F.col("l_returnflag").alias("format"), length.alias("length"))
    return library.picked_files(files, ("A", "N")).select("item", F.col("place").cast("long").alias("place"))


@query("WITH f AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) || ' ' ELSE lower(p_brand) END AS artist, p_partkey AS place FROM part) SELECT artist, place FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(artist)) ORDER BY place) AS n FROM f) WHERE n = 1 ORDER BY place LIMIT 15")
def fetch_loop(spark, d):
    artist = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_brand"), F.lit(" "))).otherwise(F.lower("p_brand"))
    return library.one_an_artist(views.table(spark, d, "part").select(artist.alias("artist"), F.col("p_partkey").alias("place")), 15)


@query("SELECT o_custkey AS file_hash, arg_min(o_orderkey, o_orderkey) AS track_id, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS payload, max(o_orderdate)::DATE::VARCHAR AS created FROM (SELECT *, min(struct_pack(a := o_orderdate, b := o_orderkey)) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE true GROUP BY 1".replace("arg_min(o_orderkey, o_orderkey)", "arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey))"))
def upsert_analyses(spark, d):
    """A second write of an analysis changes its payload and time, never its track."""
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("file_hash"), F.col("o_orderkey").alias("track_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("payload"), F.col("o_orderdate").cast("date").cast("string").alias("created"), F.col("o_orderdate").alias("at"))
    return library.upsert_keeping(o, ["file_hash"], ["at", "seq"], ["track_id"], ["payload", "created"])


@query("SELECT o_custkey AS file_hash, arg_max(o_orderkey % 12, struct_pack(a := o_orderdate, b := o_orderkey)) AS pitch_class, min(o_orderdate)::DATE::VARCHAR AS created FROM orders GROUP BY 1")
def upsert_override(spark, d):
    """A second override changes the key and keeps the first time."""
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("file_hash"), (F.col("o_orderkey") % 12).alias("pitch_class"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("date").cast("string").alias("created"), F.col("o_orderdate").alias("at"))
    return library.upsert_keeping(o, ["file_hash"], ["at", "seq"], ["created"], ["pitch_class"])


@query("""WITH last AS (SELECT o_custkey AS id, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS seq, max(o_orderdate)::DATE::VARCHAR AS day FROM orders GROUP BY 1)
SELECT id, seq, day FROM last WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def keyed_writes(spark, d):
    """Orders written by their status, one write after another, into a keyed table; customers in debt are deleted last."""
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderdate").cast("string").alias("at"), F.col("o_orderstatus").alias("_status"))
    path = store.shared_path(spark)
    rows = o.drop("_status")
    for part in (F.col("_status") == "F", F.col("_status") == "O", ~F.col("_status").isin("F", "O")):
        keyed.merge(path, o.filter(F.coalesce(part, F.lit(False))).drop("_status"), ["id"], ["at", "seq"], buckets=16)
    debt = views.table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("day"), F.lit("9999").alias("at"))
    keyed.merge(path, debt, ["id"], ["at", "seq"], gone=True)
    return keyed.state(spark, path, rows.schema).select("id", "seq", "day")


@query("SELECT o_orderkey AS mix_id, row_number() OVER (ORDER BY o_orderdate::DATE DESC, o_orderkey) AS place FROM orders")
def mix_history(spark, d):
    """Newest first."""
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("mix_id"), F.col("o_orderdate").cast("date").alias("day"))
    return library.placed(o, [F.desc("day"), F.col("mix_id")]).select("mix_id", "place")


@query(v("SELECT track_id, row_number() OVER (ORDER BY artist, title, track_id) AS place FROM tracks"), name="list_tracks")
def list_tracks(spark, d):
    return library.placed(views.tracks(spark, d), [F.col("artist"), F.col("title"), F.col("track_id")]).select("track_id", "place")


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events")
def jobs_newest_first(spark, d):
    """All jobs' events, whoever's they are."""
    return library.placed(views.table(spark, d, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "place")


KIND_SQL = "CASE WHEN s LIKE '%riser%' THEN 'riser' WHEN s LIKE '%impact%' THEN 'impact' WHEN s LIKE '%airhorn%' THEN 'airhorn' WHEN s LIKE '%shout%' THEN 'shout' WHEN s LIKE '%sweep%' THEN 'sweep' WHEN s LIKE '%build%' OR s LIKE '%up%' THEN 'riser' WHEN s LIKE '%hit%' OR s LIKE '%boom%' THEN 'impact' WHEN s LIKE '%downlifter%' THEN 'sweep' WHEN s LIKE '%horn%' THEN 'airhorn' WHEN s LIKE '%vox%' OR s LIKE '%voice%' THEN 'shout' END"


@query(f"WITH f AS (SELECT {KIND_SQL} AS kind FROM (SELECT lower(p_name) AS s FROM part)), k AS (SELECT unnest(['riser', 'impact', 'airhorn', 'shout', 'sweep']) AS kind) SELECT kind, greatest(1, count(f.kind)) AS n, count(f.kind) = 0 AS generated FROM k LEFT JOIN f USING (kind) GROUP BY 1")
def sample_library(spark, d):
    """Samples by kind; a kind without any has its default."""
    held = library.sample_library(views.table(spark, d, "part").select(F.col("p_name").alias("name")))
    return held.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.bool_or("generated").alias("generated"))


@query(v("SELECT track_id FROM (SELECT track_id, row_number() OVER (ORDER BY (('0x' || substr(md5('9:' || track_id), 1, 8))::BIGINT::DOUBLE + 1) / 4294967296.0, track_id) AS n FROM tracks) WHERE n <= 24"))
def library_sample(spark, d):
    """Candidates of a half-hour set."""
    n = spark.range(1).select(library.set_size(F.lit(30), F.lit(None).cast("int")).alias("n")).first()["n"]
    return library.library_sample(views.tracks(spark, d).select("track_id"), n, 9)


@query("SELECT minutes, wanted, coalesce(wanted, CASE WHEN minutes <= 20 THEN 8 WHEN minutes <= 40 THEN 12 ELSE 16 END) AS n FROM (SELECT o_orderkey % 60 AS minutes, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 20 + 2 END AS wanted FROM orders) WHERE wanted IS NOT NULL OR true".replace("SELECT minutes, wanted,", "SELECT minutes, coalesce(wanted, 0) AS wanted,"))
def set_sizes(spark, d):
    o = views.table(spark, d, "orders").select((F.col("o_orderkey") % 60).alias("minutes"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 20 + 2).alias("wanted"))
    return o.select("minutes", F.coalesce("wanted", F.lit(0)).alias("wanted"), library.set_size(F.col("minutes"), F.col("wanted")).alias("n"))


@query("SELECT c_custkey AS id, 'https://host.example/d/' || c_custkey || '/' || replace(url_encode(c_name || ' ü/' || c_mktsegment), '%2F', '/') AS url FROM customer")
def download_urls(spark, d):
    c = views.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), library.download_url("https://host.example/d", F.col("c_custkey").cast("string"), F.concat("c_name", F.lit(" ü/"), "c_mktsegment")).alias("url"))


@query("SELECT c_custkey AS id, c_name || chr(10) || '    artist : ' || c_mktsegment || chr(10) || '    licence: by' || chr(10) || '    source : s' || c_custkey || chr(10) AS manifest FROM customer")
def licence_manifest(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("file"), F.col("c_mktsegment").alias("artist"), F.lit("by").alias("licence"), F.concat(F.lit("s"), "c_custkey").alias("source"))
    lines = library.licence_lines(c)
    return c.select("id", "file").join(lines, "file").select("id", F.array_join("lines", "\n").alias("manifest"))


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN '0.30' ELSE '0.45' END AS sidechain, CASE WHEN s_nationkey % 3 = 0 THEN '2' WHEN s_nationkey % 2 = 0 THEN '8' ELSE '4' END AS build FROM supplier")
def fx_overrides(spark, d):
    """A style's settings with the given ones in place; null ones leave the style's."""
    m = lambda **x: F.create_map(*[F.lit(y) for kv in x.items() for y in kv])
    style = F.when(F.col("s_nationkey") % 2 == 0, m(sidechain="0.30", build="8")).otherwise(m(sidechain="0.45", build="4"))
    given = F.create_map(F.lit("build"), F.when(F.col("s_nationkey") % 3 == 0, "2"), F.lit("sidechain"), F.lit(None).cast("string"))
    return views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), library.merged_map(style, given).alias("m")).select("id", F.col("m")["sidechain"].alias("sidechain"), F.col("m")["build"].alias("build"))


@query("SELECT o_orderkey AS id, '{\"id\":' || o_orderkey || ',\"terms\":{\"total\":' || (o_custkey % 7) || ',\"tags\":[\"' || o_orderstatus || '\",\"x\"]}}' AS payload, o_custkey % 7 AS total FROM orders")
def payload_round_trip(spark, d):
    """A nested record written as JSON and read back."""
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct((F.col("o_custkey") % 7).alias("total"), F.array("o_orderstatus", F.lit("x")).alias("tags")).alias("terms"))).alias("payload"))
    return o.select("id", "payload", F.from_json("payload", "id long, terms struct<total: long, tags: array<string>>")["terms"]["total"].alias("total"))


@query(v(", m AS (SELECT DISTINCT title AS label FROM tracks), r AS (SELECT title AS label, max(track_id) AS track_id FROM tracks GROUP BY 1) SELECT label, track_id FROM m JOIN r USING (label)"))
def resolved_by_label(spark, d):
    """Sampled songs and the file each stands for; a later file of the same label wins."""
    t = views.tracks(spark, d).select(F.col("title").alias("label"), "track_id")
    return t.select("label").distinct().join(library.upsert_keeping(t, ["label"], ["track_id"], [], ["track_id"]), "label")


@query("SELECT event_type AS stage, count(*) AS total, count(*) FILTER (event_type <> 'error') AS analysed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def outcome_counts(spark, d):
    e = views.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("analysed"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query(v("SELECT track_id, i, t FROM beats WHERE i % 8 = 0"))
def decimated_curve(spark, d):
    from cadenza.operators import fuzzy, sound

    return sound.decimated(views.beats(spark, d), 8).select("track_id", "i", "t")


@query(v(", s AS (SELECT track_id, min(t) AS t0, max(t) AS t1, list(t ORDER BY i) AS ts, list(accent ORDER BY i) AS acc FROM beats GROUP BY 1), w AS (SELECT *, unnest(range(4)) AS k FROM s), x AS (SELECT track_id, k, t0 + k * 700000 AS lo, t0 + k * 700000 + 40000 AS hi, ts, acc FROM w), m AS (SELECT track_id, k, lo, hi, list_filter(list_zip(ts, acc), lambda p: p[1] >= lo AND p[1] < hi) AS inside, ts, acc FROM x) SELECT track_id, k, len(inside) AS n, round(CASE WHEN len(inside) > 0 THEN list_avg(list_transform(inside, lambda p: p[2])) ELSE acc[least(greatest(len(list_filter(ts, lambda z: z < lo)), 0), len(ts) - 1) + 1] END, 6) AS energy FROM m"), name="energy_between")
def energy_between(spark, d):
    """Mean energy of a span; an empty span has the curve's value where it begins, at most the last one."""
    b = views.beats(spark, d)
    spans = b.groupBy("track_id").agg(F.min("t").alias("t0"), F.array_sort(F.collect_list(F.struct("i", "t", "accent"))).alias("curve")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    spans = spans.select("track_id", "k", (F.col("t0") + F.col("k") * 700_000).alias("lo"), (F.col("t0") + F.col("k") * 700_000 + 40_000).alias("hi"), "curve")
    hits = joins.range_join(b, spans.drop("curve"), "t", "lo", "hi", ["track_id"], 700_000.0).groupBy("track_id", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("accent").alias("mean"))
    there = F.get("curve", F.least(F.size(F.filter("curve", lambda x: x["t"] < F.col("lo"))), F.size("curve") - 1))["accent"]
    return spans.join(hits, ["track_id", "k"], "left").select("track_id", "k", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", there), 6).alias("energy"))


@query(v(", dv AS (SELECT track_id, i, t - lag(t) OVER (PARTITION BY track_id ORDER BY i) AS g FROM steady), st AS (SELECT track_id, count(*) + 0 AS n, median(g) AS m, stddev_pop(g) AS sd FROM dv GROUP BY 1), ok AS (SELECT track_id, n, m, n >= 8 AND m > 0 AND sd <= 0.12 * m AS fits FROM st), f AS (SELECT track_id, regr_slope(t, i) AS p, regr_intercept(t, i) AS o FROM steady JOIN ok USING (track_id) WHERE fits GROUP BY 1), g AS (SELECT s.track_id, regr_slope(t, i) AS p2, count(*) AS c FROM steady s JOIN f USING (track_id) WHERE abs(t - (o + p * i)) < 0.5 * p GROUP BY 1 HAVING count(*) > 8) SELECT track_id, fits, CASE WHEN n < 8 OR m <= 0 THEN 0.0 WHEN NOT fits THEN round(m, 6) ELSE round(coalesce(p2, p), 6) END AS period FROM ok LEFT JOIN f USING (track_id) LEFT JOIN g USING (track_id)".replace(", dv AS", ", steady AS (SELECT track_id, i, i * 0.5::DOUBLE + CASE WHEN track_id % 4 = 0 THEN accent / 400 ELSE accent / 20000 END + CASE WHEN i = 20 AND track_id % 4 = 1 THEN 0.03 ELSE 0 END AS t FROM beats), dv AS")), name="beat_grid_fit")
def beat_grid_fit(spark, d):
    """Beats about half a second apart; some tracks are too uneven for a line."""
    k, i = F.col("track_id"), F.col("i")
    t = i * 0.5 + F.when(k % 4 == 0, F.col("accent") / 400).otherwise(F.col("accent") / 20000) + F.when((i == 20) & (k % 4 == 1), 0.03).otherwise(0.0)
    return analysis.beat_grid(views.beats(spark, d).withColumn("t", t))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN (o_orderkey % 60)::DOUBLE WHEN o_custkey % 3 = 1 THEN 0.0 ELSE (o_orderkey % 4) * 3600.0 + (o_custkey % 60) * 60 + o_orderkey % 60 END AS seconds FROM orders", name="parse_duration")
def parse_duration(spark, d):
    """Seconds alone, junk, and times with colons."""
    o = views.table(spark, d, "orders")
    timed = F.concat_ws(":", F.col("o_orderkey") % 4, F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    x = F.when(F.col("o_custkey") % 3 == 0, (F.col("o_orderkey") % 60).cast("string")).when(F.col("o_custkey") % 3 == 1, "about a minute").otherwise(timed)
    return o.select(F.col("o_orderkey").alias("id"), text.seconds(x).alias("seconds"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'ｆｕｌｌwidth ' || p_name ELSE 'ﬁne ' || p_name END AS raw, trim(regexp_replace(replace(replace(CASE WHEN p_partkey % 3 = 0 THEN 'ｆｕｌｌwidth ' || p_name ELSE 'ﬁne ' || p_name END, 'ｆｕｌｌ', 'full'), 'ﬁ', 'fi'), '\\s+', ' ', 'g')) AS name FROM part".replace(", CASE WHEN p_partkey % 3 = 0 THEN 'ｆｕｌｌwidth ' || p_name ELSE 'ﬁne ' || p_name END AS raw", ""))
def compatible_text(spark, d):
    """Full-width letters and ligatures become plain ones before anything is compared."""
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ｆｕｌｌwidth "), "p_name")).otherwise(F.concat(F.lit("ﬁne "), "p_name"))
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.normalize(raw).alias("name"))


def noisy(spark, d):
    """Charted songs as a careless hand would write them: an accent more, a letter less, or a word more."""
    m = charts.merge_trends(views.charts(spark, d))
    k = F.col("key")
    return m.select(F.when(F.col("rank") % 4 == 0, F.concat(k, F.lit(" x"))).when(F.col("rank") % 4 == 1, F.replace(k, F.lit("e"), F.lit("é"))).when(F.col("rank") % 4 == 2, F.substring(k, F.lit(2), F.length(k))).otherwise(F.reverse(k)).alias("key"), "rank")


@query(name="resolve_fuzzy")
def resolve_fuzzy(spark, d):
    return fuzzy.resolve_fuzzy(noisy(spark, d), views.tracks(spark, d))


@query()
def near_misses(spark, d):
    """What the library has that comes nearest to each song it lacks."""
    return fuzzy.near_misses(noisy(spark, d), views.tracks(spark, d))


@query("""WITH p AS (SELECT p_brand AS kind, p_name || p_partkey AS name FROM part), q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM p),
a AS (SELECT s_suppkey AS id, 'Brand#' || (s_nationkey % 25 + 1) AS kind FROM supplier), z AS (SELECT DISTINCT kind, n FROM q)
SELECT a.id, a.kind, q.name FROM a JOIN z USING (kind) JOIN q ON q.kind = a.kind AND q.k = least(floor(((('0x' || substr(md5('3:' || a.id), 1, 8))::BIGINT::DOUBLE + 1) / 4294967296.0) * z.n), z.n - 1)""")
def sample_picks(spark, d):
    """One of the samples of a kind for each that asks, by a hash."""
    pool = views.table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    who = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 25 + 1).cast("string")).alias("kind"))
    return library.hashed_pick(who, pool, "kind", "id", 3)
