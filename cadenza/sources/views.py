"""The music domain as views over the driver tables, and the readers for real files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

AUDIO = ("mp3", "wav", "flac", "m4a", "aac", "ogg", "opus", "wma", "aiff")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def scan_audio(spark: SparkSession, path: str) -> DataFrame:
    """Audio files below ``path`` in the order of their paths: id, path, fingerprint of size and both ends, length; none where there is no such folder.

    Files that go or cannot be read while they are scanned are skipped.
    """
    if not there(spark, path):
        return spark.createDataFrame([], "id string, path string, file_hash string, length long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(path)
    wanted = files.filter(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*AUDIO))
    mib = 1 << 20
    ends = F.concat(F.encode(F.col("length").cast("string"), "utf-8"), F.substring("content", 1, mib), F.when(F.col("length") > 2 * mib, F.substring("content", -mib, mib)).otherwise(F.lit(b"")))
    # A local file is known by its plain path, as other programs would name it.
    plain = F.regexp_replace("path", "^file:/+", "/")
    return wanted.select(F.substring(F.sha2(plain, 256), 1, 16).alias("id"), plain.alias("path"), F.substring(F.sha2(ends, 256), 1, 32).alias("file_hash"), "length").orderBy("path")


def as_list(payload: Column, path: str, kind: str) -> Column:
    """The list at a JSON path; a single object counts as a list of one, as some providers send it."""
    raw = F.get_json_object(payload, path)
    listed = F.when(F.substring(F.ltrim(raw), 1, 1) == "[", raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    return F.from_json(listed, kind)


def chart_rows(raw: DataFrame, provider: str, payload: str = "payload", region: str = "region", limit: int = 50) -> DataFrame:
    """Rows of a provider's JSON; ranks count entries before blank ones go. An ``error`` in it is an error when rows are read."""
    x = F.col(payload)
    if provider == "a":
        message = F.concat(F.lit("chart error: "), F.coalesce(F.get_json_object(x, "$.message"), F.get_json_object(x, "$.error")))
        x = F.when(F.get_json_object(x, "$.error").isNotNull(), F.raise_error(message).cast("string")).otherwise(x)
        j = as_list(x, "$.tracks.track", "array<struct<name: string, artist: struct<name: string>, url: string>>")
        entry = lambda e: F.struct(e["name"].alias("title"), e["artist"]["name"].alias("artist"), e["url"].alias("url"))
    elif provider == "b":
        # A page of this provider holds 10 to 100 entries.
        j = F.slice(as_list(x, "$.feed.results", "array<struct<name: string, artistName: string, url: string>>"), 1, max(10, min(100, limit)))
        entry = lambda e: F.struct(e["name"].alias("title"), e["artistName"].alias("artist"), e["url"].alias("url"))
    else:
        from cadenza.functions.text import split_title

        j = as_list(x, "$.items", "array<struct<snippet: struct<title: string, channelTitle: string>>>")
        entry = lambda e: F.struct(split_title(e["snippet"]["title"], e["snippet"]["channelTitle"])["title"].alias("title"), split_title(e["snippet"]["title"], e["snippet"]["channelTitle"])["artist"].alias("artist"), F.lit("").alias("url"))
    rows = raw.select(F.col(region).alias("region"), F.posexplode(F.transform(j, entry)).alias("pos", "e"))
    named = rows.select("e.title", "e.artist", "e.url", (F.col("pos") + 1).alias("rank"), "region", F.lit(provider).alias("provider")).filter(F.trim("title") != "")
    return named if provider == "c" else named.filter(F.trim("artist") != "")


def tracks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("track_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"),
        (70 + (k * 37 % 1200) / 10.0).alias("bpm"), (k % 12).cast("int").alias("pitch_class"), (F.expr("p_partkey div 12") % 2 != 0).alias("minor"), (k * 7919 % 1000 / 1000.0 * 0.227).alias("confidence"),
    )


def sections(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    # Named before the window: only then do later steps see that a track's rows lie together.
    named = table(spark, d, "lineitem").select(c("l_partkey").alias("track_id"), c("l_orderkey").alias("_o"), "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", (F.abs("l_discount") * 10).alias("energy"))
    w = Window.partitionBy("track_id").orderBy("_o", "l_linenumber", "l_suppkey", "l_extendedprice")
    n = F.broadcast(table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n")))  # one row
    placed = named.withColumns({"idx": F.row_number().over(w) - 1, "end": F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.join(n, F.lit(True)).select("track_id", "idx", (c("end") - c("l_quantity")).alias("start"), "end", "energy", (c("_o") % c("n")).alias("vec_id"))


def chroma(spark: SparkSession, d: str) -> DataFrame:
    raw = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double")))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").filter(total > 0).select("vec_id", F.transform(raw, lambda x: x / total).alias("chroma"))


def charts(spark: SparkSession, d: str) -> DataFrame:
    provider = F.create_map(*[F.lit(x) for x in ("A", "a", "N", "b", "R", "c")])[F.col("l_returnflag")]
    region = F.when(F.col("l_linestatus") == "O", "IL").otherwise("global")
    sums = table(spark, d, "lineitem").groupBy(provider.alias("provider"), region.alias("region"), F.col("l_partkey").alias("song")).agg(F.round(F.sum("l_extendedprice")).cast("long").alias("plays"))
    rank = F.row_number().over(Window.partitionBy("provider", "region").orderBy(F.desc("plays"), "song"))
    top = sums.withColumn("rank", rank).filter(F.col("rank") <= 50)
    return top.join(tracks(spark, d).select(F.col("track_id").alias("song"), "title", "artist"), "song")


def beats(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("track_id"), (F.row_number().over(w) - 1).alias("i"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("accent"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


#: The same views for the oracle.
SQL = """
tracks AS (SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist, p_type AS album, 70 + (p_partkey * 37 % 1200) / 10.0::DOUBLE AS bpm, (p_partkey % 12)::INT AS pitch_class,
  (p_partkey // 12) % 2 <> 0 AS minor, (p_partkey * 7919 % 1000) / 1000.0::DOUBLE * 0.227::DOUBLE AS confidence FROM part),
sections AS (SELECT l_partkey AS track_id, row_number() OVER w - 1 AS idx, sum(l_quantity) OVER w - l_quantity AS start, sum(l_quantity) OVER w AS "end", abs(l_discount) * 10 AS energy, l_orderkey % (SELECT count(*) FROM embeddings) AS vec_id
  FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
chroma AS (SELECT vec_id, list_transform(r, lambda x: x / list_sum(r)) AS chroma FROM (SELECT vec_id, list_transform(embedding[1:12], lambda x: abs(x::DOUBLE)) AS r FROM embeddings) WHERE list_sum(r) > 0),
plays AS (SELECT CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'b' WHEN 'R' THEN 'c' END AS provider, CASE WHEN l_linestatus = 'O' THEN 'IL' ELSE 'global' END AS region, l_partkey AS song, round(sum(l_extendedprice))::BIGINT AS plays FROM lineitem GROUP BY ALL),
charts AS (SELECT c.*, title, artist FROM (SELECT *, row_number() OVER (PARTITION BY provider, region ORDER BY plays DESC, song) AS rank FROM plays) c JOIN tracks ON track_id = song WHERE rank <= 50),
beats AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1e6 AS t, value AS accent FROM events),
samples AS (SELECT vec_id AS clip_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
"""
