"""The library and its surroundings: listings, tags, providers' states, caches, samples, limits of options."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cadenza.functions import text
from cadenza.operators.store import kept

# Names of the pitch classes.
PITCH_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
# What separates artist and title in file names, in the order they are tried.
SEPARATORS = (" - ", " – ", " — ", " | ")
# States of a store's front by region.
STOREFRONTS = {"IL": "il", "global": "us"}
# Bounds of a mix's options.
BOUNDS = {"length_minutes": (1, 180), "israel_ratio": (0, 1), "track_count": (2, 40)}


def key_name(pc: Column, mode: Column) -> Column:
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, PITCH_NAMES)), F.pmod(pc, F.lit(12)).cast("int") + 1), mode)


def manual_key(pc: Column, mode: Column) -> Column:
    """A key set by hand: any whole number folds to a pitch class, and nothing is surer."""
    return F.struct(F.pmod(pc, F.lit(12)).cast("int").alias("pitch_class"), mode.alias("mode"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"))


def named_by_file(stem: Column, title: Column, artist: Column) -> Column:
    """struct(title, artist): tags where there are any, else what the file's name says; the first separator in order splits it once."""
    guess = F.struct(stem.alias("title"), F.lit("").alias("artist"))
    for sep in reversed(SEPARATORS):
        at = F.instr(stem, sep)
        guess = F.when(at > 0, F.struct(F.substring(stem, at + len(sep), F.length(stem)).alias("title"), F.substring(stem, F.lit(1), at - 1).alias("artist"))).otherwise(guess)
    tag = lambda x: F.when(F.coalesce(x, F.lit("")) != "", x)
    return F.struct(F.coalesce(tag(title), F.trim(guess["title"])).alias("title"), F.coalesce(tag(artist), F.trim(guess["artist"])).alias("artist"))


def listing(tracks: DataFrame, analyses: DataFrame, version: int) -> DataFrame:
    """Each track with what its analysis of the current version says; null where there is none."""
    now = analyses.filter(F.col("version") == version).select("file_hash", F.lit(True).alias("_there"), F.round("bpm", 2).alias("bpm"), key_name(F.col("pitch_class"), F.col("mode")).alias("key"), "camelot")
    return tracks.join(now, "file_hash", "left").withColumn("analyzed", F.coalesce("_there", F.lit(False))).drop("_there")


def placed(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``out``: the place from 1 in ``order``, without one task for all rows.

    Rows go to ranges between sampled bounds, are sorted there and numbered; a
    range begins after the rows of those before it. The ranges are written
    once, so counts and places are of the same ones. ``order`` should end in a
    key of the rows: then any number of rows may share its first columns, while
    rows that are equal in all of it lie in one range.
    """
    row = (1 << 33) - 1
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    spread = ranged.withColumn("_range", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a range.
    offsets = spread.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", before.alias("_before"))
    return spread.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit(row)) + 1).drop("_at", "_range", "_before")


def provider_report(attempts: DataFrame, charts: DataFrame) -> DataFrame:
    """``provider, region, n, error``: what each attempt gave, and why where it gave nothing; nothing raises.

    ``attempts``: ``provider, region, available, failure``.
    """
    n = charts.groupBy("provider", "region").agg(F.count(F.lit(1)).alias("n"))
    told = attempts.join(n, ["provider", "region"], "left").withColumn("n", F.when(F.col("available") & F.col("failure").isNull(), F.coalesce("n", F.lit(0))).otherwise(0))
    error = F.when(~F.col("available"), "no API key configured").when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("n") == 0, "provider returned an empty chart")
    return told.select("provider", "region", "n", error.alias("error"))


def known_providers(wanted: list[str], builders: dict) -> list:
    """The builders of the wanted names, in order; unknown names are skipped."""
    return [builders[name] for name in wanted if name in builders]


def cached_charts(asked: DataFrame, cache: DataFrame, now: float, hours: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows of fresh caches, what must be fetched), by provider and region.

    ``cache``: ``provider, region, fetched_at, rank`` and more; the limit is no
    part of the key, so it holds on reading. Empty charts are never cached.
    """
    fresh = cache.filter(F.lit(now) - F.col("fetched_at") <= hours * 3600)
    rows = fresh.join(asked, ["provider", "region"], "left_semi").filter(F.col("rank") <= limit)
    return rows, asked.join(fresh.select("provider", "region").distinct(), ["provider", "region"], "left_anti")


def picked_files(files: DataFrame, formats: tuple[str, ...], least: float = 90.0, most: float = 480.0) -> DataFrame:
    """One file an item: free licence, wanted format, a length within bounds if it is known; the middle one of these."""
    seconds = text.seconds(F.col("length"))
    good = files.filter(F.col("licence").contains("creativecommons") & F.col("format").isin(*formats) & ((seconds == 0) | seconds.between(least, most)))
    item = Window.partitionBy("item")
    ranked = good.withColumn("_n", F.row_number().over(item.orderBy("place"))).withColumn("_c", F.count(F.lit(1)).over(item))
    return ranked.filter("_n = _c div 2 + 1").drop("_n", "_c")


def one_an_artist(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` in the order of ``place``, one for each artist; case and edge spaces do not tell artists apart."""
    w = Window.partitionBy(F.lower(F.trim("artist"))).orderBy("place")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy("place").limit(count)


def upsert_keeping(rows: DataFrame, key: list[str], at: list[str], first: list[str], last: list[str]) -> DataFrame:
    """The state after all writes: columns ``first`` as first written, ``last`` as last written."""
    order = F.struct(*at)
    return rows.groupBy(*key).agg(*[F.min_by(c, order).alias(c) for c in first], *[F.max_by(c, order).alias(c) for c in last])


def stems_ready(stems: DataFrame, files: DataFrame) -> DataFrame:
    """Cached stems of which all four files exist; ``stems``: ``file_hash, vocals, drums, bass, other``, ``files``: ``path``."""
    paths = stems.select("file_hash", F.explode(F.array("vocals", "drums", "bass", "other")).alias("path"))
    there = paths.join(files.select("path").distinct(), "path").groupBy("file_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 4")
    return stems.join(there.select("file_hash"), "file_hash", "left_semi")


def sample_library(files: DataFrame) -> DataFrame:
    """``kind, name, generated``: files by kind, and a default for each kind that has none; unknown names are left out."""
    found = files.select(text.classify(F.col("name")).alias("kind"), "name", F.lit(False).alias("generated")).filter("kind is not null")
    kinds = files.sparkSession.createDataFrame([(k,) for k in text.KINDS], "kind string")
    lacking = kinds.join(found.select("kind").distinct(), "kind", "left_anti")
    return found.unionByName(lacking.select("kind", F.concat(F.lit("default_"), "kind").alias("name"), F.lit(True).alias("generated")))


def set_size(minutes: Column, wanted: Column) -> Column:
    return F.coalesce(wanted, F.when(minutes <= 20, 8).when(minutes <= 40, 12).otherwise(16))


def hashed_unit(seed: int, *parts: str) -> Column:
    """A number in (0, 1] that follows from the seed and the row's values."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts])), 1, 8), 16, 10).cast("double") + 1) / 4294967296.0


def hashed_pick(asked: DataFrame, pool: DataFrame, kind: str, key: str, seed: int) -> DataFrame:
    """For each row of ``asked`` one of the pool's rows of its ``kind``, all alike likely; a kind without any leaves the row out.

    ``pool``: ``kind, name``; the pool's rows of a kind are numbered by name, and a hash of ``key`` names one.
    """
    w = Window.partitionBy(kind)
    numbered = pool.withColumns({"_k": F.row_number().over(w.orderBy("name")) - 1, "_n": F.count(F.lit(1)).over(w)})
    sizes = numbered.groupBy(kind).agg(F.max("_n").alias("_n"))
    chosen = asked.join(sizes, kind).withColumn("_k", F.least(F.floor(hashed_unit(seed, key) * F.col("_n")), F.col("_n") - 1).cast("int"))
    return chosen.drop("_n").join(numbered.drop("_n"), [kind, "_k"]).drop("_k")


def library_sample(tracks: DataFrame, size: int, seed: int) -> DataFrame:
    """Twice ``size`` tracks, all alike likely, without replacement: some will be dropped for their tempo."""
    return tracks.orderBy(hashed_unit(seed, "track_id"), "track_id").limit(2 * size)


def check_options(**options) -> dict:
    """The options, if each lies within its bounds; null ones are left out."""
    for name, (low, high) in BOUNDS.items():
        value = options.get(name)
        if value is not None and not low <= value <= high:
            raise ValueError(f"{name} must lie between {low} and {high}")
    for name, allowed in {"source": ("trends", "library"), "hype": ("off", "light", "heavy"), "blend": ("classic", "mashup"), "fx": ("clean", "club", "atmospheric")}.items():
        if options.get(name) is not None and options[name] not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return {k: v for k, v in options.items() if v is not None}


def one_row(df: DataFrame, what: str) -> DataFrame:
    """The rows that were asked for; none at all is an error."""
    if df.isEmpty():
        raise LookupError(f"{what}: not found")
    return df


def fx_settings(spark: SparkSession, style: str, overrides: dict | None = None) -> dict:
    """A style's settings with those overridden that are given; an unknown style is the clean one."""
    from cadenza.config import STYLES

    return STYLES.get(style, STYLES["clean"]) | {k: v for k, v in (overrides or {}).items() if v is not None}


def merged_map(base: Column, overrides: Column) -> Column:
    """``base`` with the non-null entries of ``overrides`` in place of its own."""
    given = F.map_filter(overrides, lambda _, x: x.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given)


# The lines of a manifest under a file's name.
MANIFEST = (("artist", "    artist : %s"), ("licence", "    licence: %s"), ("source", "    source : %s"))


def licence_lines(tracks: DataFrame) -> DataFrame:
    """``file, lines``: the text that names each file's artist, licence and source."""
    return tracks.select("file", F.array(F.col("file"), *[F.format_string(line, column) for column, line in MANIFEST], F.lit("")).alias("lines"))


def download_url(base: str, item: Column, name: Column) -> Column:
    """A file's address: spaces are %20, and a slash in a name stays."""
    return F.concat(F.lit(base), F.lit("/"), item, F.lit("/"), F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def load_tuning(path: str | None = None):
    """The tuning of a YAML file; a path in ``CADENZA_CONFIG`` stands in for none, and without a file all is as by default."""
    from cadenza.config import DEFAULT, tuned

    path = path or os.environ.get("CADENZA_CONFIG")
    if not path or not os.path.exists(path):
        return DEFAULT
    import yaml

    with open(path, encoding="utf-8") as f:
        return tuned(yaml.safe_load(f) or {})
