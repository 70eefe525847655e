"""Line dedup by winnowing, in DataFrame operations only.

Lines without a word play no part and stay. A gram is the shortest run of
lines, from a given one, of at least ``NOISE`` words; among the grams that lie
in the ``GUARANTEE`` words from a line, the smallest hash is a fingerprint.
Positions of a fingerprint are grouped by their next lines each way, level by
level within ``GUARANTEE`` words, and all but the first of a group, in the
order of (doc_id, text hash, line), lose the line of that level. So a run is
met with all earlier ones, nothing shorter than ``NOISE`` words is deleted,
and each deleted line has an equal one earlier. A repeated run of
``GUARANTEE`` words goes whole: its fingerprints leave no line further from one
of them than the levels reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.llm.common import spare, stored

NOISE, GUARANTEE = 25, 50


def numbered(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: document key, line's place among all and among these, hash, words before and in it.

    Lines of a document meet in one exchange; repeated rows fall together in it.
    """
    lines = docs.select("doc_id", F.unhex(F.md5("text")).alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc_id", "key", "pos", F.unhex(F.md5("line")).alias("h"), F.regexp_count("line", F.lit(r"\S+")).alias("w")
    )
    one = lines.filter("w > 0").repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "pos"])
    doc = Window.partitionBy("doc_id", "key").orderBy("pos")
    return one.withColumn("c", F.coalesce(F.sum("w").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("i", F.row_number().over(doc) - 1)


def fingerprints(lines: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """``doc_id, key, i, pos, c, w, g``: the line at which each fingerprint begins, and its hash."""
    doc = Window.partitionBy("doc_id", "key").orderBy("c")
    near = doc.rangeBetween(0, noise - 1)
    grams = lines.select(
        "doc_id", "key", "i", "pos", "c", "w",
        F.unhex(F.md5(F.array_join(F.transform(F.collect_list("h").over(near), lambda h: F.lower(F.hex(h))), ","))).alias("g"),
        (F.col("c") + F.sum("w").over(near)).alias("e"),
    ).filter(F.col("e") - F.col("c") >= noise)
    ahead = F.collect_list(F.struct("g", "i", "e", "pos", "c", "w")).over(doc.rangeBetween(0, guarantee - noise))
    inside = F.filter(ahead, lambda x: (x["i"] == F.col("i")) | (x["e"] <= F.col("c") + guarantee))
    return grams.select("doc_id", "key", F.array_min(inside).alias("m")).select("doc_id", "key", *[F.col(f"m.{x}").alias(x) for x in ("i", "pos", "c", "w", "g")]).distinct()


def repeated_runs(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """``doc_id, key, dropped``: sorted places of the lines that an earlier run repeats.

    The lines near a mark come from frames of ``guarantee`` words over the
    document's lines, with the mark's two ends as rows among them: work and
    bytes follow the number of lines and marks, however long a document is.
    """
    lines = stored(numbered(docs.select("doc_id", F.col("text").cast("string")).filter("doc_id is not null and text is not null")))
    marks = fingerprints(lines, noise, guarantee)
    often = marks.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    hot = stored(marks.join(often, "g"))
    none = lambda kind: F.lit(None).cast(kind)
    sides = F.array(F.struct(F.lit(1).alias("side"), (F.col("c") + F.col("w")).alias("x")), F.struct(F.lit(-1).alias("side"), F.col("c").alias("x")))
    ends = hot.select("doc_id", "key", "i", "pos", "g", F.explode(sides).alias("s")).select("doc_id", "key", "s.x", "s.side", "i", "pos", "g", none("struct<c:bigint,pos:int,h:bigint>").alias("line"))
    held = lines.join(hot.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi")
    there = held.select("doc_id", "key", F.col("c").alias("x"), none("int").alias("side"), none("int").alias("i"), none("int").alias("pos"), none("binary").alias("g"), F.struct("c", "pos", F.xxhash64("h").alias("h")).alias("line"))
    doc = Window.partitionBy("doc_id", "key").orderBy("x")
    frame = lambda lo, hi: F.array_sort(F.collect_list("line").over(doc.rangeBetween(lo, hi)))
    near = there.unionByName(ends).withColumn("right", frame(0, guarantee - 1)).withColumn("left", F.reverse(frame(-guarantee, -1))).filter("side is not null")

    def told(side: str, sign: int):
        return F.transform(side, lambda x, k: F.struct((sign * (k + 1)).cast("int").alias("t"), F.xxhash64(F.slice(F.col(f"{side}.h"), 1, k + 1)).alias("context"), x["pos"].alias("pos")))

    at = F.array(F.struct(F.lit(0).alias("t"), F.lit(0).cast("long").alias("context"), F.col("pos")))
    reach = near.select("doc_id", "key", "i", "g", F.explode(F.when(F.col("side") > 0, F.concat(at, told("right", 1))).otherwise(told("left", -1))).alias("x")).select("doc_id", "key", "i", "g", "x.*")
    level = ["g", "t", "context"]
    first = reach.groupBy(*level).agg(F.min(F.struct("doc_id", "key", "i")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = reach.join(first, level).filter(F.struct("doc_id", "key", "i") > F.col("f"))
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def without(text: str, dropped: str) -> Column:
    """The lines of ``text`` but for the sorted places ``dropped``: runs between them are cut out, each line copied once."""
    held = F.array(F.struct(F.split(text, "\n").alias("lines"), F.col(dropped).alias("gone")))

    def kept(x: Column) -> Column:
        after = F.concat(F.array(F.lit(-1)), x["gone"])
        until = F.concat(x["gone"], F.array(F.size(x["lines"])))
        return F.flatten(F.zip_with(after, until, lambda a, b: F.slice(x["lines"], a + 2, b - a - 1)))

    return F.array_join(F.transform(held, kept)[0], "\n")


def dedup_lines(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """``docs`` with ``text`` cleaned, ``n_lines`` and ``n_dropped``.

    Null texts stay null, with no lines; an empty text has one empty line. A
    row without a doc_id is left as it is. Equal rows share one result, so a
    repeated row loses no line to its copy. Ties of hashes go to the smaller
    document and line. Columns named like those added are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    key, dropped = spare(docs.columns, "key", "dropped")
    gone = repeated_runs(docs, noise, guarantee).withColumnsRenamed({"key": key, "dropped": dropped})
    keyed = docs.withColumn(key, F.unhex(F.md5("text"))).join(gone, ["doc_id", key], "left")
    told = keyed.withColumns({"n_lines": F.coalesce(F.size(F.split("text", "\n")), F.lit(0)), "n_dropped": F.coalesce(F.size(dropped), F.lit(0))})
    done = told.withColumn("text", F.when(F.col("n_dropped") > 0, without("text", dropped)).otherwise(F.col("text")))
    return done.select(*docs.columns, F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.greatest("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


LINES_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
parts AS (SELECT doc_id, md5(text) AS key, string_split(text, chr(10)) AS ls FROM d),
every AS (SELECT doc_id, key, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
worded AS (SELECT doc_id, key, pos, md5(line) AS h, len(regexp_extract_all(line, '\\S+')) AS w FROM every),
lines AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id, key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
  row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) - 1 AS i FROM worded WHERE w > 0),
g0 AS (SELECT doc_id, key, i, c, md5(array_to_string(list(h) OVER near, ',')) AS g, (c + sum(w) OVER near)::BIGINT AS e FROM lines
  WINDOW near AS (PARTITION BY doc_id, key ORDER BY c RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING)),
grams AS (SELECT * FROM g0 WHERE e - c >= 25),
picked AS (SELECT a.doc_id, a.key, a.i AS at, min(struct_pack(g := b.g, i := b.i)) AS m FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.key = b.key
  AND b.c BETWEEN a.c AND a.c + 25 AND (b.i = a.i OR b.e <= a.c + 50) GROUP BY ALL),
marks AS (SELECT DISTINCT doc_id, key, m.i AS i, m.g AS g FROM picked),
whole AS (SELECT m.*, l.c, l.w FROM marks m JOIN lines l USING (doc_id, key, i)),
later AS (SELECT m.doc_id, m.key, m.i, m.c, m.w, f.doc_id AS e_id, f.key AS e_key, f.i AS j FROM whole m JOIN marks f USING (g)
  WHERE struct_pack(doc_id := m.doc_id, key := m.key, i := m.i) > struct_pack(doc_id := f.doc_id, key := f.key, i := f.i)),
aligned AS (SELECT l.doc_id, l.key, l.i, l.j, l.e_id, l.e_key, x.i AS t, x.pos, coalesce(x.h = y.h, false) AS same FROM later l JOIN lines x ON x.doc_id = l.doc_id AND x.key = l.key
  AND x.c >= l.c - 50 AND x.c < l.c + l.w + 50
  LEFT JOIN lines y ON y.doc_id = l.e_id AND y.key = l.e_key AND y.i = x.i + l.j - l.i),
ends AS (SELECT doc_id, key, i, j, e_id, e_key, max(CASE WHEN NOT same AND t < i THEN t END) AS a, min(CASE WHEN NOT same AND t > i THEN t END) AS b FROM aligned GROUP BY ALL),
gone AS (SELECT DISTINCT x.doc_id, x.key, x.pos FROM aligned x JOIN ends r USING (doc_id, key, i, j, e_id, e_key) WHERE x.t > coalesce(r.a, -1) AND x.t < coalesce(r.b, 1000000000)),
lost AS (SELECT doc_id, key, list(pos) AS dropped FROM gone GROUP BY ALL)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN 0 ELSE len(string_split(s.text, chr(10))) END::BIGINT AS n_lines, coalesce(len(l.dropped), 0)::BIGINT AS n_dropped,
  CASE WHEN l.dropped IS NULL THEN s.text ELSE array_to_string(list_filter(string_split(s.text, chr(10)), lambda x, p: NOT list_contains(l.dropped, p - 1)), chr(10)) END AS text
FROM documents s LEFT JOIN lost l ON l.doc_id = s.doc_id AND l.key = md5(s.text)
"""
