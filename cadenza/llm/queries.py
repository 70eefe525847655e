"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm import forest, language, lines, masked, negatives, order, packing, pathjoin, pii, postings, shards, tally, whitening
from cadenza.llm.common import table


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.materialise(table(spark, sf_dir, "documents")).drop("path")


def op2_masked_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked.score(docs, masked.train(docs))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathjoin.near_duplicates(table(spark, sf_dir, "documents"), n=2, threshold=0.8)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shards.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", shards.size_of().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is this run's own, so every distinct content is encoded."""
    return tally.count_tokens(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that leaves a long (from some 10**7 rows on) is null here; the operator's is a decimal."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {
    f.__name__: f
    for f in (op1_training_order, op2_masked_score, op3_language, op4_decontaminate, op5_near_duplicates, op6_line_dedup, op7_nearest, op8_shards, op9_personal_data, op10_pack, op11_token_counts, op12_whitening, op13_hard_negatives)
}

CONTAMINATION_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i:i + 9])) AS g FROM bw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
runs AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM dw, sizes WHERE len(w) >= k),
occ AS (SELECT DISTINCT runs.r, item, p, k FROM runs JOIN win ON g = w[p:p + k - 1]),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item COLLATE "C") AS s FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

NEAR_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) END AS s FROM dw),
sh AS (SELECT doc_id, unnest(s) AS x FROM ds),
sizes AS (SELECT doc_id, len(s) AS n FROM ds),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS root FROM ds UNION SELECT sym.b, root FROM reach JOIN sym ON sym.a = reach.v WHERE root < sym.b)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN (SELECT v AS doc_id, min(root) AS component_id FROM reach GROUP BY v) USING (doc_id)
"""

#: Rows without an id take no part; of rows that share one, the smallest by label and vector.
NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
dims AS (SELECT len(v) AS d FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
r AS (SELECT vec_id, min(struct_pack(label := label, x := list_transform(v, lambda c: floor(256 * c::DOUBLE)))) AS s FROM e JOIN dims ON len(v) = d GROUP BY 1),
rows_ AS (SELECT vec_id, s.label AS label, s.x AS x FROM r),
sc AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM rows_ a JOIN rows_ b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM sc WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN sc USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""

ORACLES = {"op4_decontaminate": CONTAMINATION_SQL, "op5_near_duplicates": NEAR_SQL, "op6_line_dedup": lines.LINES_SQL, "op13_hard_negatives": NEGATIVES_SQL}
