"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage reads all that its predecessor kept; all but the last return the
columns of ``documents``. No SQL gives ``run``'s rows, since the first stage is
fitted and the last tokenizes; the tests hold them against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm import language, lines, packing, pathjoin, postings
from cadenza.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters go; ``lang`` takes the predicted language."""
    model = language.fit(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    told = language.predict(docs, model).filter(F.col("lang_pred") != language.UNDETERMINED)
    return told.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; a text of which nothing is left goes. Rows without an id or text stay as they are."""
    done = lines.dedup_lines(docs).filter((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    kept = pathjoin.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    # The null-safe form keeps rows without an id.
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go, those without an id too; clean ones that share an id with them stay."""
    hit = postings.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (postings.text_key(F.col("text")) == F.col("_key"))
    return docs.join(hit, same, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 token ids, each with its sequence and offset there."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


ORACLE_SQL = None
