"""Token counts behind a digest cache.

A text's normalised content and the tokenizer's own file have a digest each; a
stored table maps the two to a count. Documents are joined with it by digest,
only distinct contents that it lacks are encoded, and their counts appended.
The cache is a plain Parquet table with a folder for each tokenizer version, so
a new version of the tokenizer finds nothing of the old one's.

Texts are moved only where their counts are unknown: a narrow table of digests
decides that first.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadenza.llm.common import released, scratch, small_batches, stored
from cadenza.llm.tokens import vocabulary

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: Contents of which at most so many are missing go out to the readers of the texts; beyond it they meet in a shuffle.
FEW = 100_000
#: A digest is hot if it has more than one row in so many; so many hot digests there are at most.
HOT = 1_000
#: Characters of common Latin texts, that all libraries put into the same classes; also the sign that special tokens begin with.
PLAIN = "\\t\\n\\r -~¡-¬®-ɏ‐-‧€"
ODD = re.compile(f"[^{PLAIN}]|<\\|")
#: Words that a task remembers, and the longest of them.
REMEMBERED, LONGEST, TOGETHER = 1 << 20, 64, 256

CACHE = "digest binary, n_tokens long, tokenizer string"


def version(tokenizer: str = TOKENIZER) -> str:
    """The digest of the tokenizer's file: what the cache knows it by."""
    with open(vocabulary(tokenizer), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column) -> Column:
    """Null as empty; plain Latin texts in lower case with single spaces, as this tokenizer sees them. Others stay as they are: marks and special tokens would count differently."""
    x = F.coalesce(text, F.lit(""))
    plain = ~x.rlike(f"[^{PLAIN}]") & ~F.contains(x, F.lit("<|"))
    return F.when(plain, F.trim(F.regexp_replace(F.lower(x), "[ \\t\\n\\r]+", " "))).otherwise(x)


def letters(kind: str) -> str:
    """The plain characters of a general category, and what they are in lower case, for a pattern's brackets."""
    plain = [c for c in map(chr, range(0x2100)) if not ODD.match(c)]
    return "".join(re.escape(c) for c in dict.fromkeys("".join(plain) + "".join(plain).lower()) if unicodedata.category(c)[0] == kind)


@functools.lru_cache(maxsize=2)
def counter(tokenizer: str = TOKENIZER, expected: str | None = None) -> Callable[[str], int]:
    """text -> number of tokens, as the library gives it.

    Plain texts are split into the tokenizer's own words, and each word that the
    task has not met goes through the library once; all others go through it whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if expected not in (None, version(tokenizer)):
        raise ValueError(f"an executor holds another version of {tokenizer} than the driver")
    library = Tokenizer.from_file(vocabulary(tokenizer))
    whole = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    if os.path.basename(tokenizer) != TOKENIZER:
        return whole
    # This tokenizer's words, for texts in lower case.
    letter, number = letters("L"), letters("N")
    words_of = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\\s{letter}{number}]+").findall
    known: dict[str, int] = {}

    def learn(new: list[str]) -> None:
        if len(known) > REMEMBERED:
            known.clear()
        for i in range(0, len(new), TOGETHER):
            some = new[i : i + TOGETHER]
            counts = [0] * len(some)
            for w in library.encode(" ".join(some), add_special_tokens=False).word_ids:
                counts[w] += 1
            known.update(zip(some, counts, strict=True))

    def count(text: str) -> int:
        if ODD.search(text):
            return whole(text)
        words = words_of(text.lower())
        distinct = {*words}
        if len(distinct) > REMEMBERED:
            return whole(text)
        if new := [w for w in distinct if w not in known and len(w) <= LONGEST]:
            learn(new)
            if any(w not in known for w in distinct if len(w) <= LONGEST):  # what was known before was cleared
                learn([w for w in distinct if w not in known and len(w) <= LONGEST])
        return sum(known[w] if len(w) <= LONGEST else whole(w) for w in words)

    return count


def encoded(misses: DataFrame, tokenizer: str, expected: str) -> DataFrame:
    """``digest, n_tokens`` of ``digest, text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer, expected)
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": [count(t) for t in batch["text"]]})

    return misses.select("digest", "text").mapInPandas(lambda b: released(run(b)), "digest binary, n_tokens long")


def cached(spark: SparkSession, cache: str, expected: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer version, each digest once (two runs at a time may both have appended it)."""
    found = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == expected)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str = TOKENIZER, limit: int = LIMIT, text: str = "text", keep: tuple[str, ...] = ("doc_id",), few: int = FEW) -> DataFrame:
    """``keep``'s columns with ``n_bytes, n_tokens, over_limit``: one row per row of ``docs``.

    ``cache`` is a folder that all executors share; it is made if it is missing,
    and without one the counts are kept below the shared scratch folder for this
    call alone. A call that dies leaves the cache as it was or with whole
    appends; the next one encodes what is still missing.

    Null texts count as empty (no bytes, no tokens). Equal contents are encoded
    once, whatever the case and spacing of plain Latin texts. Columns of ``keep``
    named like those added are replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache, expected = cache or scratch(spark), version(tokenizer)
    # Only this tokenizer is known to see through case and spacing.
    content = normalised(F.col(text)) if os.path.basename(tokenizer) == TOKENIZER else F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    added = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in keep if c not in added]
    told = stored(docs.select(F.struct(*keep).alias("row"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest")))
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)

    contents = stored(told.groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    wanted = stored(contents.join(cached(spark, cache, expected), "digest", "left_anti").select("digest"))
    n_wanted = wanted.count()
    if n_wanted:
        texts = docs.select(digest.alias("digest"), content.alias("text"))
        if n_wanted <= few:
            texts = texts.join(F.broadcast(wanted), "digest", "left_semi")
        # Copies meet in their own task first, so a hot content reaches its reducer once a task.
        once = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if n_wanted > few:
            once = once.join(wanted, "digest", "left_semi")
        encoded(once, tokenizer, expected).withColumn("tokenizer", F.lit(expected)).write.mode("append").partitionBy("tokenizer").parquet(cache)

    counts = cached(spark, cache, expected)
    n_rows = contents.agg(F.sum("n")).first()[0] or 0
    # More than n_rows / HOT rows each: fewer than HOT digests, so they fit a broadcast at any size.
    hot = counts.join(F.broadcast(contents.filter(F.col("n") * HOT > n_rows).select("digest")), "digest").select("digest", F.col("n_tokens").alias("hot"))
    split = told.join(F.broadcast(hot), "digest", "left")
    warm = split.filter("hot is not null").select("row", "n_bytes", F.col("hot").alias("n_tokens"))
    rest = split.filter("hot is null").join(counts, "digest").select("row", "n_bytes", "n_tokens")
    return warm.unionByName(rest).select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
