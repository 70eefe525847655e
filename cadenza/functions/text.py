"""Titles, artists, file names, durations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Words and brackets that never name a song.
NOISE = r"(?i)\b(official|video|audio|lyrics?|lyric|hd|4k|remaster(ed)?|feat\.?|ft\.?|prod\.?|explicit|radio edit|full|clip|music)\b"
BRACKETS = r"[\(\[\{][^\)\]\}]*[\)\]\}]"
#: Letters, digits and marks of the Hebrew block stay.
NOT_WORD = r"[^\p{L}\p{N}_\s\x{0590}-\x{05FF}]"
# Notes about a video in brackets, the same at a title's end, and a channel's suffix.
VIDEO_NOTE = r"(?i)\s*[\(\[][^\)\]]*(official|video|audio|lyric|lyrics|visualizer|hd|4k|mv|m/v|clip|prod|remix by)[^\)\]]*[\)\]]"
VIDEO_TAIL = r"(?i)\s*[-|–]\s*(official\s*)?(music\s*)?(video|audio|lyrics?|visualizer)\s*$"
TOPIC = r"(?i)\s*-\s*Topic$"
# A date, a track number and punctuation about a catalogued title.
DATE_PREFIX = r"^\s*\d{4}[-_]\d{2}[-_]?"
TRACK_NUMBER = r"^[\s_]*\d{1,3}[\s_]*[-._)]?[\s_]+"
EDGES = r"^[ \-_.]+|[ \-_.]+$"
KINDS = ("riser", "impact", "airhorn", "shout", "sweep")
# Other names of the kinds, in the order they are tried.
ALIASES = (("build", "riser"), ("uplifter", "riser"), ("up", "riser"), ("hit", "impact"), ("boom", "impact"), ("downlifter", "sweep"), ("horn", "airhorn"), ("vox", "shout"), ("voice", "shout"))


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(x: Column) -> Column:
    """Full-width letters, ligatures and the like as the plain characters they stand for; ASCII texts never leave the JVM."""
    return F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(_compatible(F.when(~x.rlike(r"^\p{ASCII}*$"), x)))


def normalize(x: Column) -> Column:
    """Comparable form of a title or artist; null and empty give ''."""
    x = compatible(x)
    for pattern in (BRACKETS, NOISE, NOT_WORD):
        x = F.regexp_replace(x, pattern, " ")
    return F.coalesce(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))), F.lit(""))


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def strip_diacritics(x: Column) -> Column:
    """Compatible decomposition without marks, Hebrew points included; null stays null."""
    odd = ~x.rlike(r"^\p{ASCII}*$")
    return F.when(odd, F.regexp_replace(_decomposed(F.when(odd, x)), r"\p{M}", "")).otherwise(x)


def safe_name(x: Column, default: str = "track", longest: int = 180) -> Column:
    """A file name without reserved characters."""
    clean = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', "_"))
    return F.left(F.when(clean == "", default).otherwise(clean), F.lit(longest))


def match_key(title: Column, artist: Column) -> Column:
    return F.trim(F.concat_ws(" ", normalize(artist), normalize(title)))


def split_title(raw: Column, channel: Column) -> Column:
    """struct(artist, title) of a video's name; without a separator the channel is the artist."""
    x = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), VIDEO_NOTE, ""), VIDEO_TAIL, ""))
    out = F.struct(F.trim(F.regexp_replace(F.coalesce(channel, F.lit("")), TOPIC, "")).alias("artist"), x.alias("title"))
    for sep in (" | ", " — ", " – ", " - "):
        at = F.instr(x, sep)
        out = F.when(at > 0, F.struct(F.trim(F.substring(x, F.lit(1), at - 1)).alias("artist"), F.trim(F.substring(x, at + len(sep), F.length(x))).alias("title"))).otherwise(out)
    return out


def clean_title(raw: Column, artist: Column | None = None) -> Column:
    """Up to three rounds without date, track number, the artist's name and edge punctuation; falls back to the raw title."""
    raw = F.trim(F.coalesce(raw, F.lit("")))
    x = raw
    for _ in range(3):
        x = F.regexp_replace(F.regexp_replace(x, DATE_PREFIX, ""), TRACK_NUMBER, "")
        if artist is not None:
            quoted = F.concat(F.lit(r"(?i)^\s*\Q"), F.replace(artist, F.lit(r"\E"), F.lit("")), F.lit(r"\E\s*[-_]\s*"))
            x = F.when(F.coalesce(artist, F.lit("")) != "", F.regexp_replace(x, quoted, "")).otherwise(x)
        x = F.regexp_replace(x, EDGES, "")
    return F.when(x == "", raw).otherwise(x)


def classify(name: Column) -> Column:
    stem = F.lower(F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", ""))
    out = F.lit(None).cast("string")
    for word, kind in reversed([*((k, k) for k in KINDS), *ALIASES]):
        out = F.when(F.contains(stem, F.lit(word)), kind).otherwise(out)
    return out


def seconds(x: Column) -> Column:
    """H:MM:SS, M:SS or seconds; junk gives 0, but a bad part between colons is an error."""
    part = lambda p: F.when(p.try_cast("double").isNull(), F.raise_error(F.concat(F.lit("not a duration: "), x)).cast("double")).otherwise(p.try_cast("double"))
    timed = F.aggregate(F.split(F.trim(x), ":"), F.lit(0.0), lambda s, p: s * 60 + part(p))
    return F.when(F.contains(x, F.lit(":")), timed).otherwise(F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0)))


def timecode(x: Column) -> Column:
    """MM:SS.ss; negatives are 0, minutes have no upper end."""
    x = F.greatest(F.lit(0.0), x)
    minutes = F.floor(x / 60)
    return F.format_string("%02d:%05.2f", minutes, x - minutes * 60)
