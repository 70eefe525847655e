"""Personal data with disguises undone, and spans in the source's code points.

The base detectors run on the text itself. For texts that hold a disguise, a
chain of transducers rewrites it: look-alike characters to ASCII, spelled
digits to digits, at/dot disguises to ``@`` and ``.``. Each keeps, for every
character it writes, the source range it came from, so what the same detectors
find in the rewritten text is reported where it stands in the source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import released, small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins at the begin of a run of digits, as a run's inner starts fail where its begin does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Cyrillic and Greek letters that look like these Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsdhqwABEKMHOPCTXIJSABEZHIKMNOPTYXo", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
CHARS = str.maketrans(
    LOOKALIKES
    | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    | {chr(z + i): str(i) for z in (0x0660, 0x06F0, 0x0966) for i in range(10)}
    | {"．": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", " ": " "}
)
DISGUISED = re.compile(f"[{re.escape(''.join(map(chr, CHARS)))}{INVISIBLE}]")
# Number words of the four languages.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_D = "|".join(sorted(DIGITS, key=len, reverse=True))
#: Three number words or digits in a row, a plus first if there is one.
SPELLED = re.compile(rf"(?:\bplus[\s-]+)?\b(?:{_D})(?:[\s.,-]+(?:{_D}|[0-9]+)){{2,}}\b", re.IGNORECASE)
ONE_DIGIT = re.compile(rf"plus[\s-]+|{_D}|[0-9]+", re.IGNORECASE)
#: Bracketed forms stand alone; a bare `at` or `dot` counts only where both make one address.
#: Possessive runs that begin where a run begins keep every search here in one pass over the text.
BRACKETED = re.compile(r"(?<!\s)\s*+[\[({<]\s*+(?:(at|arroba|@)|(dot|punkt|punto|point|\.))\s*+[\])}>]\s*+", re.IGNORECASE)
#: Each rewrite of addresses needs one of these.
BRACKET = re.compile(r"[\[({<]\s*+(?:at|arroba|@|dot|punkt|punto|point|\.)\s*+[\])}>]", re.IGNORECASE)
DOT = re.compile(r"\sdot\s", re.IGNORECASE)
BARE = re.compile(r"(?<=[A-Za-z0-9])(?:(\s++at\s++)|(\s++dot\s++))(?=[A-Za-z0-9])", re.IGNORECASE)
#: A chain of words joined by `dot`, and the host that may follow; a chain without one is passed over whole.
ADDRESS = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\s++dot\s++[A-Za-z0-9._%+-]++)*+((?:\s*+@\s*+|\s++at\s++)[A-Za-z0-9-]++(?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)++)?+", re.IGNORECASE
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search would, in one pass: a local part runs back from its ``@``."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all identifiers, unordered across kinds."""
    found = [(s, "email", e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        found += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), "card", m.end()))
    if "+" in text:
        found += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Rewritten:
    """A text with the source range of each character."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.changed = False

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, end, new) of the present text, in order and apart; each new character has its edit's whole source range."""
        if not edits:
            return
        self.changed = True
        out, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            out.append(self.text[at:s] + new)
            starts += self.starts[at:s] + [self.starts[s]] * len(new)
            ends += self.ends[at:s] + [self.ends[e - 1]] * len(new)
            at = e
        self.text = "".join(out) + self.text[at:]
        self.starts = starts + self.starts[at:]
        self.ends = ends + self.ends[at:]


def characters(r: Rewritten) -> None:
    r.apply([(m.start(), m.end(), "" if m[0] in INVISIBLE else m[0].translate(CHARS)) for m in DISGUISED.finditer(r.text)])


def spelled(r: Rewritten) -> None:
    edits = []
    for m in SPELLED.finditer(r.text):
        at = None
        for d in ONE_DIGIT.finditer(r.text, m.start(), m.end()):
            word = d[0].strip(" -\t\n").lower()
            if at is not None:
                # The gap between two digits goes with the digit that follows.
                edits.append((at, d.end(), DIGITS.get(word, word)))
            else:
                edits.append((d.start(), d.end(), "+" if word == "plus" else DIGITS.get(word, word)))
            at = d.end()
    r.apply(edits)


def addresses(r: Rewritten) -> None:
    # White space about a bracket belongs to the disguise; the edit covers it.
    r.apply([(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(r.text)])
    edits = []
    for m in ADDRESS.finditer(r.text):
        if m[1] and re.search(r"\s(?:at|dot)\s", m[0], re.IGNORECASE) and ("@" in m[0] or re.search(r"\sdot\s", m[0], re.IGNORECASE)):
            edits += [(x.start(), x.end(), "@" if x[1] else ".") for x in BARE.finditer(r.text, m.start(), m.end())]
    r.apply(edits)


def disguised(text: str) -> Rewritten | None:
    r = None
    if not text.isascii() and DISGUISED.search(text):
        r = Rewritten(text)
        characters(r)
    if SPELLED.search(r.text if r else text):
        r = r or Rewritten(text)
        spelled(r)
    now = r.text if r else text
    if BRACKET.search(now) or ("dot" in now.lower() and DOT.search(now)):
        r = r or Rewritten(text)
        addresses(r)
    return r if r and r.changed else None


def spans(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, added spans) of a text, ordered by start, then kind.

    Added are identifiers that only the rewritten text shows and that lie in no
    base span; one may reach over a base span that saw only a part of it.
    """
    if not text:
        return [], []
    order = lambda x: (x[0], KINDS.index(x[1]), x[2])
    base = sorted(detect(text), key=order)
    if (r := disguised(text)) is None:
        return base, []
    added = set()
    for s, kind, e in detect(r.text):
        a, b = r.starts[s], r.ends[e - 1]
        if text[a:b] != r.text[s:e] and not any(x <= a and b <= y for x, _, y in base):
            added.add((a, kind, b))
    return base, sorted(added, key=order)


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, kind, e in found)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: base counts by kind, the digest of base spans, all spans, how many the disguises added, and how many there are.

    Null and empty texts have no spans. Texts are searched whole, in time in
    proportion to their length; a repeated row repeats its result, and a null
    doc_id stays null. Other columns are not returned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                base, added = spans(text)
                every = sorted({*base, *added}, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), len(every)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        lambda b: released(run(b)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    )
