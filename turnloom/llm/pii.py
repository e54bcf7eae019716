"""Personal data in whole texts: plain detectors, and detectors behind offset-preserving deobfuscation.

A transducer rewrites disguises (lookalike characters, spelled digits, "at" and "dot" in brackets or as words) and keeps,
for every stretch of its output, the source stretch that it came from; what the same detectors find in the output is
mapped back to source characters and added to what they find in the source. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, str, int]  # start, kind, end

# Each equals its plain pattern, leftmost and non-overlapping, but takes linear time on endless runs of one class.
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEPARATORS = {ord(c): None for c in " -().+"}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _AFTER_AT.match(text, at) if start < at else None
        end = m.end() if m else max(end, at)
        at = text.find("@", max(end, at + 1) if m is None else end)
        if m:
            yield start, end


def _ip_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            yield m.span()


def _card_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].translate(_SEPARATORS)) <= 19 and luhn(d):
            yield m.span()


def _phone_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


_DIGIT = re.compile("[0-9]")


def plain_spans(text: str) -> list[Span]:
    """What the detectors find in the text as it is, by start, then kind as listed."""
    found = [(s, "email", e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(s, "ip", e) for s, e in _ip_spans(text)]
        found += [(s, "card", e) for s, e in _card_spans(text)]
        if "+" in text:
            found += [(s, "phone", e) for s, e in _phone_spans(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


#: Digits as words in four languages; a run of SPELLED of them or more is read as digits.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SPELLED = 7
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("асеорхуіјѕһԁԛԝνοικρταΑΒΕΖΗΙΚΜΝΟΡΤΧАВЕКМНОРСТХ", "aceopxyijshdqwvoikptaABEZHIKMNOPTXABEKMHOPCTX"))
_ODD = "[­Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‍‐-‒⁠﻿！-～\U0001d400-\U0001d7ff]"
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_RUN = rf"(?:\bplus[\x20-]*)?\b{_WORD}(?:[\x20,.-]{{1,2}}{_WORD}){{{SPELLED - 1},}}\b"
_AT = r"[\[({<][\x20]*(?:at|@|arroba|ät)[\x20]*[\])}>][\x20]*"
_DOT = r"[\[({<][\x20]*(?:dot|\.|punkt|point|punto)[\x20]*[\])}>][\x20]*"
_AT_WORD = r"(?<=[a-z0-9])\x20at\x20(?=[a-z0-9-]+(?:\x20dot\x20|\.)[a-z]+)"
_DOT_WORD = r"(?<=[a-z0-9])\x20dot\x20(?=[a-z0-9])"
_DISGUISE = re.compile(f"(?P<odd>{_ODD})|(?P<run>{_RUN})|(?P<at>{_AT}|{_AT_WORD})|(?P<dot>{_DOT}|{_DOT_WORD})", re.I)
_TRIGGER = re.compile(_ODD)
_BRACKET = re.compile(r"[\[({<][\x20]*(?:at|@|arroba|ät|dot|\.|punkt|point|punto)[\x20]*[\])}>]", re.I)
_SPELLED = re.compile(_RUN)
_AT_MAIL = re.compile(r"\x20at\x20[a-z0-9-]+(?:\x20dot\x20|\.)[a-z]+")
_BRACKETS = re.compile(r"[\[({<]")


def _plain_char(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if "‐" <= c <= "‒":
        return "-"
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else c


def disguised(text: str) -> bool:
    """Whether anything in the text could be one of the transducer's disguises (a linear test, seldom true)."""
    if not text.isascii() and _TRIGGER.search(text):
        return True
    if _BRACKETS.search(text) and _BRACKET.search(text):
        return True
    low = text.lower()
    if " dot " in low or " at " in low and _AT_MAIL.search(low):
        return True
    words = low.replace(",", " ").replace(".", " ").replace("-", " ").split()
    return sum(map(DIGIT_WORDS.__contains__, words)) >= SPELLED and bool(_SPELLED.search(low))


def transduce(text: str) -> tuple[str, Callable[[int, int], tuple[int, int]]]:
    """The text without disguises, and what maps a span of it to the span of the source that it came from."""
    out: list[str] = []
    starts, sources = [0], [(0, 0, True)]  # of each stretch: its start in the output; its source, and whether it was copied
    n = at = 0

    def put(s: str, a: int, b: int, same: bool) -> None:
        nonlocal n
        if s:
            starts.append(n)
            sources.append((a, b, same))
            out.append(s)
            n += len(s)

    for m in _DISGUISE.finditer(text):
        start = m.start()
        if m.lastgroup in ("at", "dot"):  # the spaces before a bracket belong to it
            while start > at and text[start - 1] == " ":
                start -= 1
        put(text[at:start], at, start, True)
        at = m.end()
        if m.lastgroup == "odd":
            new = _plain_char(m[0])
        elif m.lastgroup == "run":
            low = m[0].lower()
            new = "+" * low.startswith("plus") + "".join(DIGIT_WORDS[w] for w in re.findall(_WORD, low.removeprefix("plus")))
        else:
            new = "@" if m.lastgroup == "at" else "."
        put(new, start, m.end(), False)
    put(text[at:], at, len(text), True)

    def back(s: int, e: int) -> tuple[int, int]:
        i, j = bisect_right(starts, s) - 1, bisect_right(starts, e - 1) - 1
        a, b = sources[i], sources[j]
        return a[0] + (s - starts[i]) * a[2], b[0] + e - starts[j] if b[2] else b[1]

    return "".join(out), back


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """The plain spans, and all spans: those and what only the transducer's output shows."""
    base = plain_spans(text)
    if not disguised(text):
        return base, base
    plain, back = transduce(text)
    if plain == text:
        return base, base
    # spans of a kind don't overlap, so only the last that begins at or before another can contain it
    of = {k: [(x, y) for x, j, y in base if j == k] for k in KINDS}
    more = []
    for s, kind, e in plain_spans(plain):
        a, b = back(s, e)
        i = bisect_right(of[kind], a, key=lambda p: p[0])
        if not i or of[kind][i - 1][1] < b:
            more.append((a, kind, b))
    return base, sorted({*base, *more}, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def written_out(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def redact(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping ones are one, named after the first."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the plain spans by kind, base_sha256 of them, and spans (all). Null texts are empty; null
    ids stay; very long texts are read whole, in linear time; spans of equal start come in the order of KINDS; repeated rows
    stay; an empty table gives no rows; other columns aren't read."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1):
                base, every = spans(t.as_py())
                kinds = [k for _, k, _ in base]
                for c, k in zip(cols, KINDS):
                    c.append(kinds.count(k))
                cols[4].append(hashlib.sha256(written_out(base).encode()).hexdigest())
                cols[5].append(written_out(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=[f.split()[0] for f in schema.split(", ")])

    return text_rows(docs, id_col, text_col).mapInArrow(find, schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in its text, and n_chars, if there, to match. Null texts stay null, empty ones
    empty; very long ones are masked whole; overlapping spans are masked as one; repeated rows stay; an empty table gives no
    rows; all other columns stay as they are."""
    @F.pandas_udf("string")
    def mask(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else redact(t, spans(t)[1]))

    out = docs.withColumn(text_col, mask(F.col(text_col)))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
