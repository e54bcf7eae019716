"""Secrets in whole texts: known forms, and dictionary-primed zstandard novelty.

Beside the known forms, a run of key characters in a sensitive context is a candidate: on the line of a sensitive word, on
either side of it, or soon after it on the next ones. Its marginal cost is what it adds to the zstandard frame of the
characters around it, with a dictionary of identifiers, those below and the documents' own common ones, as the compressor's
history; text made of known identifiers or of its surroundings adds little, a random key about its entropy. Candidates that
cost at least ``NOVEL`` bits a character are reported. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

KINDS = ("assign", "access", "hex", "novel")
Span = tuple[int, str, int]  # start, kind, end

_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Words that make what follows them sensitive.
SENSITIVE = ("authorization", "bearer", "credential", "passphrase", "password", "passwd", "private", "secret", "session", "signature", "token", "api_key", "apikey", "access_key", "auth_key", "client_key", "encryption_key")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.A | re.I)
#: The identifier dictionary, as text; the compressor's history begins with it.
IDENTIFIERS = """
import from return class public private static final void string integer boolean function const let var def self this null none true false
if else elif for while try except catch finally raise throw new delete lambda async await yield with open close read write append
config configuration settings environment variable default value option parameter argument username user_name password passwd secret token
access_token refresh_token api_key apikey client_id client_secret session_id authorization bearer basic credential certificate public_key
private_key encryption_key signature algorithm sha256 sha512 base64 encode decode hostname localhost connection database postgres mysql
mongodb redis amazonaws.com googleapis.com github.com example.com http:// https:// application/json content-type user-agent accept
YOUR_API_KEY_HERE REPLACE_ME CHANGE_ME changeme placeholder xxxxxxxxxxxxxxxx 0123456789abcdef abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000-0000-0000-0000-000000000000 get_user_by_id set_password_hash validate_session_token
"""
_KEY = re.compile(r"[A-Za-z0-9+/_.=~-]+")
#: Characters of a candidate at least.
SHORTEST = 16
#: Defaults of two parameters. A context goes on over line ends for REACH characters after a sensitive word; AROUND characters
#: on either side of a candidate are its surroundings (repetition further away doesn't lower its cost).
REACH, AROUND = 48, 192
#: Names of letters joined by underscores that occur in COMMON documents or more are identifiers; the KNOWN most common ones
#: join the dictionary. LONGEST letters of a name at most, so the dictionary's size is bounded.
COMMON, KNOWN, LONGEST = 20, 1000, 40
_JOINED = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]+(?:_+[A-Za-z]+)+(?![A-Za-z0-9_])")
#: Names that a worker counts before it hands them on.
HELD = 100_000
#: Least marginal bits a character that are novel; hexadecimal digits have at most 4, base64 at most 6.
NOVEL = 3.2
#: The same without digits: long words that the surroundings lack cost about 6, random letters of both cases 7 and more.
NOVEL_LETTERS = 7.0

_COMPRESSORS: dict[str, object] = {}


def _size(data: bytes, identifiers: str) -> int:
    if identifiers not in _COMPRESSORS:
        import zstandard

        history = zstandard.ZstdCompressionDict((identifiers + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _COMPRESSORS.clear()
        _COMPRESSORS[identifiers] = zstandard.ZstdCompressor(level=9, dict_data=history, write_content_size=False, write_checksum=False)
    return len(_COMPRESSORS[identifiers].compress(data))


def marginal_bits(before: str, candidate: str, after: str, identifiers: str = "") -> float:
    """Bits a character that a candidate adds to its surroundings; ``identifiers`` are known beside the fixed ones."""
    around = (before + "\n" + after).encode()
    return 8 * (_size(around + b"\n" + candidate.encode(), identifiers) - _size(around, identifiers)) / len(candidate)


def identifiers_of(docs: DataFrame, text_col: str = "text", common: int = COMMON, known: int = KNOWN) -> str:
    """The documents' own common identifiers, counted over all of them, the most common ones last (nearest to the text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        handed = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["name", "n"])
        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                if "_" in text:
                    held.update({m for m in _JOINED.findall(text) if len(m) <= LONGEST})
                if len(held) > HELD:
                    yield handed()
                    held.clear()
        yield handed()

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    top = sums.where(F.col("n") >= common).orderBy(F.desc("n"), "name").limit(known).collect()
    return " ".join(r.name for r in reversed(top)) + "\n"


def base_spans(text: str) -> list[Span]:
    """Known forms, leftmost and non-overlapping per kind; by start, then kind as listed."""
    found = []
    if (":" in text or "=" in text) and any(n in low for low in (text.lower(),) for n in _NAMES):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def contexts(text: str, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """Where candidates begin: lines with sensitive words, and ``reach`` characters after such a word, without the words
    themselves. Ascending, apart, found in linear time."""
    words = [(m.start(), m.end()) for m in _SENSITIVE.finditer(text)]
    line, line_end, covered = 0, -1, 0
    for i, (start, end) in enumerate(words):
        if start > line_end:
            line = text.rfind("\n", max(0, line_end), start) + 1 or max(0, line_end + 1)
            line_end = text.find("\n", end)
            line_end = len(text) if line_end < 0 else line_end
        if max(covered, line) < start:
            yield max(covered, line), start
        covered = max(line_end, min(len(text), end + reach + 1))
        if i + 1 < len(words):
            covered = min(covered, words[i + 1][0])
        if end < covered:
            yield end, covered


def novel_spans(text: str, known: list[Span], reach: int = REACH, around: int = AROUND, identifiers: str = "") -> list[Span]:
    """Candidates of high marginal cost that no known span touches; of letters alone, of a higher cost. A sensitive word ends
    a run of key characters, and no run is measured twice."""
    found, done = [], 0
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    starts = [s for s, _, _ in known]
    ends = list(accumulate((e for _, _, e in known), max))
    words = [m.start() for m in _SENSITIVE.finditer(text)]
    for first, last in contexts(text, reach):
        at = max(done, first)
        while at < last and (m := _KEY.search(text, at, last)):
            start, end = m.span()
            if end == last and last < len(text):  # the run may go on beyond the context, up to the next sensitive word
                i = bisect_left(words, last)
                end = _KEY.match(text, start, words[i] if i < len(words) else len(text)).end()
            at = done = end
            c, i = text[start:end], bisect_left(starts, end)
            if end - start < SHORTEST or i and ends[i - 1] > start or not any(x.isalpha() for x in c):
                continue
            least = NOVEL if any(x.isdigit() for x in c) else NOVEL_LETTERS
            if marginal_bits(text[max(0, start - around) : start], c, text[end : end + around], identifiers) >= least:
                found.append((start, "novel", end))
    return found


def written_out(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, around: int = AROUND, common: int = COMMON) -> DataFrame:
    """Per row: doc_id, counts of the known forms, base_sha256 of their spans, and spans (all). Null texts are empty; null
    ids stay; very long texts are read whole, in linear time; spans of equal start come in the order of KINDS; repeated rows
    stay; an empty table gives no rows; other columns aren't read. The documents' common identifiers are counted first, over
    all of them."""
    identifiers = identifiers_of(docs, text_col, common)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for t in b.column(1):
                text = t.as_py()
                base = base_spans(text)
                every = sorted([*base, *novel_spans(text, base, reach, around, identifiers)], key=lambda x: (x[0], KINDS.index(x[1])))
                kinds = [k for _, k, _ in base]
                for c, k in zip(cols, KINDS[:3]):
                    c.append(kinds.count(k))
                cols[3].append(hashlib.sha256(written_out(base).encode()).hexdigest())
                cols[4].append(written_out(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=[f.split()[0] for f in schema.split(", ")])

    return text_rows(docs, id_col, text_col).mapInArrow(find, schema)
