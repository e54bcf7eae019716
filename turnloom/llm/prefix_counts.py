"""Token counts of every prefix of a text, by dynamic programming over its prefixes.

The encoding of a prefix by a byte pair encoding is that of a shorter prefix and one token more: the token that ends there
and that the model leaves as it is after the shorter one's last token. So one pass over a pre-token gives the count of each
of its prefixes. Pre-tokens are found as in ``tokenizing``, and a prefix of a text is cut into those before it and a prefix
of the last, but for three cases: white space at a prefix's end is one pre-token; a contraction is one only as a whole; and
an added token counts one only as a whole. Counts of a text are stored as differences from one prefix to the next (they may
be negative), so that truncation and budgets are looked up without encoding anything again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_rows
from .tokenizing import CONTRACTED, UNKNOWN, WHITE, Encoder, borders, byte_letters, classes
from .words import groups

#: Tokens that a training window has.
LIMIT = 512
#: Bytes of pre-tokens and of their counts that a worker keeps, and bytes of text that are counted at once.
KEPT, GROUP = 32 << 20, 4 << 20
#: Pairs of tokens of which a worker remembers whether they stand.
PAIRS = 1 << 18
SCHEMA = "doc_id long, n_bytes long, width int, steps binary"


class PrefixCounter(Encoder):
    """``counts(texts)``: for each text the token counts of its prefixes of 1, 2, ... characters."""

    def __init__(self, path: str):
        super().__init__(path)
        if not self.by_piece:
            raise ValueError(f"{path}: only byte-level BPE without a normalizer has prefix counts")
        self.dtype, self.kept = np.dtype("<i4"), KEPT
        merge = self.tok.model.tokenize
        self.tokens = ahocorasick.Automaton()
        self.text_of = {}
        for text, i in self.tok.get_vocab(with_added_tokens=False).items():
            if text not in self.added and [t.id for t in merge(text)] == [i]:
                self.tokens.add_word(text, (i, len(text)))
                self.text_of[i] = text
        self.tokens.make_automaton()
        self.stand = lru_cache(PAIRS)(lambda a, b: [t.id for t in merge(self.text_of[a] + self.text_of[b])] == [a, b])
        self.letters = {b: c for b, c in byte_letters().items()}
        self.wholes = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def prefixes(self, piece: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... bytes of a pre-token."""
        text = piece.encode().decode("latin-1").translate(self.letters)
        last, count = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for end, (token, size) in self.tokens.iter(text):
            start = end + 1 - size
            if last[end + 1] < 0 and (not start or last[start] >= 0 and self.stand(last[start], token)):
                last[end + 1], count[end + 1] = token, count[start] + 1
        if piece[0] == "'" and piece[1:] in CONTRACTED:  # before its end: an apostrophe, and letters
            count[2:-1] = range(2, len(count) - 1)
        return np.array(count[1:], "<i4")

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return [self.prefixes(p).tobytes() for p in pieces]

    def _of(self, data: np.ndarray, edges: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Counts by byte of texts that end at ``ends``, cut into pre-tokens at ``edges``. ``runs``: begin and end of the
        stretches of several white characters that something follows, of which each last one stands in another pre-token."""
        cut = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
        spaces = pa.array([data[a:b].tobytes().decode() for a, b in runs], pa.string())
        packed = self._looked_up(pa.concat_arrays([cut, spaces]))
        flat = np.frombuffer(packed.buffers()[2], "<i4")
        within = flat[: len(data)]
        before = np.r_[0, np.cumsum(within[edges[1:] - 1])].astype("<i4")  # of all pre-tokens before each
        text = np.searchsorted(ends, edges[:-1], "right")
        before[:-1] -= np.r_[0, before[np.searchsorted(edges, ends)]][text]
        out = within + np.repeat(before[:-1], np.diff(edges))
        if len(runs):
            at = np.searchsorted(edges, runs[:, 0])
            out[runs[:, 1] - 1] = before[at] + flat[len(data) + np.cumsum(runs[:, 1] - runs[:, 0]) - 1]
        return out

    def counts(self, column: pa.Array) -> list[np.ndarray]:
        column = pa.concat_arrays([column.cast(pa.string())])  # from its first byte on
        ends, data = self._bytes(column)
        kinds = classes(data)
        odd = np.zeros(len(column), bool)
        odd[np.searchsorted(ends, np.flatnonzero(kinds == UNKNOWN), "right")] = True
        if self.wholes:
            odd |= np.array([any(a in t for a in self.added) for t in column.to_pylist()], bool)
        plain = column.filter(pa.array(~odd)) if odd.any() else column
        others = iter([self._odd(t) for t in column.filter(pa.array(odd)).to_pylist()] if odd.any() else [])
        ends, data = self._bytes(pa.concat_arrays([plain]))
        if not len(data):
            tables = iter([np.zeros(0, np.int64)] * len(plain))
        else:
            kinds = classes(data)
            white = kinds <= WHITE
            inside = np.ones(len(data) + 1, bool)
            inside[ends] = inside[0] = False
            begin = np.flatnonzero(white & ~(np.r_[False, white[:-1]] & inside[:-1]))
            stop = np.flatnonzero(white & ~(np.r_[white[1:], False] & inside[1:])) + 1
            keep = (stop - begin > 1) & inside[stop]
            by_byte = self._of(data, borders(data, kinds, ends), ends, np.c_[begin[keep], stop[keep]])
            whole = np.r_[(data[1:] & 0xC0) != 0x80, True]  # a character's last byte
            cut = np.r_[0, np.cumsum(whole)][np.r_[0, ends]]
            by_char = by_byte[whole]
            tables = iter([by_char[a:b] for a, b in zip(cut, cut[1:])])
        return [next(others if x else tables) for x in odd]

    def _odd(self, text: str) -> np.ndarray:
        """As ``counts``, of a text whose pre-tokens the library itself finds."""
        out, base, at = [], 0, 0
        for m in [*(self.wholes.finditer(text) if self.wholes else ()), None]:
            table = self._plain(text[at : m.end() if m else len(text)])  # what stands before an added token, and it as plain text
            if m:
                before = int(table[m.start() - at - 1]) if m.start() > at else 0
                table[-1] = before + 1
            out.append(base + table)
            base += int(table[-1]) if len(table) else 0
            at = m.end() if m else len(text)
        return np.concatenate(out)

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        size = np.r_[0, np.cumsum([len(c.encode()) for c in text])]
        edges = size[np.r_[0, [b for _, (_, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]]]
        runs = [(size[m.start()], size[m.end()]) for m in regex.finditer(r"\s{2,}(?=\S)", text)]
        data = np.frombuffer(text.encode(), np.uint8)
        return self._of(data, edges, np.array([len(data)]), np.array(runs, np.int64).reshape(-1, 2))[size[1:] - 1]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, n_bytes of the text, and ``steps``: for each character, what it adds to the token count of
    the prefix that it ends, as signed little-endian integers of ``width`` bytes.

    One pass without a shuffle, linear in a text's length; memory follows the longest text. Null texts are empty and have
    no steps. Repeated rows and null ids are rows of their own; other columns, whatever their names, are left out; an empty
    table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in groups(batches, size=GROUP):
            steps = [np.diff(t, prepend=0) for t in c.counts(b.column(1))]
            width = [1 if not len(s) or -128 <= s.min() and s.max() < 128 else 4 for s in steps]
            packed = pa.array([s.astype(f"<i{w}").tobytes() for s, w in zip(steps, width)], pa.binary())
            size = pa.array([len(t.as_buffer()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(width, pa.int32()), packed], names=["doc_id", "n_bytes", "width", "steps"])

    return text_rows(docs, id_col, text_col).mapInArrow(count, SCHEMA)


def counts_of(steps: bytes, width: int) -> np.ndarray:
    """The counts of a stored row: of the prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)


def budgets(table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """From ``prefix_table``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) and kept_chars, the length
    of the longest prefix of at most ``limit`` tokens. An empty text has 0 tokens and keeps 0 characters."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kept = [], []
            for width, steps in zip(b.column(2).to_pylist(), b.column(3)):
                c = counts_of(steps.as_buffer(), width)
                n.append(int(c[-1]) if len(c) else 0)
                within = len(c) if n[-1] <= limit else int(np.flatnonzero(np.r_[0, c] <= limit)[-1])
                kept.append(within)
            over = [x > limit for x in n]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(over, pa.bool_()), pa.array(kept, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    return table.select("doc_id", "n_bytes", "width", "steps").mapInArrow(answer, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")
