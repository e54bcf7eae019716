"""Encoding whole texts with a public tokenizer file of the tokenizers library.

A byte-level BPE without normalizer encodes pre-tokens independently. The borders between those of a group of texts are
found on its UTF-8 bytes at once; the pieces between them are looked up in a bounded Arrow table of encoded ones, and the
library's model encodes each distinct new piece. Texts with characters outside the tables of classes below, texts that
contain an added token such as ``<|endoftext|>``, and all other tokenizers, are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of characters: the space, other white space, letters, digits, all else, and those that aren't in the tables.
SPACE, WHITE, LETTER, DIGIT, OTHER, UNKNOWN = range(6)
#: Beyond ASCII, letters are U+00C0-U+024F without U+00D7 and U+00F7; the characters here are neither letters, digits nor white space.
SYMBOLS = "×÷¡¢£¤¥¦§¨©«¬­®¯°±´¶·¸»¿–—‘’“”…€"
#: Contractions that are pieces of their own, without the apostrophe.
CONTRACTED = ("s", "t", "m", "d", "re", "ve", "ll")
#: Bytes of encoded pieces that a worker keeps, with their ids; bytes of text of a group.
KEPT, GROUP = 48 << 20, 8 << 20


def _class(c: str) -> int:
    if c in SYMBOLS:
        return OTHER
    if "À" <= c <= "ɏ" or c.isascii() and c.isalpha():
        return LETTER
    if not "\x20" <= c < "\x7f":
        return WHITE if "\t" <= c <= "\r" else UNKNOWN
    return SPACE if c == " " else DIGIT if c.isdigit() else OTHER


#: Classes of single bytes (those beyond ASCII are set from the tables of two and three bytes).
_ONE = np.array([_class(chr(b)) if b < 128 else UNKNOWN for b in range(256)], np.uint8)
_TWO = np.full(1 << 16, UNKNOWN, np.uint8)
for _c in map(chr, range(128, 0x800)):
    _TWO[int.from_bytes(_c.encode(), "big")] = _class(_c)
_THREE = np.array([int.from_bytes(c.encode(), "big") for c in SYMBOLS if len(c.encode()) == 3])


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on, in order."""
    plain = {b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text belongs to."""
    out = _ONE[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        at = lead[data[lead] < 0xE0]
        out[at] = out[at + 1] = _TWO[data[at].astype(np.int64) << 8 | data[at + 1]]
        at = lead[data[lead] == 0xE2]
        at = at[np.isin(data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2], _THREE)]
        out[at] = out[at + 1] = out[at + 2] = OTHER
    return out


def borders(data: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts of known classes that end at ``ends``, and the end of the last.

    Pieces are runs of a class, with a space before them if there is one; contractions; and white space, of which a run
    before other characters leaves its last one apart.
    """
    n = len(data)
    kind = np.maximum(kinds, WHITE)
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[ends] = True
    inside = np.ones(n + 1, bool)  # whether a byte belongs to the text of the one before
    inside[ends] = inside[0] = False
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & inside[1:n])
    edge[last] = True
    edge[last[kinds[last] == SPACE] + 1] = False
    apostrophe = np.flatnonzero(data == 0x27)
    for letters in CONTRACTED:
        at = apostrophe[apostrophe + len(letters) < n]
        at = at[edge[at]]
        for i, c in enumerate(letters, 1):
            at = at[(data[at + i] == ord(c)) & inside[at + i]]
        edge[at + 1] = False
        edge[at + 1 + len(letters)] = True
    return np.flatnonzero(edge)


class Encoder:
    """``encode(texts)`` gives for each text its ids as packed little-endian bytes of ``width`` bytes an id."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.by_piece = (
            sys.byteorder == "little"
            and spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
        )
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.width, self.kept = self.dtype.itemsize, kept
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Each a pre-token of its own, so the library's model alone is asked, without borders and offsets."""
        merge, letters, code = self.tok.model.tokenize, byte_letters(), "H" if self.width == 2 else "I"
        space = letters[32]  # all other printable ASCII stands for itself
        bytewise = (p.replace(" ", space) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters) for p in pieces)
        return [array(code, [t.id for t in merge(p)]).tobytes() for p in bytewise]

    def _looked_up(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece. Beyond its bound the table is cut down to the pieces of the group."""
        at = pc.index_in(pieces, value_set=self.known)
        if at.null_count:
            new = pc.unique(pieces.filter(at.is_null()))
            encoded = pa.array(self._pieces(new.to_pylist()), pa.large_binary())
            if self.known.nbytes + self.ids.nbytes > self.kept:
                used = pc.unique(at.drop_null())
                self.known, self.ids = self.known.take(used), self.ids.take(used)
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, encoded])
            at = pc.index_in(pieces, value_set=self.known)
        return self.ids.take(at)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Encoded in groups of about GROUP bytes, so that memory doesn't follow the batch."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        out: list[bytes] = []
        size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        while len(out) < len(column):
            at = len(out)
            end = max(at + 1, int(np.searchsorted(size, GROUP + (size[at - 1] if at else 0))))
            out += self._group(pa.concat_arrays([column.slice(at, end - at)]))
        return out

    def _group(self, column: pa.Array) -> list[bytes]:
        if not self.by_piece:
            return self._whole(column.to_pylist())
        ends, data = self._bytes(column)
        kinds = classes(data)
        odd = np.zeros(len(column), bool)
        odd[np.searchsorted(ends, np.flatnonzero(kinds == UNKNOWN), "right")] = True
        for token in self.added:
            odd |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if odd.any():
            rest = iter(self._group(column.filter(pa.array(~odd))) if not odd.all() else ())
            whole = iter(self._whole(column.filter(pa.array(odd)).to_pylist()))
            return [next(whole if x else rest) for x in odd]
        if not len(data):
            return [b""] * len(column)
        edges = borders(data, kinds, ends)
        pieces = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data))
        packed = self._looked_up(pieces)
        cut = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1)[np.searchsorted(edges, np.r_[0, ends])].tolist()
        view = memoryview(packed.buffers()[2])
        return [view[i:j].tobytes() for i, j in zip(cut, cut[1:])]

    @staticmethod
    def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text ends, and all texts' UTF-8 bytes."""
        _, offsets, data = column.cast(pa.string()).buffers()
        at = np.frombuffer(offsets, np.int32)[: len(column) + 1].astype(np.int64)
        return at[1:] - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file of this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
