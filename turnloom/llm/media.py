"""MPEG audio as a media column: a lossless carrier for bytes, and a reader of any MPEG audio stream.

The carrier is a valid variable-bitrate MPEG-1 Layer III file of silence: an ID3v2 tag, a frame with a Xing table, then
checksummed mono frames at 48 kHz whose side information is zero (so the decoder plays silence) and whose ancillary data
are the payload; the last frame has the smallest bitrate that holds the rest. The reader knows nothing of this: it parses
tags and Xing, Info and VBRI tables, walks frame headers of all versions and layers, resynchronises after damage, verifies
checksums, and keeps exact durations (samples and rate) and every frame's offset for seeking.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_rows, written

#: Fixed values of the format: kbit/s by index 1 to 14, for (MPEG-1 or not, layer); Hz by index, MPEG-1.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: Fixed values of the format: Layer II's bits an allocation, as runs of (subbands, bits): few bits a channel at 44.1 or 48 kHz
#: and at 32 kHz, middling ones, many ones, and the lower sampling rates of MPEG-2 and 2.5.
ALLOCATIONS = {"few": ((2, 4), (6, 3)), "few32": ((2, 4), (10, 3)), "some": ((11, 4), (12, 3), (4, 2)), "many": ((11, 4), (12, 3), (7, 2)), "low": ((4, 4), (7, 3), (19, 2))}
#: Bytes before the payload in a carrier frame: header, checksum, mono side information.
HEAD, SIDE = 6, 17
UNIT, FILL = 576, 255


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        table.append(c)
    return table


_CRC = _crc_table()


def crc16(data: bytes, c: int = 0xFFFF) -> int:
    for b in data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    return c


def _bits_crc(data: bytes, bits: int, c: int) -> int:
    """The checksum over the first bits of some bytes."""
    c = crc16(data[: bits // 8], c)
    for i in range(bits % 8):
        top = (c >> 15) ^ (data[bits // 8] >> (7 - i) & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    rate: int
    kbps: int
    length: int
    samples: int
    protected: bool
    side: int  # bytes of side information that the checksum covers (Layer III)


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The meaning of a frame header; None if it is none (or of free format)."""
    if four in _HEADERS:
        return _HEADERS[four]
    h = int.from_bytes(four, "big")
    version, layer = {3: "1", 2: "2", 0: "2.5"}.get(h >> 19 & 3), 4 - (h >> 17 & 3)
    rate, bits, mono = h >> 10 & 3, h >> 12 & 15, h >> 6 & 3 == 3
    found = None
    if len(four) == 4 and h >> 21 == 0x7FF and version and layer < 4 and rate < 3 and 0 < bits < 15:
        first = version == "1"
        hz = RATES[rate] >> {"1": 0, "2": 1, "2.5": 2}[version]
        kbps = BITRATES[first, layer][bits - 1]
        samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
        pad = h >> 9 & 1
        length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
        side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else 0
        found = Header(version, layer, hz, kbps, length, samples, not h >> 16 & 1, side)
    if len(_HEADERS) < 4096:
        _HEADERS[four] = found
    return found


@dataclass
class Audio:
    """What a stream holds; ``offsets`` are the seek table, a byte offset a frame of sound."""

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    checked: int = 0
    bad_checksums: int = 0
    skipped: int = 0  # bytes passed over to find a header again
    tags: dict[str, str] = field(default_factory=dict)
    table: tuple[str, int, int, bytes] | None = None  # kind, frames, bytes, seek points
    kbps: set[int] = field(default_factory=set)
    kind: str = ""

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.rate or 1)

    @property
    def feature(self) -> str:
        seek = zlib.crc32(np.array(self.offsets, "<u8").tobytes())
        table = f"{self.table[0]}:{self.table[1]}:{self.table[2]}:{zlib.crc32(self.table[3])}" if self.table else "-"
        d = self.duration
        return f"{self.kind};hz={self.rate};frames={len(self.offsets)};samples={self.samples};seconds={d.numerator}/{d.denominator};kbps={'/'.join(map(str, sorted(self.kbps)))};checked={self.checked};bad={self.bad_checksums};skipped={self.skipped};table={table};seek={seek:08x}"


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Where sound begins and ends, and the text frames of ID3v2 and ID3v1 tags."""
    at, end, tags = 0, len(data), {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = _syncsafe(data[at + 6 : at + 10])
        p, stop, four = at + 10, at + 10 + size, data[at + 3] == 4
        while p + 10 <= stop and data[p : p + 1].isalpha():
            n = _syncsafe(data[p + 4 : p + 8]) if four else int.from_bytes(data[p + 4 : p + 8], "big")
            if data[p : p + 1] == b"T" and n:
                tags[data[p : p + 4].decode("latin-1")] = data[p + 11 : p + 10 + n].decode("latin-1")
            p += 10 + n
        at = stop + 10 * bool(data[at + 5] & 16)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    return min(at, end), end, tags


def _table(data: bytes, at: int, h: Header) -> tuple[str, int, int, bytes] | None:
    """A Xing, Info or VBRI table in the frame at ``at``."""
    p = at + 4 + 2 * h.protected + h.side
    if (kind := data[p : p + 4]) in (b"Xing", b"Info"):
        flags, p, values = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, []
        for bit, n in ((1, 4), (2, 4), (4, 100)):
            values.append(data[p : p + n] if flags & bit else b"")
            p += n * bool(flags & bit)
        return kind.decode(), int.from_bytes(values[0], "big"), int.from_bytes(values[1], "big"), values[2]
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        points, size = int.from_bytes(data[p + 18 : p + 20], "big"), int.from_bytes(data[p + 22 : p + 24], "big")
        return "VBRI", int.from_bytes(data[p + 14 : p + 18], "big"), int.from_bytes(data[p + 10 : p + 14], "big"), data[p + 26 : p + 26 + points * size]
    return None


def _allocation_bits(four: bytes, h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers in Layers I and II: the subbands' allocations (from the bound on, joint
    stereo has one for both channels), and in Layer II two more for each channel's subband that has bits."""
    mode, extension = four[3] >> 6, four[3] >> 4 & 3
    channels, bound = (1 if mode == 3 else 2), (4 + 4 * extension if mode == 1 else 32)
    if h.layer == 1:
        return 4 * (channels * bound + 32 - bound)
    each = h.kbps // channels
    kind = "low" if h.version != "1" else ("few32" if h.rate == 32000 else "few") if each <= 48 else "some" if each <= 80 or h.rate == 48000 else "many"
    widths = [w for n, w in ALLOCATIONS[kind] for _ in range(n)]
    value, size = int.from_bytes(body[:64], "big"), 8 * len(body[:64])
    at = chosen = 0
    for band, w in enumerate(widths):
        apart = channels if band < bound else 1
        for _ in range(apart):
            at += w
            if at <= size and value >> (size - at) & ((1 << w) - 1):
                chosen += channels // apart
    return at + 2 * chosen


def _sound(data: bytes, at: int, h: Header, checks: dict[bytes, int]) -> bool | None:
    """Whether a frame's checksum holds; None if it has none. A frame too short for what is covered is damaged."""
    if not h.protected:
        return None
    if h.layer != 3:
        four, body = data[at : at + 4], data[at + 6 : at + h.length]
        bits = _allocation_bits(four, h, body)
        return bits <= 8 * len(body) and _bits_crc(body, bits, crc16(four[2:])) == data[at + 4] << 8 | data[at + 5]
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
    c = checks.get(covered)
    if c is None:
        c = crc16(covered)
        if len(checks) < 4096:
            checks[covered] = c
    return c == data[at + 4] << 8 | data[at + 5]


def _resync(data: bytes, at: int, end: int) -> int:
    """The next offset at which a frame stands whose checksum isn't wrong and which another frame, or the end, follows."""
    while 0 <= (at := data.find(b"\xff", at, end)) < end:
        h = header(data[at : at + 4])
        if h and at + h.length <= end and _sound(data, at, h, {}) is not False:
            after = header(data[at + h.length : at + h.length + 4])
            if at + h.length == end or after and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate):
                return at
        at += 1
    return end


def parse(data: bytes) -> Audio:
    """Walk a stream. An empty one, or one without a frame, has no frames, no samples and rate 0."""
    a = Audio()
    at, end, a.tags = _tags(data)
    checks: dict[bytes, int] = {}
    first = True
    while at < end:
        h = header(data[at : at + 4])
        if not h or at + h.length > end:
            on = _resync(data, at + 1, end)
            a.skipped += on - at
            at = on
            continue
        ok = _sound(data, at, h, checks)
        if first:
            first, a.rate, a.kind = False, h.rate, f"mpeg{h.version}-layer{h.layer}"
            if (t := _table(data, at, h)) is not None:
                a.table = t
                at += h.length
                continue
        a.checked += ok is not None
        a.bad_checksums += ok is False
        a.offsets.append(at)
        a.samples += h.samples
        a.kbps.add(h.kbps)
        at += h.length
    return a


def _frame_head(kbps: int) -> bytes:
    """Header, checksum and silent side information of a protected mono MPEG-1 Layer III frame at 48 kHz."""
    four = bytes((0xFF, 0xFA, (BITRATES[True, 3].index(kbps) + 1) << 4 | 1 << 2, 0xC0))
    side = bytes(SIDE)
    return four + crc16(four[2:] + side).to_bytes(2, "big") + side


_HEADS = {k: _frame_head(k) for k in BITRATES[True, 3]}


def padded(text: bytes) -> bytes:
    return text + bytes((FILL,)) * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def carry(payload: bytes) -> bytes:
    """The stream that carries a payload."""
    most = 320
    room = 3 * most - HEAD - SIDE
    full, rest = divmod(len(payload), room)
    body = np.empty((full, 3 * most), np.uint8)
    body[:, : HEAD + SIDE] = np.frombuffer(_HEADS[most], np.uint8)
    body[:, HEAD + SIDE :] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    last = b""
    if rest:
        kbps = next(k for k in BITRATES[True, 3] if 3 * k - HEAD - SIDE >= rest)
        last = (_HEADS[kbps] + payload[full * room :]).ljust(3 * kbps, b"\0")
    sound = body.tobytes() + last
    frames = full + bool(rest)
    told = f"payload\0{len(payload)}".encode()
    frame = b"TXXX" + (len(told) + 1).to_bytes(4, "big") + b"\0\0\0" + told
    n = len(frame)
    tag = b"ID3\3\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frame
    points = bytes(min(255, 256 * (i * frames // 100) * 3 * most // max(1, len(sound))) for i in range(100))
    table = (_HEADS[64] + b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + (len(sound) + 3 * 64).to_bytes(4, "big") + points).ljust(3 * 64, b"\0")
    return tag + table + sound


def carried(data: bytes, a: Audio | None = None) -> bytes:
    """The payload of a carrier stream, from its frames' ancillary data; a damaged one raises ValueError."""
    a = a or parse(data)
    if a.bad_checksums or a.skipped or not a.table or a.table[1] != len(a.offsets):
        raise ValueError("damaged stream")
    view = memoryview(data)
    parts = [view[o + HEAD + SIDE : o + header(data[o : o + 4]).length] for o in a.offsets]
    return b"".join(parts)[: int(a.tags["TXXX"].rpartition("\0")[2])]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media (the carrier of the text's padded UTF-8 bytes) and its index: samples and rate, whose ratio is the exact
    duration, and seek_offsets (where each frame begins); written to the shared folder. Null texts are empty; null ids stay;
    very long texts are carried whole; repeated rows stay; an empty table gives no rows; other columns aren't read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in range(0, b.num_rows, 256):
                part = b.slice(one, 256)
                media = [carry(padded(t.as_py().encode())) for t in part.column(1)]
                found = [parse(m) for m in media]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(media, pa.binary()), pa.array([a.samples for a in found], pa.int64()), pa.array([a.rate for a in found], pa.int64()), pa.array([a.offsets for a in found], pa.list_(pa.int64()))],
                    names=["doc_id", "media", "samples", "rate", "seek_offsets"],
                )

    return written(text_rows(docs, id_col, text_col).mapInArrow(encode, "doc_id long, media binary, samples long, rate long, seek_offsets array<long>"), "media")


def features(media: DataFrame) -> DataFrame:
    """Per stored stream: digests of the payload read back and of the stored form, what the reader found, the stored index
    and whether the reader found the same. Damaged streams are an error; an empty table gives no rows; repeated rows stay."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, rate long, seek_offsets array<long>, index_ok boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            index = zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))
            for m, (samples, rate, offsets) in zip(b.column(1), index):
                data = m.as_py()
                a = parse(data)
                p = carried(data, a)
                rows.append((len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(), a.feature, samples, rate, offsets, (samples, rate, offsets) == (a.samples, a.rate, list(a.offsets))))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 11, types))], names=names)

    return media.select("doc_id", "media", "samples", "rate", "seek_offsets").mapInArrow(read, schema)
