"""Token-ID output: flat unsigned-integer files with 64-bit document offsets, read back through a memory map.

Format of a folder: for each shard ``<stem>.ids`` (flat little-endian unsigned ids, 2 bytes each if the vocabulary fits,
else 4), ``<stem>.off`` (n+1 little-endian uint64, ids before each document within the shard), ``<stem>.doc`` (n
little-endian int64 document ids) and ``<stem>.nul`` (n flags of one byte, 1 where the document id is null). A shard's base, the ids of all shards before it, is a
prefix sum over the shards' counts, kept in the manifest table. Shards and the documents in them ascend by doc_id, nulls
first, repeated ids by text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, text_rows
from .tokenizing import encoder


#: Bytes of text of a shard, about, and documents that are written or read at once.
SHARD, TOGETHER = 1 << 30, 4096
FILES = ("ids", "off", "doc", "nul")


@dataclass(frozen=True)
class Shard:
    stem: str
    n_docs: int
    n_ids: int
    base: int


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    width: int
    shards: tuple[Shard, ...]

    @property
    def n_ids(self) -> int:
        return sum(s.n_ids for s in self.shards)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write the shards; each task writes one shard, streaming all its files.

    There are ``shards`` shards, or as many as the session has shuffle partitions, and more where they would have above SHARD
    bytes of text. Null texts are empty: one id, the end. Null doc_ids come first; repeated ids are ordered by their text.
    Very long texts are encoded whole; other columns, whatever their names, are left out. An empty table gives no shards. A
    task that runs twice writes under another attempt's name, and only the names of tasks that succeeded enter the manifest.
    """
    spark = docs.sparkSession
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        shards = max(partitions(spark), -(-size // SHARD))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fs, root = encoder(vocabulary), *_fs(folder)
        end = np.array([end_id], enc.dtype).tobytes()
        fs.create_dir(root, recursive=True)
        at = TaskContext.get()
        stem = f"shard-{at.partitionId():06d}-{at.taskAttemptId()}"
        n_ids, n_docs = 0, 0
        with ExitStack() as opened:
            ids, off, doc, nul = (opened.enter_context(fs.open_output_stream(f"{root}/{stem}.{f}")) for f in FILES)
            off.write(np.zeros(1, "<u8").tobytes())
            for b in batches:
                for one in range(0, b.num_rows, TOGETHER):
                    part = b.slice(one, TOGETHER)
                    packed = enc.encode(part.column(1))
                    ids.write(end.join(packed) + end)
                    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // enc.width + 1
                    off.write((n_ids + np.cumsum(sizes)).astype("<u8").tobytes())
                    doc.write(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    nul.write(part.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                    n_ids += int(sizes.sum())
                    n_docs += part.num_rows
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [at.partitionId()], "stem": [stem], "n_docs": [n_docs], "n_ids": [n_ids], "width": [enc.width]})
        else:
            for f in FILES:
                fs.delete_file(f"{root}/{stem}.{f}")

    rows = (
        text_rows(docs, id_col, text_col)
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "part long, stem string, n_docs long, n_ids long, width long")
        .collect()  # one row a shard
    )
    base, found = 0, []
    for r in sorted(rows, key=lambda r: r.part):
        found.append(Shard(r.stem, r.n_docs, r.n_ids, base))
        base += r.n_ids
    return TokenFiles(folder, rows[0].width if rows else 2, tuple(found))


class Flat:
    """A flat file of equal items, of which ranges are read: through a memory map where the file system can."""

    def __init__(self, folder: str, stem: str, end: str, dtype: str):
        fs, root = _fs(folder)
        path, self.dtype = f"{root}/{stem}.{end}", np.dtype(dtype)
        self.mapped = np.memmap(path, self.dtype, "r") if isinstance(fs, pafs.LocalFileSystem) else None
        self.file = None if self.mapped is not None else fs.open_input_file(path)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[at]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(width * (at.stop - at.start), width * at.start), self.dtype)


def open_shard(folder: str, stem: str, width: int) -> tuple[Flat, Flat, Flat, Flat]:
    """Ids, offsets, document ids and null flags of a shard."""
    return tuple(Flat(folder, stem, end, dtype) for end, dtype in zip(FILES, (f"<u{width}", "<u8", "<i8", "u1")))


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document, from the files: doc_id (null where it was), start, n_tokens (with the end id) and ids_crc32; a task a
    shard, which reads ranges of it. Documents without text have one id; repeated ids are rows of their own; no shards give
    no rows."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files.shards:
        return spark.createDataFrame([], schema)
    folder, width = files.folder, files.width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, n_docs, base in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids, offsets, doc, null = open_shard(folder, stem, width)
                for one in range(0, n_docs, TOGETHER):
                    end = min(n_docs, one + TOGETHER)
                    off = offsets[one : end + 1].astype(np.int64)
                    wide = np.asarray(ids[int(off[0]) : int(off[-1])], "<u4")
                    at = (off - off[0]).tolist()
                    crc = [zlib.crc32(wide[i:j]) for i, j in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(doc[one:end]), pa.int64(), mask=np.array(null[one:end], bool)), pa.array(base + off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    rows = [(s.stem, s.n_docs, s.base) for s in files.shards]
    n = max(1, min(len(rows), partitions(spark)))
    table = spark.createDataFrame(rows, "stem string, n_docs long, base long").repartition(n)
    return table.mapInArrow(read, schema)
