"""Best-fit packing by sum of squares: each piece goes where the squared counts of open bins per residual gap, summed, become smallest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows, written
from .tokenizing import encoder

LEFT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first, and each bin's gap.

    Ties go to the smallest gap, then to a new bin last; within a gap, to the bin that got it last.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    counts = np.zeros(capacity + 1, np.int64)  # of open bins by gap; counts[0] stays 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gap_of: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        new = 1 + 2 * counts[capacity - s] if s < capacity else 0
        here, after = counts[s:], counts[: capacity + 1 - s]
        change = 2 * (after - here) + 2
        change[0] -= 1  # a bin that closes leaves no square
        change[here == 0] = 1 << 40
        k = int(change.argmin())
        if change[k] <= new:
            gap = s + k
            b = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, len(gap_of)
            gap_of.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gap_of[b] = gap - s
        if gap > s:
            counts[gap - s] += 1
            stacks[gap - s].append(b)
    return bins, offsets, np.array(gap_of, np.int64)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", rows: int = 16_384) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; a row a piece, in the columns of LEFT.

    Each task encodes its rows and packs their pieces; sequences with a gap then are opened again and their pieces packed
    once more, about ``rows`` of them together, dealt by their sequence's number: as many teams as there are pieces for, so
    that none grows with the table. Null texts are empty (the end id alone); very long texts are cut; repeated rows are
    packed each on its own; of equal lengths the earlier row comes first; an empty table gives no rows.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        found: list[list] = [[] for _ in range(5)]
        for b in batches:
            for one in range(0, b.num_rows, 4096):
                ids = b.column(0).slice(one, 4096).to_pylist()
                for doc, packed in zip(ids, enc.encode(b.column(1).slice(one, 4096))):
                    wide = np.frombuffer(packed + end, enc.dtype).astype("<u4")
                    for k, (s, n) in enumerate(pieces_of(len(wide), capacity)):
                        for column, x in zip(found, (doc, k, s, n, zlib.crc32(wide[s : s + n]))):
                            column.append(x)
        if not found[0]:
            return
        doc, piece, start, length, crc = found
        bins, offsets, gaps = sum_of_squares(np.array(length, np.int64), capacity)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array((part << 32) + bins), pa.array(offsets), pa.array(gaps[bins] > 0)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"],
        )

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        bins, offsets, _ = sum_of_squares(pdf["length"].to_numpy(), capacity)
        # ids of the second round count down from -1, apart from those of the first
        return pdf.assign(sequence_id=-1 - ((pdf["team"].to_numpy() << 40) + bins), offset=offsets).drop(columns="team")

    first = written(text_rows(docs, id_col, text_col).mapInArrow(local, f"{LEFT}, open boolean"), "packed")
    done, opened = first.where(~F.col("open")).drop("open"), first.where("open").drop("open")
    teams = max(1, -(-opened.count() // rows))
    dealt = opened.withColumn("team", F.pmod(F.xxhash64("sequence_id"), F.lit(teams)))
    return done.unionByName(dealt.groupBy("team").applyInPandas(again, LEFT))
