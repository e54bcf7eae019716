"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's residual to the centre is rotated and each coordinate kept as one bit, with two scalars: its length, and the
inner product of its direction with its code, which turns the code's inner product with a rotated query into an unbiased
estimate and bounds that estimate's error. Queries are rotated too and quantised to PLANES bits a coordinate, so an inner
product is a weighted sum of the bits that a code and each of the query's bit planes share, counted on packed words. A vector
is compared exactly if the lower bound of its distance doesn't exceed the query's k-th smallest exact distance so far in that
task; vectors lie beside their codes, so that no candidate is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Standard errors that the bounds allow for; each side fails with a probability of about 2 exp(-EPS^2 / 2).
EPS = 3.0
#: Bits of a query's quantised coordinates.
PLANES = 4
#: Bytes of query vectors of a pass over the index, and queries and vectors whose estimates are held at once.
BLOCK, TOGETHER, CHUNK = 32 << 20, 2048, 512


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part: not null, not zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of unsigned 64-bit words, the last filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


class Quantised:
    """Unit queries whose inner products with codes are estimated from packed bits."""

    def __init__(self, units: np.ndarray):
        self.d = units.shape[1]
        self.low = units.min(1)
        self.step = np.maximum((units.max(1) - self.low) / ((1 << PLANES) - 1), 1e-30)
        levels = np.rint((units - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [packed_words(levels >> j & 1) for j in range(PLANES)]
        self.total = self.d * self.low + self.step * levels.sum(1)

    def dots(self, codes: np.ndarray) -> np.ndarray:
        """Inner products (queries by codes) with the codes' unit sign vectors, from packed words of their bits."""
        shared = np.zeros((len(self.low), len(codes)), np.int32)
        for j, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                shared += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << j
        ones = np.bitwise_count(codes).sum(1, dtype=np.int32)
        positive = self.low[:, None] * ones + self.step[:, None] * shared
        return (2 * positive - self.total[:, None]) / np.sqrt(self.d)


def index(rows: DataFrame, seed: int = 11) -> tuple[DataFrame, np.ndarray]:
    """The index, written to the shared folder, and its centre (the mean of all vectors).

    A row a vector (of one dimension): vec_id, code (packed words), length of the residual, factor (its direction's inner
    product with its code's), the vector itself for exact comparison, and row, its own number.
    """
    d = len(first.vector) if (first := rows.first()) else 1
    sums = rows.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col").alias("m")).collect()  # a row a dimension
    centre = np.zeros(d)
    for r in sums:
        centre[r.pos] = r.m
    turn = rotation(d, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            o = (_matrix(b.column(1), d) - centre) @ turn
            length = np.sqrt((o * o).sum(1))
            o /= np.where(length > 0, length, 1)[:, None]
            code = packed_words(o > 0)
            factor = np.abs(o).sum(1) / np.sqrt(d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(factor), b.column(1)], names=["vec_id", "code", "length", "factor", "vector"])

    codes = rows.mapInArrow(encode, "vec_id long, code binary, length double, factor double, vector array<double>")
    return written(codes.withColumn("row", F.monotonically_increasing_id()), "codes"), centre


class _Nearest:
    """A few queries and the k nearest that they have met. ``own``: the rows that the queries are."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, rotated: np.ndarray, k: int):
        self.own, self.queries, self.k, self.n = own, queries, k, len(own)
        self.reach = np.sqrt((rotated * rotated).sum(1))
        self.q = Quantised(rotated / np.where(self.reach > 0, self.reach, 1)[:, None])
        self.rounding = (self.q.step**2 / 6)[:, None]  # the variance that quantising a query adds
        self.best, self.names = np.full((self.n, k), np.inf), np.full((self.n, k), np.iinfo(np.int64).max)

    def add(self, qi: np.ndarray, at: np.ndarray, vec: np.ndarray, vid: np.ndarray, row: np.ndarray) -> None:
        """Exact distances of these pairs into the queries' best."""
        n, k = self.n, self.k
        for one in range(0, len(qi), 100_000):
            a, b = qi[one : one + 100_000], at[one : one + 100_000]
            dist = np.sqrt(((self.queries[a] - vec[b]) ** 2).sum(1))
            own = self.own[a] == row[b]
            a, b, dist = a[~own], b[~own], dist[~own]
            order = np.lexsort((vid[b], dist, a))
            a, b, dist = a[order], b[order], dist[order]
            heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
            place = np.arange(len(a)) - np.repeat(heads, np.diff(np.r_[heads, len(a)]))
            a, b, dist, place = a[place < k], b[place < k], dist[place < k], place[place < k]
            rows = np.unique(a)
            more, who = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
            more[a, place], who[a, place] = dist, vid[b]
            both, each = np.hstack([self.best[rows], more[rows]]), np.hstack([self.names[rows], who[rows]])
            order = np.lexsort((each, both), axis=1)[:, :k]
            self.best[rows], self.names[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(each, order, 1)

    def meet(self, vid: np.ndarray, row: np.ndarray, vec: np.ndarray, codes: np.ndarray, length: np.ndarray, factor: np.ndarray) -> None:
        d, reach = vec.shape[1], self.reach[:, None]
        dot = self.q.dots(codes) / factor
        err = EPS * np.sqrt(np.maximum(1 - factor**2, 0) / max(1, d - 1) + self.rounding) / factor
        low = reach**2 + length**2 - 2 * reach * length * np.minimum(dot + err, 1)
        slack = 1e-9 * (reach**2 + length**2)
        if np.isinf(self.best[:, -1]).any():  # first the likeliest, for a limit to begin with
            near = np.argpartition(low, min(2 * self.k, len(vid) - 1), axis=1)[:, : 2 * self.k]
            self.add(np.repeat(np.arange(self.n), near.shape[1]), near.ravel(), vec, vid, row)
            np.put_along_axis(low, near, np.inf, 1)
        qi, at = np.nonzero(low - slack <= self.best[:, -1:] ** 2)
        self.add(qi, at, vec, vid, row)


def _scan(own: np.ndarray, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int, seed: int):
    """What a task does with its part of the index for one block of queries: each query's k nearest of the part."""
    d = queries.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotated = (queries - centre) @ rotation(d, seed)
        parts = [_Nearest(own[i : i + TOGETHER], queries[i : i + TOGETHER], rotated[i : i + TOGETHER], k) for i in range(0, len(own), TOGETHER)]
        for batch in batches:
            for one in range(0, batch.num_rows, CHUNK):
                b = batch.slice(one, CHUNK)
                vid, row, vec = b.column("vec_id").to_numpy(), b.column("row").to_numpy(), _matrix(b.column("vector"), d)
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), "<u8").reshape(len(vid), -1)
                for p in parts:
                    p.meet(vid, row, vec, codes, b.column("length").to_numpy(), np.maximum(b.column("factor").to_numpy(), 1e-9))
        for i, p in enumerate(parts):
            qi, at = np.nonzero(np.isfinite(p.best))
            yield pa.RecordBatch.from_arrays([pa.array(p.own[qi]), pa.array(ids[i * TOGETHER + qi]), pa.array(p.names[qi, at]), pa.array(p.best[qi, at])], names=["row", "query_id", "vec_id", "score"])

    return scan


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision) of each query's ``k`` nearest.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of their dimension but the query's own.
    Queries pass over the index in blocks of about BLOCK bytes, of which the driver holds one at a time. Each task returns k
    rows a query, so what is ranked in the end follows the number of tasks. Ties go to the smaller id; rows that repeat an id
    are candidates, and queries, of their own (with as many rows each); a table without usable vectors gives no rows.
    """
    spark, schema = vectors.sparkSession, "row long, query_id long, vec_id long, score double"
    every_row = usable(vectors, id_col, vector_col)
    out, ran = shared_dir(spark, "neighbours"), False
    for size in every_row.groupBy(F.size("vector").alias("d")).agg(F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("n")).orderBy("d").collect():  # a row a dimension
        if not size.n:
            continue
        codes, centre = index(every_row.where(F.size("vector") == size.d), seed)
        queries = codes.where(F.col("vec_id") % every == 0)
        blocks = -(-size.n * size.d * 8 // BLOCK)
        for block in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "vec_id", "vector").collect()  # about BLOCK bytes
            if rows:
                own, ids, q = np.array([r.row for r in rows]), np.array([r.vec_id for r in rows]), np.array([r.vector for r in rows])
                found = codes.mapInArrow(_scan(own, ids, q, centre, k, seed), schema)
                found.withColumn("row", F.concat_ws("/", F.lit(size.d), "row")).write.mode("append").parquet(out)
                ran = True
    schema = schema.replace("row long", "row string")
    found = spark.read.schema(schema).parquet(out) if ran else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
