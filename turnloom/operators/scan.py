"""Searches as one scan of the corpus for a block of queries: cosines, BM25 scores, or both side by side.

Documents stay in their task, as vectors and as postings (distinct tokens and how often). A block of queries, bounded in rows
and tokens, goes to all tasks; a task multiplies matrices, or adds up what the tokens of its documents give to the queries
that have them (one product of matrices for the common ones, pair by pair for the rest), and returns each query's first k, and sums over all its candidates where they are asked for. So no pair of a
query and a document is ever shuffled, and a token that is in every document stays where the documents are. Where BM25 alone
is asked for, a chunk of documents is left out for the queries of which the sum of its largest impacts (a bound of every score
in it) is below the k-th score so far. Blocks are run one after the other, each one's result written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..shared import shared_dir, written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries and tokens of queries of a block, and documents of a chunk, of which there are fewer if a block has many queries.
ROWS, TERMS, CHUNK, CELLS = 2048, 1 << 20, 1024, 1 << 20
#: Common tokens of a block that may be multiplied, the share of a chunk's pairs that such a token has at least, and pairs that
#: are added up at a time.
COMMON, SHARE, PAIRS = 512, 0.005, 1 << 19
FOUND = "q long, label long, s double, b double, side string"
SUMS = "q long, n long, s_mean double, s_square double, s_low double, s_high double, b_mean double, b_square double, b_low double, b_high double"


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of each row, with their counts."""
    for b in (batch.slice(i, CHUNK) for batch in batches for i in range(0, batch.num_rows, CHUNK)):
        lists = b.column(1)
        dl = lists.value_lengths().to_numpy()
        flat = lists.flatten().dictionary_encode()
        code = flat.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(dl)), dl)
        key, n = np.unique(row * max(1, len(flat.dictionary)) + code, return_counts=True)
        row, code = np.divmod(key, max(1, len(flat.dictionary)))
        offsets = pa.array(np.searchsorted(row, np.arange(len(dl) + 1)), pa.int32())
        toks = pa.ListArray.from_arrays(offsets, flat.dictionary.take(pa.array(code)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dl, pa.int64()), toks, pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], names=["label", "dl", "toks", "f"])


class Lexicon:
    """Postings of documents (label, text) and the weights of their tokens: Okapi BM25, with negative weights replaced by a
    quarter of the vocabulary's mean weight. Null texts are empty; the documents are read once."""

    def __init__(self, documents: DataFrame):
        rows = documents.where("label is not null").select(F.col("label").cast("long"), tokens(F.coalesce(F.col("text"), F.lit(""))).alias("toks"))
        self.rows = written(rows.mapInArrow(_count, "label long, dl long, toks array<string>, f array<int>"), "postings")
        n, mean = self.rows.agg(F.count("*"), F.avg(F.col("dl").cast("double"))).first()
        self.mean_length = mean or 1.0
        df = written(self.rows.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df")), "vocabulary")
        w = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        least = EPSILON * (df.agg(F.avg(w)).first()[0] or 0.0)
        self.idf = df.select("tok", F.when(w < 0, F.lit(least)).otherwise(w).alias("idf"))

    def weights(self, queries: DataFrame) -> DataFrame:
        """q and terms (tok, w) of queries (q, text); a token counts as often as it occurs. None if none is known."""
        each = queries.select("q", F.explode(tokens(F.coalesce(F.col("text"), F.lit("")))).alias("tok")).groupBy("q", "tok").agg(F.count("*").alias("n"))
        w = each.join(self.idf, "tok").groupBy("q").agg(F.collect_list(F.struct("tok", (F.col("n") * F.col("idf")).alias("w"))).alias("terms"))
        return queries.select("q").distinct().join(w, "q", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<tok:string,w:double>>")))


def _flat(c: pa.Array | pa.ChunkedArray) -> pa.Array:
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _numbers(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _flat(_flat(lists).flatten()).to_numpy(zero_copy_only=False)


class _Block:
    """A block of queries as arrays: what a task gets of it holds no object a query or token."""

    def __init__(self, rows: pa.Table | list[Row], mean_length: float):
        t = rows if isinstance(rows, pa.Table) else pa.Table.from_pylist([r.asDict(True) for r in rows])
        self.ids = t.column("q").to_numpy().astype(np.int64)
        self.n, self.mean_length = t.num_rows, mean_length
        self.vectors = _numbers(t.column("v")).astype(float).reshape(self.n, -1) if "v" in t.column_names else None
        self.dialogues = t.column("dialogue").to_pylist() if "dialogue" in t.column_names else None
        self.numbers = {c: t.column(c).to_numpy().astype(float) for c in t.column_names if c[:2] in ("s_", "b_")}
        self.wanted = None
        if "wanted" in t.column_names:
            lists = _flat(t.column("wanted"))
            each = _flat(lists.flatten())
            self.wanted = [each.field(c).to_numpy(zero_copy_only=False) for c in ("label", "s", "b")]
            self.starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        self.terms = "terms" in t.column_names
        if self.terms:
            lists = _flat(t.column("terms"))
            each = _flat(lists.flatten())
            of, w = np.repeat(np.arange(self.n), lists.value_lengths().to_numpy()), np.zeros(0)
            code, self.vocabulary = np.zeros(0, np.int64), pa.array([], pa.string())
            if len(of):
                toks, w = each.field("tok").dictionary_encode(), each.field("w").to_numpy(zero_copy_only=False).astype(float)
                code, self.vocabulary = toks.indices.to_numpy().astype(np.int64), toks.dictionary
            order = np.argsort(code, kind="stable")
            self.code, self.q, self.w = code[order], of[order], w[order]
            self.edge = np.searchsorted(self.code, np.arange(len(self.vocabulary) + 1))
            often = np.diff(self.edge)
            self.common = np.argsort(-often, kind="stable")[:COMMON]
            self.common = self.common[often[self.common] >= SHARE * self.n]
        self.matrix = None

    def coded(self, b: pa.RecordBatch) -> pa.RecordBatch:
        """``b`` with the numbers of its tokens in this block, null where no query has one."""
        code = pc.index_in(b.column("toks").flatten(), value_set=self.vocabulary)
        lengths = b.column("toks").value_lengths().to_numpy()
        return b.append_column("code", pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), code))

    def cosines(self, b: pa.RecordBatch) -> np.ndarray:
        return self.vectors @ b.column("v").flatten().to_numpy().reshape(b.num_rows, -1).T

    def bm25(self, b: pa.RecordBatch, least: np.ndarray | None = None) -> np.ndarray:
        """Scores of a chunk; -inf where no document of it can reach the query's ``least``."""
        b = b if "code" in b.schema.names else self.coded(b)
        m, known = b.num_rows, len(self.vocabulary)
        f = b.column("f").flatten().to_numpy().astype(float)
        code = b.column("code").flatten()
        doc = np.repeat(np.arange(m), b.column("toks").value_lengths().to_numpy())
        held = code.is_valid().to_numpy(zero_copy_only=False)
        code, doc, f = code.drop_null().to_numpy(), doc[held], f[held]
        impact = f * (K1 + 1) / (f + K1 * (1 - B + B * b.column("dl").to_numpy()[doc] / self.mean_length))
        out = np.zeros((self.n, m))
        if not len(code):
            return out
        reached = np.ones(self.n, bool)
        if least is not None and np.isfinite(least).any():
            most = np.zeros(known)
            np.maximum.at(most, code, impact)
            reached = np.bincount(self.q, np.maximum(self.w, 0) * most[self.code], self.n) >= least - 1e-6
        some = None if reached.all() else np.flatnonzero(reached)
        if some is None or len(some):
            # common tokens: one product of matrices
            often = np.bincount(code, minlength=known)
            chosen = self.common[often[self.common] * np.diff(self.edge)[self.common] > SHARE * self.n * m]
            place = np.full(known, -1)
            place[chosen] = np.arange(len(chosen))
            at = place[code]
            if len(chosen):
                if self.matrix is None:
                    column = np.full(known, -1)
                    column[self.common] = np.arange(len(self.common))
                    column = column[self.code]
                    self.matrix = np.zeros((self.n, len(self.common)))
                    self.matrix[self.q[column >= 0], column[column >= 0]] = self.w[column >= 0]
                    self.column = np.full(known, -1)
                    self.column[self.common] = np.arange(len(self.common))
                impacts = np.zeros((len(chosen), m))
                impacts[at[at >= 0], doc[at >= 0]] = impact[at >= 0]
                weights = self.matrix[:, self.column[chosen]]
                if some is None:
                    out = weights @ impacts
                else:
                    out[some] = weights[some] @ impacts
            # the others: each pair of a query and a document that have one
            rare = at < 0
            code, doc, impact = code[rare], doc[rare], impact[rare]
            n = np.diff(self.edge)[code]
            total = np.r_[0, np.cumsum(n)]
            cuts = np.unique(np.r_[np.searchsorted(total, np.arange(0, total[-1], PAIRS), "right") - 1, len(n)])
            flat = out.reshape(-1)
            for i, j in zip(cuts[:-1], cuts[1:]):
                k = n[i:j]
                posting = np.repeat(self.edge[code[i:j]] - (total[i:j] - total[i]), k) + np.arange(total[j] - total[i])
                q, cell, add = self.q[posting], np.repeat(doc[i:j], k), self.w[posting] * np.repeat(impact[i:j], k)
                if some is not None:
                    q, cell, add = q[reached[q]], cell[reached[q]], add[reached[q]]
                np.add.at(flat, q * m + cell, add)
        if some is not None:
            out[~reached] = -np.inf
        return out

    def own(self, b: pa.RecordBatch) -> np.ndarray:
        """Whether a document is the query's own, or of its dialogue (null is one too)."""
        out = self.ids[:, None] == b.column("label").to_numpy()[None, :]
        if self.dialogues is not None:
            codes, _ = pd.factorize(np.array([*self.dialogues, *b.column("dialogue").to_pylist()], object), use_na_sentinel=False)
            out |= codes[: self.n, None] == codes[None, self.n :]
        return out


class _Best:
    """Each query's first k of what was added, by key, then label."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.full(n, -np.inf)
        self.at, self.label = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.key, self.s, self.b = np.zeros(0), np.zeros(0), np.zeros(0)

    def add(self, x: np.ndarray, out: np.ndarray, names: np.ndarray, digits: int, s: np.ndarray, b: np.ndarray) -> None:
        """Scores ``x`` by query and name, those that are ``out`` left out; they are ranked when rounded."""
        least, m = self.limit, x.shape[1]
        if m > self.k and np.isinf(least).any():
            inside = np.where(out, -np.inf, x)
            least = np.maximum(least, np.round(np.partition(inside, m - self.k, axis=1)[:, m - self.k], digits))
        i, j = np.nonzero((x >= (least - 2 * 10.0**-digits)[:, None]) & ~out)
        key = np.round(x[i, j], digits)
        kept = (key >= least[i]) & np.isfinite(key)
        i, j, key = i[kept], j[kept], key[kept]
        if not len(i):
            return
        parts = [(self.at, i), (self.label, names[j]), (self.key, key), (self.s, s[i, j]), (self.b, b[i, j])]
        at, label, key, s, b = (np.concatenate(p) for p in parts)
        order = np.lexsort((label, -key, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        order, place = order[place < self.k], place[place < self.k]
        self.at, self.label, self.key, self.s, self.b = at[order], label[order], key[order], s[order], b[order]
        last = place == self.k - 1
        self.limit[self.at[last]] = self.key[last]


class _Sums:
    """Count, mean, sum of squares about the mean, and extremes of each query's candidates."""

    def __init__(self, n: int):
        self.n, self.mean, self.square = np.zeros(n), np.zeros(n), np.zeros(n)
        self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf)

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        n = (~out).sum(1)
        some = np.maximum(n, 1)
        mean = np.where(out, 0, x).sum(1) / some
        square = np.where(out, 0, (x - mean[:, None]) ** 2).sum(1)
        every = np.maximum(self.n + n, 1)
        self.square += square + (mean - self.mean) ** 2 * self.n * n / every
        self.mean += (mean - self.mean) * n / every
        self.n += n
        self.low = np.minimum(self.low, np.where(out, np.inf, x).min(1))
        self.high = np.maximum(self.high, np.where(out, -np.inf, x).max(1))

    def columns(self) -> list[pa.Array]:
        return [pa.array(c) for c in (self.mean, self.square, self.low, self.high)]


def _chunks(batches: Iterator[pa.RecordBatch], block: _Block) -> Iterator[pa.RecordBatch]:
    step = max(1, min(CHUNK, CELLS // max(1, block.n)))
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            some = batch.slice(i, CHUNK)
            some = block.coded(some) if block.terms else some
            yield from (some.slice(one, step) for one in range(0, some.num_rows, step))


def _search(block: _Block, k: int, sides: str, digits: int, own: bool):
    """The first k by cosine (side s) and by BM25 (side b); of one side alone, the other's scores are zeros."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {side: _Best(block.n, k) for side in sides}
        for b in _chunks(batches, block):
            out = np.zeros((block.n, b.num_rows), bool) if own else block.own(b)
            names = b.column("label").to_numpy()
            scores = {side: block.cosines(b) if side == "s" else block.bm25(b, best["b"].limit if sides == "b" else None) for side in sides}
            none = np.broadcast_to(0.0, out.shape)
            for side, x in scores.items():
                best[side].add(x, out, names, digits, scores.get("s", none), scores.get("b", none))
        for side, x in best.items():
            columns = [pa.array(block.ids[x.at]), pa.array(x.label), pa.array(x.s), pa.array(x.b), pa.repeat(side, len(x.at))]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "label", "s", "b", "side"])

    return scan


def _summary(block: _Block):
    """What all candidates of a query come to, in a task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, lex = _Sums(block.n), _Sums(block.n)
        for b in _chunks(batches, block):
            out = block.own(b)
            s.add((block.cosines(b) + 1) / 2, out)
            lex.add(block.bm25(b), out)
        columns = [pa.array(block.ids), pa.array(s.n.astype(np.int64)), *s.columns(), *lex.columns()]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SUMS.split(", ")]).filter(pa.array(s.n > 0))

    return scan


def _products(block: _Block, k: int, digits: int):
    """The first k by the product of both z-scores, by parameters that the queries bring."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(block.n, k)

        def z(x: np.ndarray, side: str) -> np.ndarray:
            mean, dev = (block.numbers[f"{side}_{c}"][:, None] for c in ("mean", "dev"))
            return np.where(dev > 1e-12, (x - mean) / np.where(dev > 1e-12, dev, 1), 0.0)

        for b in _chunks(batches, block):
            s, lex = block.cosines(b), block.bm25(b)
            product = z((s + 1) / 2, "s") * z(lex, "b")
            best.add(product, block.own(b), b.column("label").to_numpy(), digits, product, lex)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[best.at]), pa.array(best.label), pa.array(best.s), pa.array(best.b), pa.repeat("s", len(best.at))], names=["q", "label", "s", "b", "side"])

    return scan


def _before(keys: np.ndarray, labels: np.ndarray, x: np.ndarray, names: np.ndarray) -> np.ndarray:
    """How many of ``x`` (named in ascending order) stand before each of ``keys``: higher, or equal with a smaller name."""
    order = np.argsort(keys, kind="stable")
    ranks = keys[order]
    above, to = np.searchsorted(ranks, x, "left"), np.searchsorted(ranks, x, "right")
    higher = np.bincount(above, minlength=len(keys) + 1)[::-1].cumsum()[::-1][1:]  # of those that stand above a key
    out = np.empty(len(keys), np.int64)
    out[order] = higher
    for u in np.unique(ranks[above[to > above]]):
        at = np.flatnonzero(keys == u)
        same = np.r_[0, np.cumsum(x == u)]
        out[at] += same[np.searchsorted(names, labels[at])]
    return out


def _places(block: _Block, digits: int):
    """How many candidates of a task stand before each one that is asked for, on both sides."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, keys = block.wanted[0], [np.round(x, digits) for x in block.wanted[1:]]
        before = np.zeros((2, len(label)), np.int64)
        for b in _chunks(batches, block):
            out, names = block.own(b), b.column("label").to_numpy()
            order = np.argsort(names, kind="stable")
            out, names = out[:, order], names[order]
            for side, x in enumerate((block.cosines(b), block.bm25(b))):
                x = np.round(x[:, order], digits)
                for i in range(block.n):
                    at, there = slice(block.starts[i], block.starts[i + 1]), ~out[i]
                    before[side][at] += _before(keys[side][at], label[at], x[i][there], names[there])
        q = np.repeat(block.ids, np.diff(block.starts))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(label), pa.array(before[0]), pa.array(before[1])], names=["q", "label", "rs", "rb"])

    return scan


def _blocks(queries: DataFrame) -> Iterator[tuple[pa.Table, int | None]]:
    """Bounded blocks of queries, those of one dimension together, with that dimension."""
    d = F.size("v") if "v" in queries.columns else F.lit(0)
    terms = F.sum(F.size("terms")) if "terms" in queries.columns else F.lit(0)
    for size in queries.groupBy(d.alias("d")).agg(F.count("*").alias("n"), terms.alias("terms")).orderBy("d").collect():  # a row a dimension
        blocks = max(-(-size.n // ROWS), -(-(size.terms or 0) // TERMS))
        for i in range(blocks):
            rows = queries.where((d == size.d) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)).toArrow()  # about ROWS
            if rows.num_rows:
                yield rows, size.d if "v" in queries.columns else None


def _run(queries: DataFrame, corpus: DataFrame, mean_length: float, task, schema: str, without: tuple[str, ...] = ()) -> DataFrame:
    """``without``: columns of the corpus that no task reads."""
    spark, out = corpus.sparkSession, shared_dir(corpus.sparkSession, "found")
    some = False
    for rows, d in _blocks(queries):
        part = corpus if d is None else corpus.where(F.size("v") == d)
        part.drop(*without).mapInArrow(task(_Block(rows, mean_length)), schema).write.mode("append").parquet(out)
        some = True
    return spark.read.schema(schema).parquet(out) if some else spark.createDataFrame([], schema)


def _ranked(found: DataFrame, side: str, k: int, digits: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.round(side, digits).desc(), "label")
    return found.where(F.col("side") == side).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def dense_top(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, own: bool = False) -> DataFrame:
    """q, label, score (cosine, rounded), rk: the first k of all rows of ``corpus``, but those of the query's label unless
    ``own``, ties to the smaller label. Both: label, v (unit vectors); rows are compared with queries of their own dimension."""
    q = written(queries.select(F.col("label").alias("q"), "v"), "queries")
    found = _run(q, corpus.select("label", "v"), 1.0, lambda b: _search(b, k, "s", digits, own), FOUND)
    return _ranked(found, "s", k, digits).select("q", "label", F.round("s", digits).alias("score"), "rk")


def bm25_top(queries: DataFrame, documents: DataFrame, k: int, digits: int = 6, own: bool = True) -> DataFrame:
    """q, label, score (BM25, rounded), rk: the first k of all ``documents`` (label, text) for queries (q, text), ties to the
    smaller label. Documents that share no token have a score of 0. ``own``: a document of the query's number counts too."""
    lexicon = Lexicon(documents)
    q = written(lexicon.weights(queries), "queries")
    found = _run(q, lexicon.rows, lexicon.mean_length, lambda b: _search(b, k, "b", digits, own), FOUND)
    return _ranked(found, "b", k, digits).select("q", "label", F.round("b", digits).alias("score"), "rk")


class Hybrid:
    """Both sides of a search. ``queries`` and ``corpus``: label, v (unit vectors), text, and dialogue, if a query's own one
    is to be left out; ``documents`` (label, text) are those of which BM25's statistics are taken, the corpus if not given.

    Candidates of a query are all rows of the corpus but its own (and its dialogue's); one that shares no token has a BM25
    score of 0, and counts as such everywhere.
    """

    def __init__(self, queries: DataFrame, corpus: DataFrame, documents: DataFrame | None = None):
        lexicon = Lexicon((corpus if documents is None else documents).select("label", "text"))
        also = ["dialogue"] if "dialogue" in corpus.columns else []
        self.corpus = written(corpus.select("label", "v", *also).join(lexicon.rows, "label"), "corpus")
        named = queries.withColumnRenamed("label", "q")
        self.queries = written(lexicon.weights(named).join(named.select("q", "v", *also), "q"), "queries")
        self.mean_length = lexicon.mean_length

    def lists(self, k: int, digits: int = 9) -> DataFrame:
        """q, label, s, b, and rs and rb: the place in the first k by cosine and by BM25 (null behind them)."""
        found = written(_run(self.queries, self.corpus, self.mean_length, lambda b: _search(b, k, "sb", digits, False), FOUND), "found")
        r = {side: _ranked(found, side, k, digits) for side in "sb"}
        rs = r["s"].select("q", "label", "s", "b", F.col("rk").alias("rs"), F.lit(None).cast("int").alias("rb"))
        rb = r["b"].select("q", "label", "s", "b", F.lit(None).cast("int").alias("rs"), F.col("rk").alias("rb"))
        return rs.unionByName(rb).groupBy("q", "label").agg(F.first("s").alias("s"), F.first("b").alias("b"), F.max("rs").alias("rs"), F.max("rb").alias("rb"))

    def one(self, side: str, k: int, digits: int = 6) -> DataFrame:
        """q, label, score, rk of one side, s or b."""
        queries, without = (self.queries.drop("terms"), ("dl", "toks", "f")) if side == "s" else (self.queries, ("v",))
        found = _run(queries, self.corpus, self.mean_length, lambda b: _search(b, k, side, digits, False), FOUND, without)
        return _ranked(found, side, k, digits).select("q", "label", F.round(side, digits).alias("score"), "rk")

    def sums(self, where: Column | None = None) -> DataFrame:
        """q, n, and of both sides' scores (the cosine's share (s + 1) / 2, BM25) over all candidates, or those that meet
        ``where``: mean, deviation, low and high."""
        corpus = self.corpus if where is None else self.corpus.where(where)
        parts = _run(self.queries, corpus, self.mean_length, _summary, SUMS)
        w = Window.partitionBy("q")  # a row a task
        for side in "sb":
            parts = parts.withColumn(f"{side}_all", F.sum(F.col("n") * F.col(f"{side}_mean")).over(w) / F.sum("n").over(w))
        square = lambda s: F.sum(F.col(f"{s}_square") + F.col("n") * (F.col(f"{s}_mean") - F.col(f"{s}_all")) ** 2)
        of = lambda s: [F.first(f"{s}_all").alias(f"{s}_mean"), F.sqrt(square(s) / F.sum("n")).alias(f"{s}_dev"), F.min(f"{s}_low").alias(f"{s}_low"), F.max(f"{s}_high").alias(f"{s}_high")]
        return parts.groupBy("q").agg(F.sum("n").alias("n"), *of("s"), *of("b"))

    def products(self, parameters: DataFrame, k: int, where: Column, digits: int = 6) -> DataFrame:
        """q, label, score, rk: the first k candidates that meet ``where`` by the product of both z-scores, by ``parameters``
        (as ``sums`` returns them, of other candidates). Queries without parameters, and sides without deviation, give 0."""
        p = parameters.select("q", *(f"{side}_{c}" for side in "sb" for c in ("mean", "dev")))
        q = written(self.queries.join(p, "q", "left").fillna(0.0, p.columns[1:]), "queries")
        found = _run(q, self.corpus.where(where), self.mean_length, lambda b: _products(b, k, digits), FOUND)
        return _ranked(found, "s", k, digits).select("q", "label", F.round("s", digits).alias("score"), "rk")

    def places(self, pool: DataFrame, digits: int = 9) -> DataFrame:
        """q, label, rs, rb: the places of ``pool`` (q, label, s, b) among all candidates of its queries."""
        wanted = pool.groupBy("q").agg(F.collect_list(F.struct("label", "s", "b")).alias("wanted"))
        q = written(self.queries.join(wanted, "q"), "queries")
        parts = _run(q, self.corpus, self.mean_length, lambda b: _places(b, digits), "q long, label long, rs long, rb long")
        return parts.groupBy("q", "label").agg((1 + F.sum("rs")).alias("rs"), (1 + F.sum("rb")).alias("rb"))
