"""Ranked lists, BM25 within pools, and draws; ``scan`` has the searches over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import EPSILON, K1, B, tokens

def ranked(df: DataFrame, by: str | list[str], score: str = "score", tie: str = "label", k: int | None = None, ascending: bool = False) -> DataFrame:
    """rk (from 1) within ``by``, by score, ties by label; only the first k if given (the plan then prunes groups early)."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    out = df.withColumn("rk", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col(tie))))
    return out.where(F.col("rk") <= k) if k is not None else out


def top_k(df: DataFrame, k: int, by: str = "q") -> DataFrame:
    """The first k of ranked lists, in prompt order (worst first): ``place`` counts from 1."""
    out = df.where(F.col("rk") <= k)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("rk").desc())))


def bm25_pool_scores(pool: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """q, label, score within each query's own pool: the statistics are those of the pool. ``pool``: q, label, text, and
    qtext, unless ``queries`` (q, text) has a row a query.

    A query's text is one more row of its pool, so a row a text and distinct token is all that is sorted, and texts are
    shuffled once, by query.
    """
    asked = pool.groupBy("q").agg(F.first("qtext").alias("text")) if queries is None else queries
    own = F.col("own")
    rows = pool.select("q", "label", "text", F.lit(False).alias("own")).unionByName(asked.select("q", F.lit(None).cast(pool.schema["label"].dataType).alias("label"), "text", F.lit(True).alias("own")))
    rows = rows.repartition("q").withColumn("dl", F.size(tokens(F.col("text"))))
    w = Window.partitionBy("q")
    rows = rows.withColumn("n", F.count(F.when(~own, 1)).over(w)).withColumn("avgdl", F.avg(F.when(~own, F.col("dl").cast("double"))).over(w))
    rows = rows.withColumn("none", F.when(F.max(own & F.col("text").isNotNull()).over(w), 0))  # null where the query's text is
    t = rows.select("q", "own", "label", "n", "dl", "avgdl", "none", F.explode(tokens(F.col("text"))).alias("tok")).groupBy("q", "own", "label", "n", "dl", "avgdl", "none", "tok").agg(F.count("*").alias("f"))
    each = Window.partitionBy("q", "tok")
    t = t.withColumn("df", F.count(F.when(~own, 1)).over(each)).withColumn("qn", F.max(F.when(own, F.col("f"))).over(each)).where(~own)
    t = t.withColumn("w", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.sum(F.col("w") / F.col("df")).over(w) / F.sum(1 / F.col("df")).over(w)  # over distinct tokens: each has df rows
    hit = t.withColumn("idf", F.when(F.col("w") < 0, EPSILON * mean).otherwise(F.col("w")))
    part = F.coalesce("qn", "none") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("q", "label").agg(F.sum(part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """label and its vector at length 1; null and zero vectors go."""
    v = vectors.select(F.col(id_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    v = v.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).where("norm > 0")
    return v.select("label", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def numbered(df: DataFrame, key: str = "label") -> DataFrame:
    """``df`` with at, from 0 without gaps: numbers by key within buckets (the first three digits of the key's md5), after the
    sizes of the buckets before. Keys should be distinct."""
    b = df.withColumn("_b", F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 3))
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_b", before.alias("_s"))  # a row a bucket, 4,096 at most
    b = b.join(F.broadcast(starts), "_b")
    return b.withColumn("at", F.col("_s") + F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1).drop("_b", "_s")


def random_examples(queries: DataFrame, corpus: DataFrame, k: int, seed: int) -> DataFrame:
    """q, place, label: k draws with replacement per query, by 60 bits of the md5 of (seed, query, draw) into numbered rows."""
    rows = numbered(corpus.select("label"))
    n = corpus.count()
    draws = queries.select("q", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("place"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("q").cast("string"), F.col("place").cast("string")).cast("binary"))
    draws = draws.withColumn("at", F.conv(F.substring(drawn, 1, 15), 16, 10).cast("long") % max(n, 1))
    return draws.join(rows, "at").select("q", "place", "label")
