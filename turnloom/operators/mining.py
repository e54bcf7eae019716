"""Training pairs for a retriever, from pools with scores and similarities: (q, label, score, sim)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import numbered

#: Strides of draws; those that don't divide the number of rows pass over all rows.
STRIDES = (7919, 104729, 1299709, 15485863, 179424673, 2038074743, 22801763489, 252097800623)


def info_nce(pool: DataFrame, topk: int, negatives: int, hardest: bool = False) -> DataFrame:
    """q, label, kind ("pos" or "neg"), place.

    Positives score above the (topk+1)-th item, filled to topk from the ties at that score by similarity; of the rest,
    by descending similarity, the last ceil(negatives / 2) are negatives (the first with ``hardest``); ``easy_negatives``
    draws the others.
    """
    w = Window.partitionBy("q")
    by_score = w.orderBy(F.col("score").desc(), "label")
    p = pool.withColumn("rk", F.row_number().over(by_score))
    # the score at rank topk+1, or the last one in a smaller pool
    p = p.withColumn("edge", F.coalesce(F.max(F.when(F.col("rk") == topk + 1, F.col("score"))).over(w), F.min("score").over(w)))
    p = p.withColumn("above", F.col("score") > F.col("edge")).withColumn("n_above", F.count(F.when(F.col("above"), 1)).over(w))
    tied = (F.col("score") == F.col("edge")).cast("int")
    p = p.withColumn("fill", F.row_number().over(w.orderBy(F.desc_nulls_last(tied), F.col("sim").desc(), "label")))
    p = p.withColumn("pos", F.col("above") | ((tied == 1) & (F.col("fill") <= topk - F.col("n_above"))))
    order = [F.col("sim").desc(), F.col("label")] if hardest else [F.col("sim").asc(), F.col("label").desc()]
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("q", "pos").orderBy(*order)))
    kept = p.where(F.col("pos") | (F.col("place") <= math.ceil(negatives / 2)))
    return kept.select("q", "label", F.when(F.col("pos"), "pos").otherwise("neg").alias("kind"), "place")


def easy_negatives(mined: DataFrame, corpus: DataFrame, negatives: int, seed: int = 0) -> DataFrame:
    """q, pos, label, place: for each positive of ``info_nce`` with the same ``negatives``, the easy ones, which are
    negatives - ceil(negatives / 2) distinct rows of ``corpus`` (label) that are neither the anchor, nor the positive,
    nor a hard negative; all that are left if there are fewer.

    Rows are numbered; a pair passes over them from a place and at a stride that are hashes of (seed, q, pos). As many
    steps as rows are wanted and visited always suffice.
    """
    hard = math.ceil(negatives / 2)
    easy = negatives - hard
    rows = numbered(corpus.select("label").distinct())
    n = rows.count()
    strides = [s for s in STRIDES if n % s] or [1]
    visited = F.collect_list(F.when(F.col("kind") == "neg", F.col("label"))).over(Window.partitionBy("q"))
    pairs = mined.withColumn("hard", visited).where("kind = 'pos'").select("q", F.col("label").alias("pos"), "hard")
    hashed = lambda *c: F.xxhash64(F.lit(seed), "q", "pos", *map(F.lit, c))
    stride = F.element_at(F.array(*(F.lit(s % max(n, 1)).cast("long") for s in strides)), (F.pmod(hashed("stride"), F.lit(len(strides))) + 1).cast("int"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(min(easy + hard + 2, n) - 1))) if n and easy else F.explode(F.array().cast("array<int>"))
    drawn = pairs.select("q", "pos", "hard", F.pmod(hashed("start"), F.lit(max(n, 1))).alias("start"), stride.alias("stride"), steps.alias("step"))
    # both sides are as many as turns, however small their files: neither may be broadcast
    drawn = drawn.withColumn("at", (F.col("start") + F.col("step") * F.col("stride")) % max(n, 1)).hint("merge").join(rows.hint("merge"), "at")
    drawn = drawn.where((F.col("label") != F.col("q")) & (F.col("label") != F.col("pos")) & ~F.coalesce(F.array_contains("hard", F.col("label")), F.lit(False)))
    placed = drawn.withColumn("place", F.row_number().over(Window.partitionBy("q", "pos").orderBy("step")))
    return placed.where(F.col("place") <= easy).select("q", "pos", "label", "place")


def with_texts(mined: DataFrame, texts: DataFrame) -> DataFrame:
    """``mined`` (q, label, ...) with both texts, anchor and example; a row without one has a null. ``texts``: label, text."""
    of = lambda c, name: texts.select(F.col("label").alias(c), F.col("text").alias(name))
    return mined.join(of("q", "anchor"), "q", "left").join(of("label", "example"), "label", "left")


def contrastive(pool: DataFrame, topk: int) -> DataFrame:
    """q, label, target: of the pool's rows the topk most similar (1.0) and the topk least similar (0.0)."""
    hi = F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "label"))
    lo = F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").asc(), "label"))
    p = pool.withColumn("hi", hi).withColumn("lo", lo)
    return p.where(F.col("hi") <= topk).select("q", "label", F.lit(1.0).alias("target")).unionByName(p.where(F.col("lo") <= topk).select("q", "label", F.lit(0.0).alias("target")))
