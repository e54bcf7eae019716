"""Fusing a sparse and a dense ranking. Only candidates that can enter a pool are carried; what is taken over all candidates
of a query (means, deviations, extremes, places) comes as sums from the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Hybrid
from .search import ranked

#: What a place counts for: 1 / (place + SHIFT), places from 1.
SHIFT = 59


def standardized(pool: DataFrame, sums: DataFrame, how: str = "z") -> DataFrame:
    """``pool`` (q, label, s, b, ...) with zs and zb: z-scores (population deviation) or min-max shares, by the sums of each
    query's candidates; equal scores, or a query without sums, give 0."""

    def std(x: Column, side: str) -> Column:
        mean, dev, low, high = (F.col(f"{side}_{c}") for c in ("mean", "dev", "low", "high"))
        z = F.when(dev > 1e-12, (x - mean) / dev) if how == "z" else F.when(high > low, (x - low) / (high - low))
        return z.otherwise(0.0)

    both = pool.join(sums, "q", "left")
    return both.select(*pool.columns, std((F.col("s") + 1) / 2, "s").alias("zs"), std(F.col("b"), "b").alias("zb"))


def fuse(sides: Hybrid, logic: str = "multiply_top_k", k_s: int = 5, k_b: int = 5, alpha: float = 0.5, how: str = "z", digits: int = 6) -> DataFrame:
    """q, label, score, rk of the k_s + k_b best by product, weighted sum, or reciprocal places. Pools are twice k a side.

    By reciprocal places all candidates compete. The first k of a side have 1 / (k + SHIFT) or more, and one that is behind
    the first 2 k + SHIFT on both sides has less, so only those before are placed exactly.
    """
    if logic not in ("multiply_top_k", "weighted_sum", "rrf"):
        raise ValueError(f"unknown decoding logic: {logic}")
    k = k_s + k_b
    if logic == "rrf":
        pool = sides.places(sides.lists(2 * k + SHIFT))
        score = 1 / (F.col("rs") + float(SHIFT)) + 1 / (F.col("rb") + float(SHIFT))
    else:
        pool = sides.lists(2 * max(k_s, k_b)).where((F.col("rs") <= 2 * k_s) | (F.col("rb") <= 2 * k_b))
        pool = standardized(pool, sides.sums(), how)
        score = F.col("zs") * F.col("zb") if logic == "multiply_top_k" else alpha * F.col("zs") + (1 - alpha) * F.col("zb")
    return ranked(pool.select("q", "label", F.round(score, digits).alias("score")), "q", k=k)


def interleaved(sparse: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """The plain interleave d1, s1, d2, s2, ...: a label stands where it first occurs. Both sides: q, label, rk."""
    places = dense.select("q", "label", (2 * F.col("rk") - 1).alias("at")).unionByName(sparse.select("q", "label", (2 * F.col("rk")).alias("at")))
    return ranked(places.groupBy("q", "label").agg(F.min("at").alias("at")), "q", score="at", k=k, ascending=True)
