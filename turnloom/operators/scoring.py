"""Combinatorial example scoring: permute pools, score groups, and sum what groups say of their members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.state import sv_scores
from .sampling import permutations


def group_scores(pool: DataFrame, iterations: int, group: int, predict: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """q, label, iter, grp, jga: each iteration's permutation cut into groups, each group scored once.

    ``predict`` gives a group's score from (q, iter, grp); a model behind it is a pandas UDF over the grouped examples.
    """
    p = permutations(pool, iterations).withColumn("grp", F.floor(F.col("out_pos") / group).cast("int"))
    return p.select("q", "label", "iter", "grp", predict(F.col("q"), F.col("iter"), F.col("grp")).alias("jga"))


def example_scores(members: DataFrame) -> DataFrame:
    """q, label, occurence, score, influence: sums over iterations of the member's group score, and of that less the mean
    score of the iteration's other groups (0 if there is none)."""
    groups = members.select("q", "iter", "grp", "jga").distinct()
    totals = groups.groupBy("q", "iter").agg(F.sum("jga").alias("total"), F.count("*").alias("g"))
    other = F.when(F.col("g") > 1, (F.col("total") - F.col("jga")) / (F.col("g") - 1)).otherwise(0.0)
    each = members.join(totals, ["q", "iter"]).withColumn("gain", F.col("jga") - other)
    return each.groupBy("q", "label").agg(F.count("*").alias("occurence"), F.sum("jga").cast("double").alias("score"), F.round(F.sum("gain"), 6).alias("influence"))


def select_examples(scores: DataFrame, by: str, k: int) -> DataFrame:
    """The k best a query in prompt order, worst first."""
    best = scores.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.col(by).desc(), "label"))).where(F.col("rk") <= k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.col("rk").desc())))


def retriever_similarities(lists: DataFrame, queries: DataFrame, states: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: how similar a query's examples are to it, by the values and the slots of the turn alone and of the whole state
    (turn_value, turn_slot, all_value, all_slot: means over each query's list, then over queries; 0 without a list), and the
    number of queries. ``lists``: q, label; ``queries``: q; ``states``: label, turn, full (arrays of slot-values)."""
    own = states.select(F.col("label").alias("q"), F.col("turn").alias("qt"), F.col("full").alias("qf"))
    both = lists.join(own, "q").join(states.select("label", "turn", "full"), "label")
    names = ("turn_value", "turn_slot", "all_value", "all_slot")
    scores = (*sv_scores(F.col("qt"), F.col("turn"), beta), *sv_scores(F.col("qf"), F.col("full"), beta))
    each = both.select("q", *(c.alias(n) for c, n in zip(scores, names))).groupBy("q").agg(*(F.avg(n).alias(n) for n in names))
    every = queries.select("q").distinct().join(each, "q", "left").fillna(0.0, list(names))
    return every.agg(*(F.round(F.avg(n), 6).alias(n) for n in names), F.count("*").alias("queries"))
