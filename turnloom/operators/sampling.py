"""Sampling by hash order: the same rows on every run and cluster. The hash is md5 of the key as text, which SQL engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int = 0) -> Column:
    """Hexadecimal digits of a key of any type; null keys draw as no key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def _first(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of the smallest draws, ties by key; all if there are fewer.

    Draws are counted by their first four digits (at most 65,536 counts reach the driver). Rows below the digits at which
    the count passes ``n`` are in; only those at these digits are ordered. Keys should be distinct, or nearly so.
    """
    name = "_draw"
    while name in df.columns:
        name = "_" + name
    drawn = df.withColumn(name, draw(F.col(key), seed))
    left = n
    for r in drawn.groupBy(F.substring(name, 1, 4).alias("digits")).count().orderBy("digits").collect():
        if r["count"] > left:
            inside = drawn.where(F.col(name) < r.digits)
            rest = drawn.where(F.substring(name, 1, 4) == r.digits).orderBy(name, key).limit(left)
            return (inside.unionByName(rest) if left else inside).drop(name)
        left -= r["count"]
    return df


def by_row(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """int(ratio n) rows in the order of their draws. Keys may be text."""
    return _first(df, key, int(df.count() * ratio), seed)


def by_dialogue(df: DataFrame, dialogue: str, ratio: float, seed: int = 0) -> DataFrame:
    """All rows of int(ratio n) dialogues."""
    ids = by_row(df.select(dialogue).distinct(), dialogue, ratio, seed)
    return df.join(ids, dialogue, "left_semi")


def pre_assigned(df: DataFrame, ids: DataFrame, dialogue: str) -> DataFrame:
    return df.join(ids, dialogue, "left_semi")


def disjoint(df: DataFrame, taken: DataFrame, dialogue: str, ratio: float, seed: int = 42) -> DataFrame:
    """Dialogues for a development set: ratio of all, drawn from those not taken."""
    ids = df.select(dialogue).distinct()
    return _first(ids.join(taken, dialogue, "left_anti"), dialogue, int(ids.count() * ratio), seed)


def sampled(df: DataFrame, how: str, key: str, dialogue: str, ratio: float = 1.0, seed: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """By the name that a run is configured with; unknown names are errors."""
    if how in ("pre_assigned", "sgd_pre_assigned"):
        if ids is None:
            raise ValueError(f"{how} needs ids")
        return pre_assigned(df, ids, dialogue)
    known = {"none": lambda: df, "random_by_turn": lambda: by_row(df, key, ratio, seed), "random_by_dialog": lambda: by_dialogue(df, dialogue, ratio, seed)}
    if how not in known:
        raise ValueError(f"unknown sampling method: {how}")
    return known[how]()


def permutations(pool: DataFrame, iterations: int) -> DataFrame:
    """``pool`` (q, label, pos) once an iteration, with out_pos, its place in that iteration's own permutation."""
    each = pool.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    order = F.md5(F.concat_ws(":", F.col("q").cast("string"), F.col("iter").cast("string"), F.col("label").cast("string")).cast("binary"))
    return each.withColumn("out_pos", F.row_number().over(Window.partitionBy("q", "iter").orderBy(order, "label")) - 1)
