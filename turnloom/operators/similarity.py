"""Similarity of beliefs (sets of slot-values) by an inverted index: F1 of the values plus F1 of their slots, less one.

Equal beliefs are one class, named after its smallest row. Postings take a value to the classes that hold it; a pair's shared
values are counted by ``groupBy(query class, class)``, and both F1 follow from that count, the sizes, and the slots that two
shapes (slots, number of values) share. Pairs that share no value have a similarity that their shapes alone decide, so of
those a row a shape and place is enough. Popular values are met only where needed: pairs that differ in few values are found
by rare keys, all but those few values of a set, and most sets have enough of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.state import heads
from ..shared import written
from .search import ranked

DIGITS = 6
#: Values that a side of a close pair may have of its own (``_keys`` is written for two), and values of a set that has keys.
RADIUS, WIDEST = 2, 30


def classes(beliefs: DataFrame) -> DataFrame:
    """label (of the class), b and members, from ``beliefs`` (label, b); b is sorted, without repeats. Null beliefs go."""
    return beliefs.where("b is not null").groupBy("b").agg(F.min("label").alias("label"), F.count("*").alias("members"))


def membership(beliefs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """label, class and members of every row of ``beliefs`` (label, b)."""
    c = (classes(beliefs) if known is None else known).withColumnRenamed("label", "class")
    return beliefs.join(c, "b").select("label", "class", "members")


def shaped(c: DataFrame) -> DataFrame:
    """``c`` (label, b) with h (its slots), n and nh (the sizes of both), and shape: the smallest label of the same slots and
    number of values."""
    s = c.select("label", "b", F.array_sort(F.array_distinct(heads(F.col("b")))).alias("h"), F.size("b").alias("n"))
    shapes = s.groupBy("h", "n").agg(F.min("label").alias("shape"))
    return s.join(shapes, ["h", "n"]).select("label", "b", "h", "n", F.size("h").alias("nh"), "shape")


def _f1(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 1.0).otherwise(2.0 * shared / F.when(a + b > 0, a + b))


def _similar(shared: Column) -> Column:
    """Of a pair with qn, qh, slots (shared ones), n and nh."""
    return F.round(_f1(shared, F.col("qn"), F.col("n")) + _f1(F.col("slots"), F.col("qh"), F.col("nh")) - 1, DIGITS)


def shape_pairs(q: DataFrame, c: DataFrame) -> DataFrame:
    """qshape, shape, qn, qh, n, nh and slots (how many both have) of shapes that share a slot, or that are both empty."""
    slot = F.explode(F.when(F.col("nh") == 0, F.array(F.lit(""))).otherwise(F.col("h"))).alias("slot")
    of = lambda x: x.select("shape", "h", "n", "nh").distinct().select("shape", "n", "nh", slot)
    both = of(q).toDF("qshape", "qn", "qh", "slot").join(of(c), "slot")
    return both.groupBy("qshape", "shape", "qn", "qh", "n", "nh").agg(F.count("*").alias("slots"))


def sharing(q: DataFrame, c: DataFrame, shapes: DataFrame) -> DataFrame:
    """q, label and sim of all pairs that share a value. ``q`` and ``c`` are ``shaped``.

    The classes stay where their values are counted: partitioned by label, so that a small set of queries is joined and
    counted without a shuffle of pairs. Else both sides meet by value; a popular one is split by the adaptive join.
    """
    wanted = q.select(F.col("label").alias("q"), F.col("shape").alias("qshape"), F.explode("b").alias("v"))
    held = c.repartition("label").select("label", "shape", F.explode("b").alias("v"))
    m = held.join(wanted, "v").groupBy("label", "q", "shape", "qshape").agg(F.count("*").alias("m"))
    return m.join(shapes, ["qshape", "shape"]).select("q", "label", _similar(F.col("m")).alias("sim"))


def _keys(sets: DataFrame, most: int) -> DataFrame:
    """``sets`` (label, shape, b, n) with key: b and what is left of it without one or two (RADIUS) of its values, for those of
    at most ``most`` values; never empty."""
    fewer = lambda x: F.transform(x, lambda v: F.array_remove(x, v))
    one = fewer(F.col("b"))
    two = F.flatten(F.transform(one, fewer))
    every = F.array_distinct(F.concat(F.array("b"), one, two))
    return sets.where(F.col("n") <= most).select("label", "shape", F.explode(F.filter(every, lambda x: F.size(x) > 0)).alias("key"))


def close(q: DataFrame, c: DataFrame, shapes: DataFrame) -> DataFrame:
    """q, label and sim of the pairs that share a value and of which neither side has more than RADIUS values of its own:
    what both share is what is left of either without those, so the longest key in common counts the shared values."""
    wanted = _keys(q, WIDEST).select(F.col("label").alias("q"), F.col("shape").alias("qshape"), "key")
    held = _keys(c.repartition("label"), WIDEST + RADIUS)
    m = held.join(wanted, "key").groupBy("label", "q", "shape", "qshape").agg(F.max(F.size("key")).alias("m"))
    return m.join(shapes, ["qshape", "shape"]).select("q", "label", _similar(F.col("m")).alias("sim"))


def _beyond(a: Column, one_each: Column) -> Column:
    """The most similar that a pair which ``close`` leaves out, and of which one side has ``a`` values, can be."""
    r = RADIUS + 1
    longer = 2.0 * a / (2 * a + r)  # all of a, and r others
    # with one value a slot, r others are r other slots, or r changed values; a pair that shares no value has 0 at most
    tight = F.greatest(2 * longer - 1, (a - r) / F.greatest(a, F.lit(1)).cast("double"), F.lit(0.0))
    return F.when(a > WIDEST, 1.0).when(one_each, tight).otherwise(longer)


def _one_each(c: DataFrame) -> Column:
    """Whether all sets have one value a slot, as states do."""
    return F.coalesce(c.agg(F.max(F.col("n") - F.col("nh")) == 0).scalar(), F.lit(True))


def similar(q: DataFrame, c: DataFrame, least: float) -> DataFrame:
    """q, label, sim of all pairs with a similarity of ``least`` > 0 or more: they share a value or are both empty.
    Both sides: label, b, a row a class. Pairs are ``close`` where that can't miss one, else found by single values."""
    q, c = written(shaped(q), "sets"), written(shaped(c), "sets")
    shapes = written(shape_pairs(q, c), "shapes")
    enough = _beyond(F.col("n"), _one_each(c)) < least
    empty = shapes.where("qh = 0").select(F.col("qshape").alias("q"), F.col("shape").alias("label"), F.lit(1.0).alias("sim"))
    found = close(q.where(enough), c, shapes).unionByName(sharing(q.where(~enough), c, shapes))
    return found.unionByName(empty).where(F.col("sim") >= least)


def most_similar(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """q, label, sim, rk: the ``k`` classes of ``c`` most similar to each of ``q``, ties to the smaller label. Both sides:
    label, b, a row a class.

    First come the ``close`` pairs. Sets of which k are more similar than any other pair can be are done; for the rest all
    that share a value are counted. Of what shares none, classes of a shape count as if they shared none: that is
    their similarity or less, so if one isn't among the first k by it, k others precede it anyway; and only the k best
    shapes and the first k classes of a shape are needed. Classes that share no slot have -1, the least there is.
    """
    q, c = written(shaped(q), "sets"), written(shaped(c), "sets")
    shapes = written(shape_pairs(q, c), "shapes")
    near = written(ranked(close(q, c, shapes), "q", score="sim", k=k), "close")
    full = near.where(F.col("rk") == k).select(F.col("q").alias("label"), "sim").join(q, "label").where(F.col("sim") > _beyond(F.col("n"), _one_each(c)))
    open_ = written(q.join(full, "label", "left_anti"), "open")
    more = ranked(sharing(open_, c, shapes), "q", score="sim", k=k)
    best = ranked(shapes.select("qshape", F.col("shape").alias("label"), _similar(F.lit(0)).alias("sim")), "qshape", score="sim", k=k)
    first = ranked(c.select("shape", "label"), "shape", score="label", k=k, ascending=True).drop("rk")
    least = c.select("label").orderBy("label").limit(k).agg(F.collect_list("label")).scalar()
    least = q.select(F.col("shape").alias("qshape")).distinct().withColumn("all", least).select("qshape", F.explode("all").alias("label"), F.lit(-1.0).alias("sim"))
    rest = best.select("qshape", F.col("label").alias("shape"), "sim").join(first, "shape").select("qshape", "label", "sim").unionByName(least)
    rest = ranked(rest.groupBy("qshape", "label").agg(F.max("sim").alias("sim")), "qshape", score="sim", k=k).drop("rk")
    rest = open_.select(F.col("label").alias("q"), F.col("shape").alias("qshape")).join(rest, "qshape").select("q", "label", "sim")
    both = near.drop("rk").unionByName(more.drop("rk")).unionByName(rest).groupBy("q", "label").agg(F.max("sim").alias("sim"))
    return ranked(both, "q", score="sim", k=k)
