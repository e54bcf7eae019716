"""Alignment of two token lists by matching blocks, as a column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<a:int,b:int,size:int>>"


def longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Start in a, start in b and size of the longest stretch that both have; ties to the smaller start in a, then in b. One
    row of lengths is held at a time."""
    best = (0, 0, 0)
    ends = np.zeros(len(b) + 1, np.int64)  # at j + 1: how long the stretch is that ends at b[j] and at the letter of a before
    for i, x in enumerate(a):
        ends[1:] = np.where(b == x, ends[:-1] + 1, 0)
        j = int(ends.argmax())
        if ends[j] > best[2]:
            size = int(ends[j])
            best = (i + 1 - size, j - size, size)
    return best


def blocks(first: list[str], second: list[str]) -> list[tuple[int, int, int]]:
    """Matching blocks in order: the longest, then those before and those after it likewise; blocks that touch on both sides
    are one."""
    codes = pd.factorize(np.array([*first, *second], object))[0] if first or second else np.zeros(0, int)
    a, b = codes[: len(first)], codes[len(first) :]
    found, left = [], [(0, len(a), 0, len(b))]
    while left:
        a0, a1, b0, b1 = left.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, n = longest(a[a0:a1], b[b0:b1])
        if n:
            i, j = a0 + i, b0 + j
            found.append((i, j, n))
            left += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
        out.append((i, j, n))
    return out


def matching_blocks(a: Column, b: Column) -> Column:
    """Blocks (a, b, size) that two arrays of tokens share, by place. Null arrays are empty; an array may hold no nulls.
    Memory follows the lengths, time their product."""

    @F.pandas_udf(BLOCKS)
    def found(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"a": i, "b": j, "size": n} for i, j, n in blocks(list(p), list(q))] for p, q in zip(x, y)])

    none = F.array().cast("array<string>")
    return found(F.coalesce(a, none), F.coalesce(b, none))


def filled(a: Column, b: Column) -> Column:
    """What stands in ``b`` between two blocks, by the place in ``a`` behind the first of them: the values of the gaps of a
    text with placeholders. What stands before the first block and behind the last isn't there."""
    found = matching_blocks(a, b)
    pairs = F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def gap(p: Column) -> Column:
        start = p["x"]["b"] + p["x"]["size"]
        return F.struct((p["x"]["a"] + p["x"]["size"]).alias("key"), F.array_join(F.slice(b, start + 1, p["y"]["b"] - start), " ").alias("value"))

    return F.map_from_entries(F.transform(pairs, gap))
