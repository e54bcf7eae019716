"""Maximal periodic runs of words, by Lyndon arrays of a document's words.

After Ellert and Fischer: words are letters of an ordered alphabet of which nothing but the order is used. For the order and
its reverse, the longest Lyndon word at each position ends where the next smaller suffix begins; suffixes are compared letter
by letter, but what an earlier comparison matched at the same distance is not matched again. Every run has a Lyndon root
among them, so extending each root to both sides, again past what is matched already, finds all runs. No suffix array or
tree, and no fingerprints of stretches, are made.

A word that occurs once in its stretch of a text lies in no run. Stretches are cut at such words, again and again, and those
too short for a run are left; what remains goes through the arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows
from .words import groups, split

#: Words that a run has at least (and two periods at least).
LEAST = 12
#: Times that stretches are cut; more would only save time.
ROUNDS = 8
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]


def next_smaller(w: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix, where the next smaller one begins (the length if there is none), and how many letters both share.

    From the last suffix to the first. A suffix is compared with the next one, then with that one's next smaller one, and
    so on; where the two already compared share more or fewer letters than this one did, the outcome is known. Else letters
    are compared from there on, up to a stretch that was matched at that distance before, whose end is taken over.
    """
    n = len(w)
    after, shared = [n] * n, [0] * n
    matched: dict[int, tuple[int, int]] = {}  # by distance: the stretch matched last, which lies further left than others
    for i in range(n - 2, -1, -1):
        j, m = i + 1, 0
        while True:
            d, k = j - i, i + m
            if w[k] == w[j + m] if j + m < n else False:
                start, end = matched.get(d, (n, n))
                if start <= k < end:
                    k = end
                else:
                    k += 1
                    while k + d < n and w[k] == w[k + d]:
                        if k == start:
                            k = end
                            break
                        k += 1
                matched[d] = (i, k)
                m = k - i
            if j + m == n or w[k] > w[j + m]:
                after[i], shared[i] = j, m
                break
            while True:  # smaller than suffix j, so on to the next that could be smaller than this one
                t, j = shared[j], after[j]
                if j == n or m >= t:
                    break
            if j == n:
                break
            if m > t:
                after[i], shared[i] = j, t
                break
    return after, shared


def runs_of(w: list[int], least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs of at least ``least`` letters and two periods, by start, then period."""
    n, found = len(w), set()
    for letters in (w, [-x for x in w]):
        after, shared = next_smaller(letters)
        seen: dict[int, tuple[int, int]] = {}  # by period: the stretch extended last
        for i in range(n):
            p, m = after[i] - i, shared[i]
            if not m and (i == 0 or w[i - 1] != w[i - 1 + p]):
                continue
            start, end = seen.get(p, (n, n))
            if start <= i <= end:
                continue
            start = i
            while start and w[start - 1] == w[start - 1 + p]:
                start -= 1
            seen[p] = (start, i + m)
            length = i + m - start + p
            if length >= max(least, 2 * p):
                found.add((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(letters: np.ndarray, texts: np.ndarray, least: int = LEAST) -> Iterator[np.ndarray]:
    """Places of the words of each stretch that may hold a run. ``letters``: words by number; ``texts``: each one's text."""
    at = np.arange(len(letters))
    for last in range(ROUNDS):
        if not len(at):
            return
        edge = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(texts[at]) != 0), True])
        size = np.diff(edge)
        stretch = np.repeat(np.arange(len(size)), size)
        long = size[stretch] >= least
        key = stretch * (int(letters.max()) + 1) + letters[at]
        order = np.argsort(key)
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        keep = long & again
        if keep.all():
            break
        at = at[keep]
    edge = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(texts[at]) != 0), True])
    for a, b in zip(edge, edge[1:]):
        if b - a >= least:
            yield at[a:b]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in groups(batches):
        n, (words, text, _) = b.num_rows, split(b.column(1))
        letters = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        first = np.searchsorted(text, np.arange(n + 1))
        found: list[list[Run]] = [[] for _ in range(n)]
        dropped = np.zeros(len(letters) + 1, np.int64)
        for at in stretches(letters, text):
            of = text[at[0]]
            for start, length, period in runs_of(letters[at].tolist()):
                found[of].append((int(at[0] - first[of]) + start, length, period))
                dropped[at[0] + start + period] += 1
                dropped[at[0] + start + length] -= 1
        kept = np.cumsum(dropped[:-1]) == 0
        sizes = np.r_[0, np.cumsum(np.bincount(text[kept], minlength=n))]
        collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(sizes), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
        cells: list[list] = [[] for _ in range(7)]
        for rs, rest in zip(found, collapsed):
            start, length, period = max(rs, key=lambda r: (r[1], -r[0], -r[2])) if rs else (None, None, None)
            listed = "".join(f"{s},{m},{p}\n" for s, m, p in rs)
            row = (len(rs), start, length, period, 1000 * length // period if rs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest.as_buffer()).hexdigest())
            for c, x in zip(cells, row):
                c.append(x)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cells, kinds))], names=[f.split()[0] for f in SCHEMA.split(", ")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, n_runs, the longest run (ties: smallest start, then period), digests of all runs and of the
    words that remain when each run keeps its first period only.

    One pass without a shuffle; memory follows the longest text, time its length (with a logarithm at worst). Words are what
    lies between ASCII white space. Null and empty texts, and those without a run, have no run: four nulls, the digest of
    nothing, and of all words. Repeated rows and null ids are rows of their own; other columns are left out, whatever their
    names; an empty table gives no rows.
    """
    return text_rows(docs, id_col, text_col).mapInArrow(_runs, SCHEMA)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the text of a document whose crc32(doc_id) is divisible by 10 repeats a stretch of its words
    up to its end; a null id counts as the empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    w = chosen.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    n, a = F.col("n"), F.col("a")
    w = w.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    w = w.withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((n - a) / F.col("p")).cast("int")
    tail: Column = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, F.col("p")), times)), F.lit(1), n - a)
    return w.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))
