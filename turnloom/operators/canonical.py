"""Values to their canonical form: exact, by alias, then by fuzzy ratio.

Aliases add or cut the usual beginnings and ends of names; numbers may be in words, in any choice. The choices aren't
enumerated: a name and its alias have the same fold (all numbers in words), so folds are joined, and the pair is read word by
word. Fuzzy candidates come from an index of parts: a form is cut into so many that a value which reaches the ratio holds some
of them unchanged, at places that both lengths bound. Candidates within as many changes as the ratio leaves are compared.
Folds, parts and ratios are plain Python, run once a distinct value or candidate in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_time
from ..shared import written

#: What names may begin and end with.
PREFIXES = ("the ",)
SUFFIXES = (" hotel", " restaurant", " cinema", " guest house", " theatre", " airport", " street", " gallery", " museum", " train station")
#: Slots (without their domain) whose values are times.
TIME_SLOTS = ("leaveat", "arriveby", "book time")
#: Letters lacking or added up to which the places of parts are told apart.
PLACED = 8
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_DIGIT = re.compile("[0-9]")
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Names of the powers of 1000.
_THOUSANDS = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion undecillion duodecillion tredecillion quattuordecillion quindecillion sexdecillion septendecillion octodecillion novemdecillion vigintillion".split()


def spell(n: int) -> str:
    """A whole number below 10**66 in English words."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10 - 2] + ("-" + _ONES[n % 10] if n % 10 else "")
    if n < 1000:
        return _ONES[n // 100] + " hundred" + (" and " + spell(n % 100) if n % 100 else "")
    power = (len(str(n)) - 1) // 3
    first, rest = divmod(n, 1000**power)
    return f"{spell(first)} {_THOUSANDS[power - 1]}" + ((" and " if rest < 100 else ", ") + spell(rest) if rest else "")


def worded(token: str, digits: bool) -> str:
    """A token that is a number in words, read whole or digit by digit; numbers too long for words, and all else, as they are."""
    if not (token.isdecimal() and token.isascii()):
        return token
    if digits:
        return " ".join(_ONES[int(d)] for d in token)
    return spell(int(token)) if len(token.lstrip("0")) <= 3 * len(_THOUSANDS) + 3 else token


def fold(value: str, digits: bool) -> str:
    if not _DIGIT.search(value):
        return " ".join(value.split())
    return " ".join(worded(t, digits) for t in value.split())


def reads_as(alias: str, value: str, digits: bool) -> bool:
    """Whether ``value`` is ``alias`` with any of its numbers in words."""
    words, at = value.split(), 0
    for t in alias.split():
        spelled = worded(t, digits).split()
        if words[at : at + 1] == [t]:
            at += 1
        elif words[at : at + len(spelled)] == spelled:
            at += len(spelled)
        else:
            return False
    return at == len(words)


def aliases(value: str) -> set[str]:
    """Forms of a name with and without the usual beginnings and ends."""
    cut = {value}
    for p in ("", *PREFIXES):
        for s in ("", *SUFFIXES):
            if value.startswith(p) and value.endswith(s) and len(value) > len(p) + len(s):
                cut.add(value[len(p) : len(value) - len(s)])
    out = set(cut)
    for a in cut:
        for p in ("", *(p for p in PREFIXES if not a.startswith(p))):
            for s in ("", *(s for s in SUFFIXES if not a.endswith(s))):
                out.add(p + a + s)
    return out


def processed(value: str) -> str:
    """What a ratio compares: lower case, letters and digits, with spaces for all else."""
    return re.sub(r"\W", " ", value).lower().strip()


def ratio(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b).ratio())


@lru_cache(maxsize=None)
def cuts(a: int, t: float) -> tuple[tuple[tuple[int, int], ...], int] | None:
    """How a form of ``a`` letters is cut into parts (begin, end), and how many of them a value that reaches the ratio ``t``
    holds unchanged: k, or one anywhere if that is 0. None where parts would be shorter than two letters.

    Such a value lacks or adds a (1 - t) / t letters twice over at most, each of which changes a part; so of that many parts
    and k more, k stay. Of long forms one part is looked for at any place.
    """
    most = int(2 * a * (1 - t) / t + 1e-9)
    if most > PLACED and 2 * (most + 1) <= a:
        return tuple((a * i // (most + 1), a * (i + 1) // (most + 1)) for i in range(most + 1)), 0
    for k in range(3 if most <= 1 else 2 if most <= 2 else 1, 0, -1):
        n = most + k
        if 2 * n <= a:
            return tuple((a * i // n, a * (i + 1) // n) for i in range(n)), k
    return None


def asked_parts(value: str, t: float) -> list[str]:
    """Keys of a form: itself, and all choices of as many of its parts as must be held; its length where it isn't cut."""
    cut = cuts(len(value), t)
    if cut is None:
        return [f"{len(value)}"]
    parts, k = cut
    if not k:
        return [f"~{value[i:j]}" for i, j in parts]
    return [f"={value}", *("\0".join((f"{len(value)}", *map(str, c), *(value[slice(*parts[i])] for i in c))) for c in combinations(range(len(parts)), k))]


@lru_cache(maxsize=None)
def places(b: int, t: float) -> list[tuple[str, tuple[tuple[int, int], ...]]]:
    """Where a value of ``b`` letters holds the parts of the forms with which it may reach ``t``: what a key begins with, and
    the parts' places. Lengths tell how many letters are lacking or added, and so how far parts may be moved."""
    out, anywhere = [], set()
    for a in range(max(0, math.ceil(b * t / (2 - t) - 1e-9)), int(b * (2 - t) / t + 1e-9) + 1):
        more, spare = b - a, int((1 - t) * (a + b) + 1e-9)
        spare -= (spare - more) % 2
        cut = cuts(a, t)
        if spare < abs(more):
            continue
        if cut is None:
            out.append((f"{a}", ()))
        elif cut[1] == 0:
            anywhere |= {j - i for i, j in cut[0]}
        elif spare == 0:
            out.append(("=", ((0, b),)))
        else:
            parts, k = cut
            for c in combinations(range(spare + k), k):
                moved = [((), 0, 0)]  # places, how far the last is moved, letters that it took
                for last, i in zip((-1, *c), c):
                    begin, end = parts[i]
                    steps = range(-spare, spare + 1) if i > last + 1 else (0,)
                    moved = [((*at, (begin + by + d, end + by + d)), by + d, used + abs(d)) for at, by, used in moved for d in steps if used + abs(d) <= spare and begin + by + d >= 0 and end + by + d <= b]
                rest = c[-1] + 1 < len(parts)
                out += [("\0".join((f"{a}", *map(str, c), "")), at) for at, by, used in moved if used + abs(more - by) <= spare and (rest or more == by)]
    return out + [("~", ((i, i + n),)) for n in sorted(anywhere) for i in range(b - n + 1)]


def held_parts(value: str, t: float) -> list[str]:
    """Keys of a value: those of all forms with which it may reach ``t`` are among them."""
    return list({start + "\0".join(value[i:j] for i, j in at) for start, at in places(len(value), t)})


def _fuzzy(asked: DataFrame, known: DataFrame, fuzzy: int) -> DataFrame:
    """slot, form, canonical and r (the ratio) of all pairs that reach ``fuzzy``. ``asked``: slot, form; ``known``: slot,
    canonical; both distinct, compared as ``processed``."""
    t = max(0.01, (fuzzy - 0.5) / 100)

    def keyed(keys: Callable[[str, float], list[str]]):
        @F.pandas_udf("struct<text:string,part:array<string>>")
        def look(s: pd.Series) -> pd.DataFrame:
            texts = [processed(x) for x in s]
            return pd.DataFrame({"text": texts, "part": [keys(x, t) for x in texts]})

        return look

    @F.pandas_udf("int")
    def sizes(s: pd.Series) -> pd.Series:
        return s.map(lambda x: len(processed(x)))

    @F.pandas_udf("int")
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="int32")

    # a form that no length in its slot can meet is not looked up
    lengths = known.withColumn("length", sizes("canonical")).groupBy("slot").agg(F.min("length").alias("low"), F.max("length").alias("high"))
    size = F.length("g.text")
    wanted = asked.join(F.broadcast(lengths), "slot").withColumn("g", keyed(asked_parts)("form")).where((size * t <= F.col("high") * (2 - t) + 1e-6) & (F.col("low") * t <= size * (2 - t) + 1e-6))  # a row a slot
    hashed = F.explode(F.transform("g.part", lambda x: F.xxhash64(x))).alias("part")
    wanted = wanted.select("slot", "form", F.col("g.text").alias("a"), hashed)
    index = known.withColumn("g", keyed(held_parts)("canonical")).select("slot", "canonical", F.col("g.text").alias("b"), hashed)
    both = wanted.hint("merge").join(index.hint("merge"), ["slot", "part"])
    # letters that are lacking or added are no fewer than changes of any kind
    spare = F.expr(f"levenshtein(a, b, cast((length(a) + length(b)) * {1 - t!r}D + 1e-6 as int))")
    pairs = both.where(spare >= 0).select("slot", "form", "canonical", "a", "b").distinct()
    return pairs.withColumn("r", ratios("a", "b")).where(F.col("r") >= fuzzy).select("slot", "form", "canonical", "r")


def canonical(values: DataFrame, known: DataFrame, fuzzy: int = 90) -> DataFrame:
    """slot, value, canonical of each distinct (slot, value); null if there is none or if it is ambiguous.

    ``known``: slot, value. Exact matches join first; aliases of the rest are exploded and joined by their folds, the smallest
    of several matches counts. What is still open is compared by ratio: its aliases as they are, with all numbers in words,
    and with all in words digit by digit; the best match of each counts (ties: the smallest), and they must agree. In a slot
    without known values times are brought to hh:mm (``TIME_SLOTS``, null if they are none); any other such slot has no
    canonical values. Null values and slots go.
    """
    v = written(values.select("slot", "value").where("slot is not null and value is not null").distinct(), "values")
    k = written(known.select("slot", F.col("value").alias("canonical")).where("slot is not null and canonical is not null").distinct(), "known")

    @F.pandas_udf("array<string>")
    def alias_lists(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted(aliases(x)))

    @F.pandas_udf("array<string>")
    def folds(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted({fold(x, d) for d in (False, True)}))

    @F.pandas_udf("boolean")
    def readable(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([reads_as(x, y, False) or reads_as(x, y, True) for x, y in zip(a, b)], dtype=bool)

    @F.pandas_udf("array<string>")
    def forms(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sorted({" ".join(x.split()), fold(x, False), fold(x, True)}))

    exact = v.join(k, (v["slot"] == k["slot"]) & (v["value"] == k["canonical"]), "left").select(v["slot"], "value", "canonical")
    done, rest = exact.where("canonical is not null"), exact.where("canonical is null").select("slot", "value")
    slots = k.select("slot").distinct()
    rest = rest.join(slots, "slot", "left_semi")
    spread = written(rest.select("slot", "value", F.explode(alias_lists("value")).alias("alias")), "aliases")
    folded = spread.select("slot", "value", "alias", F.explode(folds("alias")).alias("fold"))
    same = folded.join(k.select("slot", "canonical", F.explode(folds("canonical")).alias("fold")), ["slot", "fold"])
    by_alias = written(same.where(readable("alias", "canonical")).groupBy("slot", "value").agg(F.min("canonical").alias("canonical")), "found")
    open_ = written(spread.join(by_alias, ["slot", "value"], "left_anti").select("slot", "value", F.explode(forms("alias")).alias("form")), "open")
    near = _fuzzy(open_.select("slot", "form").distinct(), k, fuzzy)
    best = near.groupBy("slot", "form").agg(F.min(F.struct((-F.col("r")).alias("r"), "canonical"))["canonical"].alias("canonical"))
    by_ratio = open_.join(best, ["slot", "form"]).groupBy("slot", "value").agg(F.count_distinct("canonical").alias("n"), F.min("canonical").alias("canonical")).where("n = 1").drop("n")
    short = F.substring("slot", F.instr("slot", "-") + 1, 1 << 30)
    times = v.join(slots, "slot", "left_anti").where(short.isin(*TIME_SLOTS)).select("slot", "value", canonical_time(F.col("value")).alias("canonical"))
    found = done.unionByName(by_alias).unionByName(by_ratio).unionByName(times)
    return v.join(found, ["slot", "value"], "left").select("slot", "value", "canonical")


def surface_forms(counts: DataFrame) -> DataFrame:
    """canonical, surface: the most frequent surface form; ties go to the first seen. ``counts``: canonical, surface, n, first_seen."""
    s = counts.groupBy("canonical", "surface").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    return s.groupBy("canonical").agg(F.max_by("surface", F.struct("n", (-F.col("first_seen")).alias("f"))).alias("surface"), F.sum("n").alias("n"))
