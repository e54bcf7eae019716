"""Slot-to-value maps: deltas, updates, and the metrics of a prediction against gold. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DELETE


def once(make, **parts: Column) -> Column:
    """What ``make`` returns for a struct of ``parts``, which are evaluated once however often it uses them."""
    bound = F.array(F.struct(*(c.alias(name) for name, c in parts.items())))
    return F.get(F.transform(bound, make), F.lit(0))


def compute_delta(before: Column, after: Column) -> Column:
    """What turns ``before`` into ``after``: changed and new values, DELETE for what went."""
    changed = F.map_filter(after, lambda k, v: F.coalesce(F.element_at(before, k) != v, F.lit(True)))
    gone = F.map_filter(before, lambda k, _: ~F.map_contains_key(after, k))
    return F.map_concat(changed, F.transform_values(gone, lambda _, __: F.lit(DELETE)))


def update(before: Column, delta: Column) -> Column:
    """``before`` after a delta; DELETE of what isn't there does nothing."""
    kept = F.map_filter(before, lambda k, _: ~F.map_contains_key(delta, k))
    return F.map_concat(kept, F.map_filter(delta, lambda _, v: v != DELETE))


def same(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def resolve(gold: Column, pred: Column) -> Column:
    """Gold with alternatives a|b settled: the predicted one if it is among them, else the first."""

    def settle(k: Column, v: Column) -> Column:
        p = F.element_at(pred, k)
        return F.when(~v.contains("|"), v).when(F.coalesce(F.array_contains(F.split(v, r"\|"), F.coalesce(p, F.lit(""))), F.lit(False)) & p.isNotNull(), p).otherwise(F.split_part(v, F.lit("|"), F.lit(1)))

    return F.transform_values(gold, settle)


def restrict(m: Column, domain: Column | str) -> Column:
    d = F.lit(domain) if isinstance(domain, str) else domain
    return F.map_filter(m, lambda k, _: F.startswith(k, F.concat(d, F.lit("-"))))


def counts(gold: Column, pred: Column) -> tuple[Column, Column, Column]:
    """TP, FP, FN of slots: a wrong value is a miss alone; only slots that gold lacks are false positives."""
    tp = F.size(F.map_filter(gold, lambda k, v: F.coalesce(F.element_at(pred, k) == v, F.lit(False))))
    fp = F.size(F.map_filter(pred, lambda k, _: ~F.map_contains_key(gold, k)))
    return tp, fp, F.size(gold) - tp


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return p, r, _ratio(2 * p * r, p + r)


def evaluated(gold: Column, pred: Column, n_slots: int | Column = 30) -> Column:
    """A struct of jga, acc and f1 of a turn. Gold is settled once, and slots are counted once."""
    n = F.lit(n_slots) if isinstance(n_slots, int) else n_slots

    def counted(x: Column) -> Column:
        tp, fp, fn = counts(x["gold"], x["pred"])
        return once(lambda c: prf_of(c["tp"], c["fp"], F.size(x["gold"]) - c["tp"], x), tp=tp, fp=fp)

    def prf_of(tp: Column, fp: Column, fn: Column, x: Column) -> Column:
        # slots without a value are misses, but may be the same
        equal = F.when((fp == 0) & (fn == 0), True).when(F.exists(F.map_values(x["gold"]), lambda v: v.isNull()), same(x["gold"], x["pred"])).otherwise(False)
        jga = F.when(x["gold"].isNotNull() & x["pred"].isNotNull(), equal.cast("int"))
        return F.struct(jga.alias("jga"), ((x["n"] - fn - fp) / x["n"].cast("double")).alias("acc"), prf(tp, fp, fn)[2].alias("f1"))

    return once(counted, gold=resolve(gold, pred), pred=pred, n=n)


def evaluate(gold: Column, pred: Column, n_slots: int | Column = 30) -> dict[str, Column]:
    """jga, acc and f1 of a turn, each evaluated for itself: where more than one is asked for, take ``evaluated``."""
    m = evaluated(gold, pred, n_slots)
    return {c: m[c] for c in ("jga", "acc", "f1")}


def fbeta(gold: Column, pred: Column, beta: float = 1.0) -> Column:
    """F-beta of two lists by membership (repeats count); the numerator has 1 + beta, as the metric was published."""

    def score(x: Column) -> Column:
        p, r = _ratio(x["tp"], x["tp"] + x["fp"]), _ratio(x["tp"], x["n"].cast("double"))
        f = once(lambda y: _ratio((1 + beta) * y["p"] * y["r"], beta**2 * y["p"] + y["r"]), p=p, r=r)
        return F.when(x["n"] > 0, f).when(x["m"] == 0, 1.0).otherwise(0.0)

    def counted(x: Column) -> Column:
        tp = F.size(F.filter(x["gold"], lambda g: F.array_contains(x["pred"], g))).cast("double")
        fp = F.size(F.filter(x["pred"], lambda p: ~F.array_contains(x["gold"], p)))
        return once(score, tp=tp, fp=fp, n=F.size(x["gold"]), m=F.size(x["pred"]))

    return once(counted, gold=gold, pred=pred)


def single(belief: Column) -> Column:
    """domain-slot-value of each slot-value string: its first two fields and the first alternative of its last."""

    def one(b: Column) -> Column:
        f = F.split(b, "-")
        return F.concat(F.concat_ws("-", F.slice(f, 1, 2)), F.lit("-"), F.split_part(F.element_at(f, -1), F.lit("|"), F.lit(1)))

    return F.transform(belief, one)


def heads(belief: Column) -> Column:
    return F.transform(belief, lambda b: F.concat_ws("-", F.slice(F.split(b, "-"), 1, 2)))


def sv_scores(gold: Column, pred: Column, beta: float = 1.0) -> tuple[Column, Column]:
    """F-beta of slot-values, and F1 of slots."""
    g, p = single(gold), single(pred)
    return fbeta(g, p, beta), fbeta(heads(g), heads(p))


def sv_similarity(gold: Column, pred: Column, beta: float = 1.0) -> Column:
    """F-beta of slot-values plus F1 of slots, less one."""
    values, slots = sv_scores(gold, pred, beta)
    return values + slots - 1


def distinct_similarity(gold: Column, gold_heads: Column, pred: Column, pred_heads: Column) -> Column:
    """``sv_similarity`` at beta 1 of beliefs without repeats (a state's), whose heads were taken before: F1 of sets is
    twice the intersection over the sum of sizes."""

    def f1(a: Column, b: Column) -> Column:
        n = F.size(a) + F.size(b)
        return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.when(n > 0, n))

    return f1(gold, pred) + f1(gold_heads, pred_heads) - 1


def by_domain(state: Column, order: tuple[str, ...], renamed: dict[str, str]) -> Column:
    """An array of (domain, slots), slots being a map, in the given order of domains, others after them by name. Slots get
    their names in code; whole numbers lose leading zeros and a plus sign."""
    entries = F.array_sort(F.map_entries(state))
    place = F.create_map(*(F.lit(x) for i, d in enumerate(order) for x in (d, i)))
    names = F.create_map(*(F.lit(x) for kv in renamed.items() for x in kv))
    domain = lambda e: F.split_part(e["key"], F.lit("-"), F.lit(1))

    def slot(e: Column) -> Column:
        plain = F.substring(e["key"], F.length(domain(e)) + 2, 1 << 30)
        whole = F.regexp_replace(F.regexp_replace(F.trim(e["value"]), r"^(-?)\+?0+(?=[0-9])", "$1"), r"^(\+|-(?=0$))", "")
        value = F.when(e["value"].rlike(r"^\s*[+-]?[0-9]+\s*$"), whole).otherwise(e["value"])
        return F.struct(F.coalesce(F.element_at(names, plain), F.replace(plain, F.lit(" "), F.lit("_"))).alias("key"), value.alias("value"))

    def block(d: Column) -> Column:
        return F.struct(F.coalesce(F.element_at(place, d), F.lit(100)).alias("place"), d.alias("domain"), F.map_from_entries(F.transform(F.filter(entries, lambda e: domain(e) == d), slot)).alias("slots"))

    blocks = F.transform(F.array_distinct(F.transform(entries, domain)), block)
    first = lambda a, b: F.when(a["place"] != b["place"], F.when(a["place"] < b["place"], -1).otherwise(1)).when(a["domain"] < b["domain"], -1).when(a["domain"] > b["domain"], 1).otherwise(0)
    return F.transform(F.array_sort(blocks, first), lambda x: F.struct(x["domain"].alias("domain"), x["slots"].alias("slots")))


def changed_blocks(before: Column, now: Column, keys: list[str]) -> Column:
    """Those of ``keys`` whose value differs between two maps, in that order; none if a map is null."""
    changed = F.filter(F.array(*map(F.lit, keys)), lambda k: ~F.element_at(before, k).eqNullSafe(F.element_at(now, k)))
    return F.when(before.isNull() | now.isNull(), F.array().cast("array<string>")).otherwise(changed)
