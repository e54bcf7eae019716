"""Per-dialogue state and metrics over long event tables (id, turn_id, slot, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.state import changed_blocks, prf
from ..functions.text import DELETE


def fold(events: DataFrame, slots: list[str], value: str = "value") -> Column:
    """The state after each event, as a map: each slot's last value that isn't null, without what was deleted.

    One running window a slot over one shuffle by dialogue; nothing is collected, so a long dialogue costs no more a turn.
    """
    w = Window.partitionBy("id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("slot") == s, F.col(value)), ignorenulls=True).over(w) for s in slots]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, slots)), F.array(*last)), lambda _, v: v.isNotNull() & (v != DELETE))


def previous(state: str = "state") -> Column:
    """The state before a turn; at the first turn empty."""
    return F.coalesce(F.lag(state).over(Window.partitionBy("id").orderBy("turn_id")), F.create_map().cast("map<string,string>"))


def history(c: str) -> Column:
    return F.collect_list(c).over(Window.partitionBy("id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, 0))


def last_duplicate(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def slot_prf(turns: DataFrame) -> DataFrame:
    """slot, tp, fp, fn and precision, recall, f1 over all turns (gold, pred: maps)."""
    both = turns.select("gold", "pred", F.explode(F.array_union(F.map_keys("gold"), F.map_keys("pred"))).alias("slot"))
    g, p = F.element_at("gold", F.col("slot")), F.element_at("pred", F.col("slot"))
    sums = both.groupBy("slot").agg(
        F.count(F.when(g == p, 1)).alias("tp"), F.count(F.when(g.isNull(), 1)).alias("fp"), F.count(F.when(g.isNotNull() & (F.coalesce(g != p, F.lit(True))), 1)).alias("fn")
    )
    pr, rc, f1 = prf(F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("fn").cast("double"))
    return sums.select("slot", "tp", "fp", "fn", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def turn_domain(turns: DataFrame, before: str, now: str, keys: list[str]) -> DataFrame:
    """``turns`` with ``changed``, the blocks (of ``keys``) that differ between two states, and ``domain``, what a turn is
    about: its first changed block, else what the turn before was about. At a dialogue's first turn it is the first block
    there is, else the first of ``keys``."""
    w = Window.partitionBy("id").orderBy("turn_id")
    there = F.get(F.filter(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(F.col(now), k)), F.lit(0))
    t = turns.withColumn("changed", changed_blocks(F.col(before), F.col(now), keys)).withColumn("_nth", F.row_number().over(w))
    clue = F.when(F.col("_nth") == 1, F.coalesce(there, F.lit(keys[0]))).otherwise(F.get("changed", F.lit(0)))
    return t.withColumn("domain", F.last(clue, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_nth")
