"""Which dialogues, turns and slots take part."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_only, n_words


def _set(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)) if (values := sorted(set(values))) else F.array().cast("array<string>")


def within(turns: DataFrame, dialogue: str, domain: str, allowed: Iterable[str]) -> DataFrame:
    """The dialogues (id) of ``turns``, a row a dialogue and domain, all of whose domains are ``allowed``; null domains don't
    count, so a dialogue without any stays."""
    outside = F.max(F.coalesce(~F.array_contains(_set(allowed), F.col(domain)), F.lit(False)))
    return turns.groupBy(F.col(dialogue).alias("id")).agg(outside.alias("outside")).where("not outside").select("id")


def having_any(turns: DataFrame, dialogue: str, service: str, wanted: Iterable[str]) -> DataFrame:
    """id and n (the rows) of dialogues with at least one of the ``wanted`` services."""
    some = F.max(F.coalesce(F.array_contains(_set(wanted), F.col(service)), F.lit(False)))
    return turns.groupBy(F.col(dialogue).alias("id")).agg(F.count("*").alias("n"), some.alias("some")).where("some").select("id", "n")


def valid_dialogues(turns: DataFrame, dialogue: str, text: str, words: int = 50) -> DataFrame:
    """id and n of dialogues of an even number of turns, none longer than ``words`` words or with a character beyond ASCII.
    Null texts have neither words nor characters."""
    said = F.coalesce(F.col(text), F.lit(""))
    sums = turns.groupBy(F.col(dialogue).alias("id")).agg(F.count("*").alias("n"), F.max(n_words(said)).alias("words"), F.bool_and(ascii_only(said)).alias("ascii"))
    return sums.where((F.col("n") % 2 == 0) & (F.col("words") <= words) & F.col("ascii")).select("id", "n")


def valid_slots(state: Column, slots: Iterable[str]) -> Column:
    """A state without the slots that aren't known."""
    known = _set(slots)
    return F.map_filter(state, lambda k, _: F.array_contains(known, k))


def of_runs(logs: DataFrame, turns: DataFrame) -> DataFrame:
    """``logs`` (run, id, turn_id, ...) of the turns that each run is to have: ``turns`` (run, id, turn_id). A run that has no
    rows there is left as it is."""
    some = turns.select("run").distinct().withColumn("_some", F.lit(True))
    keyed = turns.select("run", "id", "turn_id").distinct().withColumn("_own", F.lit(True))
    both = logs.join(some, "run", "left").join(keyed, ["run", "id", "turn_id"], "left")
    return both.where(F.col("_some").isNull() | F.col("_own")).select(logs.columns)


def only_turns(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The turns (id, turn_id, ...) that ``ids`` (id, turn_id) names, such as those with coreferences; an action on them fails
    if one that is named isn't there, or is there twice."""
    named = ids.select("id", "turn_id").distinct()
    found = named.join(turns.withColumn("_there", F.lit(True)), ["id", "turn_id"], "left")
    n = F.count("_there").over(Window.partitionBy("id", "turn_id"))
    checked = found.withColumn("_n", n)
    fault = F.raise_error(F.concat_ws(" ", F.lit("not there just once:"), F.col("id").cast("string"), F.col("turn_id").cast("string"))).cast("boolean")
    return checked.where(F.when(F.col("_n") != 1, fault).otherwise(True)).select(turns.columns)


def collisions(outputs: DataFrame, path: str, source: str) -> DataFrame:
    """path and sources (in order) of the paths that more than one row of ``outputs`` would write."""
    sums = outputs.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(source)).alias("sources"))
    return sums.where("n > 1").select("path", "sources")
