"""Completions as a resumable plan: prompts are keyed by their content, answers are kept in a table, and only prompts whose
key the table lacks reach the model. Retries are part of the plan: a prompt that is too long loses its worst example, one that
fails or whose answer doesn't parse is asked again, each under a key of its own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompting
from ..functions.parsing import parse_pairs
from ..functions.state import once, same, update
from ..functions.text import first_value
from ..shared import shared_dir, written
from .sampling import permutations
from .scoring import select_examples

Model = Callable[[list[dict]], dict[str, float]]
#: What the table of answers holds; status is ok, too_long, failed or unparsed.
STORE = "key string, status string, completions map<string,double>"


def _asking(model: Model, parse: Callable[[str], object] | None, spacing: float):
    """What a task does with its prompts, one after the other, ``spacing`` seconds apart at least."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for b in batches:
            rows = []
            for key, prompt in zip(b["key"], b["prompt"]):
                time.sleep(max(0.0, last + spacing - time.monotonic()))
                last = time.monotonic()
                completions, status = None, "ok"
                try:
                    completions = model(json.loads(prompt))
                except prompting.TooLong:
                    status = "too_long"
                except ValueError:
                    raise  # a fault of the configuration, which no retry mends
                except Exception:
                    status = "failed"
                if completions is not None and parse is not None:
                    try:
                        parse(max(completions, key=completions.get))
                    except Exception:
                        status = "unparsed"
                rows.append((key, status, completions))
            yield pd.DataFrame(rows, columns=["key", "status", "completions"])

    return ask


def answered(requests: DataFrame, keys: list[str], system: str, model: Model, store: str | None = None, parse: Callable[[str], object] | None = None, spacing: float = 0.0, batches: int = 1) -> DataFrame:
    """``keys``, status (ok or failed), best (the likeliest completion, null if it failed), completions and n_examples of each
    request: keys, context (a map), sys, usr, and examples (an array of context, sys, usr, delta; worst first).

    ``store`` is the folder of the table of answers (a new one if not given). Answers are appended in ``batches`` jobs a round,
    so a run that was killed goes on behind the last one. Equal prompts are asked once. A request fails after ATTEMPTS
    answers that don't parse, or as many other faults (too long ones among them); a ValueError of the model ends the run.
    """
    spark = requests.sparkSession
    store = store or shared_dir(spark, "answers")
    spark.createDataFrame([], STORE).write.mode("append").parquet(store)
    left = requests.select(*keys, "examples", "context", "sys", "usr", F.lit(0).alias("unparsed"), F.lit(0).alias("faults"))
    out = []
    while True:
        prompt = F.to_json(prompting.chat_prompt(system, F.col("examples"), F.col("context"), F.col("sys"), F.col("usr")))
        asked = left.withColumn("prompt", prompt)
        asked = written(asked.withColumn("key", F.sha2(F.concat_ws("/", "prompt", "unparsed", "faults"), 256)), "asked")
        known = spark.read.schema(STORE).parquet(store).select("key")
        new = written(asked.select("key", "prompt").dropDuplicates(["key"]).join(known, "key", "left_anti"), "new")
        for i in range(batches):
            part = new.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == i)
            part.mapInPandas(_asking(model, parse, spacing), STORE).write.mode("append").parquet(store)
        got = written(asked.drop("prompt").join(spark.read.schema(STORE).parquet(store).dropDuplicates(["key"]), "key"), "got")
        out.append(got.where("status = 'ok'").select(*keys, "status", prompting.best_completion(F.col("completions")).alias("best"), "completions", F.size("examples").alias("n_examples")))
        unparsed = F.col("unparsed") + (F.col("status") == "unparsed").cast("int")
        faults = F.col("faults") + F.col("status").isin("too_long", "failed").cast("int")
        fewer = F.when(F.col("status") == "too_long", F.slice("examples", 2, F.greatest(F.size("examples"), F.lit(1)))).otherwise(F.col("examples"))
        rest = got.where("status <> 'ok'").select(*keys, fewer.alias("examples"), "context", "sys", "usr", unparsed.alias("unparsed"), faults.alias("faults"))
        ended = F.greatest("unparsed", "faults") >= prompting.ATTEMPTS
        out.append(rest.where(ended).select(*keys, F.lit("failed").alias("status"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("map<string,double>").alias("completions"), F.size("examples").alias("n_examples")))
        left = rest.where(~ended)
        if left.isEmpty():
            break
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _pairs(best: Column) -> Column:
    return F.coalesce(parse_pairs(best), F.create_map().cast("map<string,string>"))


def _after(context: Column, delta: Column) -> Column:
    """The state after a completion: its pairs over the context, of several values the first."""
    return once(lambda x: F.transform_values(update(x["context"], x["delta"]), lambda _, v: first_value(v)), context=context, delta=delta)


def run_dialogues(turns: DataFrame, system: str, model: Model, store: str | None = None, **how) -> DataFrame:
    """id, turn_id, context (the state predicted before), best, pred and n_examples of each of ``turns`` (id, turn_id, sys,
    usr, examples). A turn's context is what the turn before was predicted to leave, so turns are taken number by number, all
    dialogues at once; a dialogue that lacks a number keeps its state, and so does one whose request failed."""
    spark, store = turns.sparkSession, store or shared_dir(turns.sparkSession, "answers")
    empty = F.create_map().cast("map<string,string>")
    state = spark.createDataFrame([], turns.select("id").schema).withColumn("state", empty)
    out = None
    for number in [r.turn_id for r in turns.select("turn_id").distinct().orderBy("turn_id").collect()]:  # a row a number of turns
        now = turns.where(F.col("turn_id") == number).join(state, "id", "left").withColumn("context", F.coalesce("state", empty)).drop("state")
        now = written(now, "turn")
        said = answered(now, ["id", "turn_id"], system, model, store, **how)
        done = now.select("id", "turn_id", "context").join(said.select("id", "turn_id", "best", "n_examples"), ["id", "turn_id"])
        done = written(done.withColumn("pred", _after(F.col("context"), _pairs(F.col("best")))), "done")
        state = written(done.select("id", F.col("pred").alias("state")).unionByName(state.join(done.select("id"), "id", "left_anti")), "state")
        out = done if out is None else out.unionByName(done)
    return out if out is not None else turns.select("id", "turn_id").withColumns({"context": empty, "best": F.lit(""), "n_examples": F.lit(0), "pred": empty})


def scored_groups(members: DataFrame, group: int) -> DataFrame:
    """q, label, occurence, score_delta, score_full, influence_delta, influence_full, from ``members`` (q, label, iter, grp,
    delta, full): what a member's groups scored, and that less the other groups' scores over one less than the full groups
    of an iteration (nothing if there is one at most)."""
    groups = members.groupBy("q", "iter", "grp").agg(F.first("delta").alias("delta"), F.first("full").alias("full"), F.count("*").alias("n"))
    totals = groups.groupBy("q", "iter").agg(F.sum("delta").alias("all_delta"), F.sum("full").alias("all_full"), F.floor(F.sum("n") / group).alias("g"))
    each = members.join(totals, ["q", "iter"])
    gain = lambda c: F.col(c) - F.when(F.col("g") > 1, (F.col(f"all_{c}") - F.col(c)) / (F.col("g") - 1)).otherwise(0.0)
    sums = [F.round(F.sum(x), 6).cast("double").alias(name) for c in ("delta", "full") for name, x in ((f"score_{c}", F.col(c)), (f"influence_{c}", gain(c)))]
    return each.groupBy("q", "label").agg(F.count("*").alias("occurence"), *sums)


def _prompted(turns: DataFrame, examples: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """Requests from keys, label and place; a group is as large as it is configured."""
    shots = examples.select("label", F.struct("context", "sys", "usr", "delta").alias("shot"))
    in_place = lambda x: F.array_sort(x, lambda a, b: (a["place"] - b["place"]).cast("int"))
    listed = placed.join(shots, "label").groupBy(*keys).agg(in_place(F.collect_list(F.struct("place", "shot"))).alias("listed"))
    listed = listed.select(*keys, F.transform("listed", lambda x: x["shot"]).alias("examples"))
    return listed.join(turns.select("q", "context", "sys", "usr"), "q")


def generated_scores(turns: DataFrame, pool: DataFrame, examples: DataFrame, iterations: int, group: int, system: str, model: Model, store: str | None = None, **how) -> DataFrame:
    """``scored_groups`` of which examples help a turn; nothing is chosen, and no last prompt asked.

    ``turns``: q, sys, usr, context, gold_delta, gold; ``pool``: q, label, pos; ``examples``: label, context, sys, usr, delta.
    Each iteration's permutation of a pool is cut into groups, each group is a prompt, and its answer is right as a delta
    and as a whole state, or not.
    """
    members = written(permutations(pool, iterations).withColumn("grp", F.floor(F.col("out_pos") / group).cast("int")).select("q", "label", "iter", "grp", "out_pos"), "members")
    keys = ["q", "iter", "grp"]
    said = answered(_prompted(turns, examples, members.withColumnRenamed("out_pos", "place"), keys), keys, system, model, store, **how)
    both = said.join(turns.select("q", "context", "gold_delta", "gold"), "q")

    def compared(x: Column) -> Column:
        is_right = lambda a, b: same(a, b).cast("double")
        return F.struct(is_right(x["delta"], x["gold_delta"]).alias("delta"), is_right(_after(x["context"], x["delta"]), x["gold"]).alias("full"))

    right = both.select(*keys, once(compared, delta=_pairs(F.col("best")), **{c: F.col(c) for c in ("context", "gold_delta", "gold")}).alias("x"))
    right = written(right.select(*keys, "x.delta", "x.full"), "right")  # read twice by the sums
    return written(scored_groups(members.join(right, keys).select("q", "label", "iter", "grp", "delta", "full"), group), "scores")


def generate(turns: DataFrame, pool: DataFrame, examples: DataFrame, iterations: int, group: int, final: int, by: str, system: str, model: Model, store: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(scores, chosen): ``generated_scores``, and q, labels (the ``final`` best by the score named ``by``, worst first), pred
    (the state after a last prompt with those) and jga."""
    store = store or shared_dir(turns.sparkSession, "answers")
    scores = generated_scores(turns, pool, examples, iterations, group, system, model, store, **how)
    best = written(select_examples(scores, by, final).select("q", "label", "place"), "best")
    last = answered(_prompted(turns, examples, best, ["q"]), ["q"], system, model, store, **how).join(turns.select("q", "context", "gold"), "q")
    pred = last.select("q", _after(F.col("context"), _pairs(F.col("best"))).alias("pred"), "gold")
    labels = best.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("labels"))
    return scores, labels.join(pred, "q").select("q", "labels", "pred", same(F.col("pred"), F.col("gold")).cast("int").alias("jga"))
