"""Chat prompts as columns, states as code, and the model's place in a plan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import parse_nl_completion, parse_python_completion
from .text import blank_none, first_value

MESSAGE = "array<struct<role:string,content:string>>"
#: Formats whose completions are code, and what ends a completion of a format (others end with their turn).
CODE_FORMATS = ("python-prompt", "python-prompt-NULL")
STOPS = {"python-prompt": ["\n\n", "#", "print("]}
#: The order of domains in a prior state written as code.
DOMAIN_ORDER = ("hotel", "train", "attraction", "restaurant", "taxi", "hospital", "police")
#: Attempts at a completion that may fail to parse, and those that may fail otherwise.
ATTEMPTS = 5


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def state_text(m: Column) -> Column:
    """A state as a dictionary literal, slots in order."""
    e = F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(F.lit("'"), x["key"], F.lit("': '"), first_value(x["value"]), F.lit("'")))
    return F.concat(F.lit("{"), F.array_join(e, ", "), F.lit("}"))


def turn_message(context: Column, sys: Column, usr: Column) -> Column:
    return F.concat(F.lit("context: "), state_text(context), F.lit("\nsystem: "), blank_none(sys), F.lit("\nuser: "), blank_none(usr), F.lit("\nstate change:"))


def chat_prompt(system: str, examples: Column, context: Column, sys: Column, usr: Column) -> Column:
    """System message, a user and an assistant message for each example (structs of context, sys, usr, delta; worst
    first), and the query turn last."""
    shots = F.flatten(F.transform(examples, lambda x: F.array(message("user", turn_message(x["context"], x["sys"], x["usr"])), message("assistant", state_text(x["delta"])))))
    return F.concat(F.array(message("system", F.lit(system))), shots, F.array(message("user", turn_message(context, sys, usr))))


def model(complete: Callable[[list[dict]], dict[str, float]]) -> Callable[[Column], Column]:
    """A completion model as a column function of prompts: Arrow batches in, a map of completion to log probability out."""

    @F.pandas_udf("map<string,double>")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: complete([dict(m.asDict() if hasattr(m, "asDict") else m) for m in p]))

    return run


def stub(messages: list[dict]) -> dict[str, float]:
    """An offline stand-in for a model: it repeats the last example's answer."""
    said = [m["content"] for m in messages if m["role"] == "assistant"]
    return {said[-1] if said else "{}": 0.0}


def best_completion(c: Column) -> Column:
    """The likeliest completion (ties: the first), trimmed and without a leading ``agent.state.``; empty if there is none."""
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"))
    best = F.aggregate(F.map_entries(c), none, lambda a, x: F.when(x["value"].isNotNull() & (a["key"].isNull() | (x["value"] > a["value"])), x).otherwise(a))
    return F.regexp_replace(F.trim(F.coalesce(best["key"], F.lit(""))), r"^agent\.state\.", "")


def stopped(completion: Column, stops: list[str]) -> Column:
    """A completion up to the first of the stop sequences that it holds."""
    places = [F.when(F.locate(x, completion) > 0, F.locate(x, completion)) for x in stops if x]
    if not places:
        return completion
    first = F.array_min(F.array(*places))
    return F.when(first.isNull(), completion).otherwise(F.substring(completion, F.lit(1), first - 1))


def parser_of(prompt_format: str, slots: frozenset[str] | None = None) -> Callable[[str, dict[str, str]], dict[str, str]]:
    """(completion, prior state) to the parsed pairs, by the format's name: code, else pairs, which are checked against the
    known slots unless the format is one of services (sgd)."""
    if prompt_format in CODE_FORMATS:
        return parse_python_completion
    known = None if "sgd" in prompt_format.lower() else slots
    return lambda text, prior: parse_nl_completion(text, known)


class TooLong(Exception):
    """A model raises this for a prompt that exceeds its window."""
