"""Completions to state pairs, by grammar: model output is never evaluated."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .state import once

_PAIR = r"""\{?\s*(?:'([^']*)'|"([^"]*)")\s*:\s*(?:'([^']*)'|"([^"]*)"|(-?[0-9.]+))\s*\}?"""


def parse_pairs(c: str | Column) -> Column:
    """Map of a completion in dictionary form, JVM-side: quoted keys, quoted or plain numeric values; the last of equal
    keys counts; text that isn't a pair is passed over."""
    c = F.col(c) if isinstance(c, str) else c
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y))

    def read(t: Column) -> Column:
        group = lambda i: F.regexp_extract_all(t["text"], F.lit(_PAIR), F.lit(i))
        return once(last, pairs=F.arrays_zip(both(group(1), group(2)).alias("key"), both(both(group(3), group(4)), group(5)).alias("value")))

    def last(x: Column) -> Column:
        after = lambda i: F.slice(x["pairs"], i + 2, F.greatest(F.size(x["pairs"]) - i - 1, F.lit(0)))
        return F.map_from_entries(F.filter(x["pairs"], lambda p, i: ~F.exists(after(i), lambda r: r["key"] == p["key"])))

    return once(read, text=c)


def parse_nl_completion(text: str, slots: frozenset[str] | None = None) -> dict[str, str]:
    """Pairs of a dictionary-like completion, split at commas; what follows the first malformed pair is dropped, and
    unknown slots are skipped if ``slots`` is given."""
    out: dict[str, str] = {}
    for part in text.strip().replace("{", "").replace("}", "").split(","):
        key, _, value = part.partition(":")
        try:
            k, v = ast.literal_eval(key.strip()), str(ast.literal_eval(value.strip()))
        except (ValueError, SyntaxError, MemoryError):
            return out
        if slots is None or k in slots:
            out[str(k)] = v
    return out


_ASSIGN = re.compile(r"^(?:agent\.)?state\.(\w+)(?:\.(\w+))?\s*=\s*(.+)$")
_DELETE = re.compile(r"^del\s+(?:agent\.)?state\.(\w+)\.(\w+)$")
_REFERENCE = re.compile(r"^(?:agent\.)?state\.(\w+)\.(\w+)$")
#: Names of slots in code, by slot.
CODE_NAMES = {"leaveat": "depart_time", "arriveby": "arrive_by_time", "book stay": "book_number_of_days", "food": "food_type", "departure": "leave_from", "pricerange": "price_range"}
_SLOT_NAMES = {v: k for k, v in CODE_NAMES.items()}


def code_name(slot: str) -> str:
    return CODE_NAMES.get(slot, slot.replace(" ", "_"))


def slot_name(code: str) -> str:
    return _SLOT_NAMES.get(code, code.replace("_", " "))


def parse_python_completion(text: str, state: dict[str, str]) -> dict[str, str]:
    """The full state after statements like ``hotel = agent.find_hotel(area="north")`` and ``del agent.state.hotel.area``.

    A call merges its arguments into the domain; values may be literals or references into the state. The first
    statement may lack its ``agent.state.``; anything else ends the parse with the state so far.
    """
    now = dict(state)

    def value(node: ast.expr) -> str | None:
        if isinstance(node, ast.Constant):
            return None if node.value is None else str(node.value)
        m = _REFERENCE.match(ast.unparse(node))
        if not m:
            raise ValueError("neither a literal nor a reference")
        return now.get(f"{m[1]}-{slot_name(m[2])}")

    for i, line in enumerate(text.strip().splitlines()):
        line = line.strip()
        if i == 0 and not line.startswith(("agent.", "state.", "del ")):
            line = "agent.state." + line
        if not line:
            continue
        try:
            if m := _DELETE.match(line):
                now[f"{m[1]}-{slot_name(m[2])}"] = "[DELETE]"
            elif m := _ASSIGN.match(line):
                node = ast.parse(m[3], mode="eval").body
                if m[2]:
                    got = {m[2]: value(node)}
                elif isinstance(node, ast.Call) and ast.unparse(node.func) == f"agent.find_{m[1]}" and not node.args:
                    got = {k.arg: value(k.value) for k in node.keywords if k.arg}
                else:
                    return now
                now |= {f"{m[1]}-{slot_name(k)}": v for k, v in got.items() if v is not None}
            else:
                return now
        except (ValueError, SyntaxError):
            return now
    return now
