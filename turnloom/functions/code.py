"""States, their changes and prompts as code, and code back to states: columns, without Python a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import CODE_NAMES
from .prompting import DOMAIN_ORDER, message
from .state import once
from .text import DELETE, first_value, fix_typos

#: Slots (without their domain) that hold whole numbers, and those that hold yes or no.
WHOLE = ("book stay", "book people")
OPTIONS = ("parking", "internet")
#: What stands for a turn that changes nothing.
NO_CHANGE = "agent.state.update({})  # no change"

_STRING = r'''"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*\''''
_REFERENCE = r"(?:agent\.)?state\.\w+\.\w+"
_VALUE = rf"(?:{_STRING}|(?:0|[1-9][0-9]*)(?![0-9])|None|True|False|{_REFERENCE})"


def _domain(slot: Column) -> Column:
    return F.split_part(slot, F.lit("-"), F.lit(1))


def _name(slot: Column) -> Column:
    return F.substring(slot, F.length(_domain(slot)) + 2, F.length(slot))


def _renamed(c: Column, names: dict[str, str], old: str, new: str) -> Column:
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(known, c), F.replace(c, F.lit(old), F.lit(new)))


def code_name(c: Column) -> Column:
    return _renamed(c, CODE_NAMES, " ", "_")


def slot_name(c: Column) -> Column:
    return _renamed(c, {v: k for k, v in CODE_NAMES.items()}, "_", " ")


def _ordered(m: Column) -> Column:
    """Entries by their domain's place, then by slot."""
    place = lambda e: F.coalesce(F.array_position(F.array(*map(F.lit, DOMAIN_ORDER)), _domain(e["key"])), F.lit(0))
    last = len(DOMAIN_ORDER) + 1
    at = lambda e: F.when(place(e) == 0, F.lit(last)).otherwise(place(e))
    keyed = F.transform(F.map_entries(m), lambda e: F.struct(at(e).cast("int").alias("at"), e["key"].alias("key"), e["value"].alias("value")))
    return F.array_sort(keyed)


def _known(prior: Column, texts: Column) -> dict[str, Column]:
    """What references are looked up in: the prior's entries in order (first values, names, lower case), and the texts."""
    held = F.transform(_ordered(prior), lambda e: F.struct(e["key"].alias("key"), _name(e["key"]).alias("name"), first_value(e["value"]).alias("value"), F.lower(first_value(e["value"])).alias("low")))
    return {"held": held, "texts": texts, "mended": F.transform(texts, lambda t: fix_typos(t))}


def _refers(slot: Column, value: Column, known: Column) -> Column:
    name = _name(slot)
    first = lambda found: F.get(F.filter(known["held"], found), F.lit(0))["key"]
    word = F.exists(known["texts"], lambda t: F.contains(t, F.concat(F.lit(" "), value, F.lit(" "))))
    said = F.exists(known["mended"], lambda t: F.contains(t, value))
    centre = (name == "area") & (value == "centre") & F.exists(known["texts"], lambda t: F.contains(t, F.lit("center")))
    alike = F.when(~word, first(lambda e: (e["name"] == name) & (e["value"] == value)))
    same = first(lambda e: e["low"] == F.lower(value))
    return F.when(value.isin("dontcare", DELETE), None).when(name.isin(*WHOLE, *OPTIONS), alike).when(said | centre, None).otherwise(same)


def reference(slot: Column, value: Column, prior: Column, texts: Column) -> Column:
    """The slot of ``prior`` (a map) that a new value refers to, or null. Numbers and options refer to a slot of the same name
    alone, and not where a text says them as a word; other values not where one of ``texts``, its misspellings mended, says
    them. dontcare and deletions never refer. Of several slots the first by domain and name counts."""
    return once(lambda known: _refers(slot, value, known), **_known(prior, texts))


def _literal(slot: Column, value: Column) -> Column:
    whole = _name(slot).isin(*WHOLE) & value.rlike("^(0|[1-9][0-9]*)$")
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(whole, value).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def _path(slot: Column) -> Column:
    return F.concat(_domain(slot), F.lit("."), code_name(_name(slot)))


def statements(delta: Column, prior: Column, texts: Column) -> Column:
    """A delta as code: deletions, then a call a domain, in which a value that refers to the prior state is that reference."""

    def argument(e: Column, known: Column) -> Column:
        refers = _refers(e["key"], e["value"], known)
        return F.concat(code_name(_name(e["key"])), F.lit("="), F.coalesce(F.concat(F.lit("agent.state."), _path(refers)), _literal(e["key"], e["value"])))

    def written_out(known: Column) -> Column:
        gone = F.transform(F.filter(known["delta"], lambda e: e["value"] == DELETE), lambda e: F.concat(F.lit("del agent.state."), _path(e["key"])))
        kept = F.filter(known["delta"], lambda e: e["value"] != DELETE)
        args = F.transform(kept, lambda e: F.struct(_domain(e["key"]).alias("domain"), argument(e, known).alias("argument")))
        return once(lambda x: F.concat(x["gone"], calls(x["args"])), gone=gone, args=args)

    def calls(args: Column) -> Column:
        listed = lambda d: F.array_join(F.transform(F.filter(args, lambda a: a["domain"] == d), lambda a: a["argument"]), ", ")
        domains = F.array_distinct(F.transform(args, lambda a: a["domain"]))
        return F.transform(domains, lambda d: F.concat(F.lit("agent.state."), d, F.lit(" = agent.find_"), d, F.lit("("), listed(d), F.lit(")")))

    lines = once(written_out, delta=_ordered(delta), **_known(prior, texts))
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit(NO_CHANGE))


def reference_values(delta: Column, prior: Column, texts: Column, domains: tuple[str, ...], prefix: str = "state.", separator: str = ".") -> Column:
    """slot-value strings of a delta (of ``domains``), in which a value that refers to the prior state is that reference.
    Sentinels follow their slot without a dash."""
    entries = F.array_sort(F.map_entries(F.map_filter(delta, lambda k, _: _domain(k).isin(*domains))))

    def one(e: Column, known: Column) -> Column:
        r = _refers(e["key"], e["value"], known)
        value = F.coalesce(F.concat(F.lit(prefix), _domain(r), F.lit(separator), code_name(_name(r))), e["value"])
        return F.concat(e["key"], F.when(value.isin("none", "dontcare"), "").otherwise("-"), value)

    return once(lambda known: F.transform(known["entries"], lambda e: one(e, known)), entries=entries, **_known(prior, texts))


def state_code(prior: Column) -> Column:
    """A prior state as the statement that restores it, of several values the first; whole numbers and references to slots
    stand unquoted."""
    entries = _ordered(F.transform_values(prior, lambda _, v: first_value(v)))
    json = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    pair = lambda e: F.concat(json(code_name(_name(e["key"]))), F.lit(": "), F.when(e["value"].rlike(r"^(0|[1-9][0-9]*|state\..*)$"), e["value"]).otherwise(json(e["value"])))
    domains = F.array_distinct(F.transform(entries, lambda e: _domain(e["key"])))
    block = lambda d: F.concat(json(d), F.lit(": {"), F.array_join(F.transform(F.filter(entries, lambda e: _domain(e["key"]) == d), pair), ", "), F.lit("}"))
    return F.concat(F.lit("agent.state = BeliefState.from_dict({"), F.array_join(F.transform(domains, block), ", "), F.lit("})"))


def turn_code(prior: Column, sys: Column, usr: Column) -> Column:
    """A turn as code: the prior state, what the system said (unless it was silent), what the user said."""
    silent = F.coalesce(sys, F.lit("none")).isin("none", "")
    system = F.when(silent, "").otherwise(F.concat(F.lit('    print("system: '), sys, F.lit('")\n')))
    return F.concat(F.lit("    "), state_code(prior), F.lit("\n"), system, F.lit('    print("user: '), usr, F.lit('")\n'))


def code_prompt(system: str, preamble: str, examples: Column, context: Column, sys: Column, usr: Column, reverse: bool = False) -> Column:
    """Messages of a prompt in code: numbered examples (an array of context, sys, usr, delta; worst first), then the query
    turn. With ``reverse`` examples go from the statements to the turn, and the query turn is left empty."""
    title = lambda n: F.concat(F.lit("\n    #### Example "), n.cast("string"), F.lit(" ####\n"))

    def shot(x: Column, i: Column) -> Column:
        heard = F.array(F.when(x["sys"] == "none", "").otherwise(F.coalesce(x["sys"], F.lit(""))), x["usr"])
        does = F.concat(F.lit("    "), F.regexp_replace(statements(x["delta"], x["context"], heard), "\n", "\n    "), F.lit("\n"))
        turn = turn_code(x["context"], x["sys"], x["usr"])
        asked, answer = (does, turn) if reverse else (turn, does)
        return F.array(message("user", F.concat(title(i + 1), asked)), message("assistant", answer))

    shots = F.flatten(F.transform(examples, shot))
    last = F.concat(title(F.size(examples) + 1), F.lit("") if reverse else turn_code(context, sys, usr))
    every = F.concat(shots, F.array(message("user", last)))
    if preamble:
        every = F.transform(every, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(F.lit(f"{preamble}    \n"), m["content"])).otherwise(m["content"]).alias("content")))
    return F.concat(F.array(message("system", F.lit(system))), every)


def _resolved(value: Column, state: Column) -> Column:
    """What an expression stands for in a state: a literal's text, or what it refers to; null for None and unknown slots."""
    refers = value.rlike(f"^{_REFERENCE}$")
    part = lambda i: F.regexp_extract(value, r"state\.(\w+)\.(\w+)$", i)
    known = F.element_at(state, F.concat(part(1), F.lit("-"), slot_name(part(2))))
    plain = F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"""\\(["'\\])""", "$1")
    return F.when(value == "None", None).when(refers, known).when(value.rlike("""^["']"""), plain).otherwise(value)


def parsed_code(text: Column, state: Column) -> Column:
    """The full state after statements like ``hotel = agent.find_hotel(area="north")`` and ``del agent.state.hotel.area``: a fold
    over the lines. A call merges its arguments into the domain; values are strings (with escaped quotes and backslashes),
    whole numbers, None, True, False, or references into the state so far. The first statement may lack its
    ``agent.state.``; a line that is no such statement ends the parse with the state so far."""
    lines = F.transform(F.split(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.transform(lines, lambda x, i: F.when((i == 0) & ~x.rlike(r"^(agent\.|state\.|del )"), F.concat(F.lit("agent.state."), x)).otherwise(x))
    lines = F.filter(lines, lambda x: x != "")
    target = r"(?:agent\.)?state\.(\w+)"
    one, call = rf"^{target}\.(\w+)\s*=\s*({_VALUE})$", rf"^{target}\s*=\s*agent\.find_\1\(\s*((?:\w+\s*=\s*{_VALUE}\s*(?:,\s*(?=\w)|,?\s*$|,?\s*(?=\))))*)\)$"
    gone = r"^del\s+(?:agent\.)?state\.(\w+)\.(\w+)$"

    def step(now: Column, line: Column) -> Column:
        at = lambda pattern, i: F.regexp_extract(line, pattern, i)
        listed = lambda i: F.regexp_extract_all(at(call, 2), F.lit(rf"(\w+)\s*=\s*({_VALUE})"), F.lit(i))
        made = lambda domain, name, value: F.struct(F.concat(domain, F.lit("-"), slot_name(name)).alias("key"), value.alias("value"))
        new = (
            F.when(line.rlike(gone), F.array(made(at(gone, 1), at(gone, 2), F.lit(DELETE))))
            .when(line.rlike(one), F.array(made(at(one, 1), at(one, 2), _resolved(at(one, 3), now["state"]))))
            .when(line.rlike(call), F.zip_with(listed(1), listed(2), lambda n, v: made(at(call, 1), n, _resolved(v, now["state"]))))
        )

        def merged(x: Column) -> Column:
            kept = F.map_filter(x["state"], lambda k, _: ~F.map_contains_key(x["added"], k))
            return F.struct(F.when(x["ended"], x["state"]).otherwise(F.map_concat(kept, x["added"])).alias("state"), x["ended"].alias("ended"))

        def added(x: Column) -> Column:
            held = F.filter(F.coalesce(x["new"], F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["value"].isNotNull())
            return once(merged, state=x["state"], added=F.map_from_entries(held), ended=x["ended"] | x["new"].isNull())

        return once(added, new=new, state=now["state"], ended=now["ended"])

    return F.aggregate(lines, F.struct(state.alias("state"), F.lit(False).alias("ended")), step, lambda x: x["state"])
