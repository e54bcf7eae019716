"""Turn texts as Column builders: projections, value cleaning, labels, times and slugs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETE = "[DELETE]"
#: The domains whose slots count.
DOMAINS = ("hotel", "restaurant", "attraction", "taxi", "train")
#: Whole values that are replaced after cleaning.
VALUE_REPLACEMENTS = {
    "center": "centre",
    "caffe uno": "cafe uno",
    "caffee uno": "cafe uno",
    "christs college": "christ college",
    "cambridge belfy": "cambridge belfry",
    "churchill college": "churchills college",
    "sat": "saturday",
    "saint johns chop shop house": "saint johns chop house",
    "good luck chinese food takeaway": "good luck",
    "asian": "asian oriental",
    "gallery at 12": "gallery at 12 a high street",
}
#: Misspellings that are mended inside values.
TYPOS = {
    "fen ditton": "fenditton",
    "guesthouse": "guest house",
    "steveage": "stevenage",
    "stantsted": "stansted",
    "storthford": "stortford",
    "shortford": "stortford",
    "weish": "welsh",
    "bringham": "birmingham",
    "birminggam": "birmingham",
    "boxbourne": "broxbourne",
    "gardina": "gardiena",
    "liverpoool": "liverpool",
    "petersborough": "peterborough",
    "el shaddai": "el shaddia",
    "wendesday": "wednesday",
    "brazliian": "brazilian",
    "graffton": "grafton",
}


def label(dialogue: Column, turn: Column) -> Column:
    return F.concat_ws("_turn_", dialogue.cast("string"), turn.cast("string"))


def label_dialogue(c: Column) -> Column:
    """The dialogue of a label; ids may hold underscores, so the last separator counts."""
    return F.regexp_extract(c, r"^(.*)_turn_\d+$", 1)


def label_turn(c: Column) -> Column:
    return F.regexp_extract(c, r"_turn_(\d+)$", 1).cast("int")


def first_value(c: Column) -> Column:
    """The first of alternatives written a|b."""
    return F.split_part(c, F.lit("|"), F.lit(1))


def first_values(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: first_value(v))


def blank_none(c: Column) -> Column:
    return F.when(c == "none", "").otherwise(c)


def spelled_state(m: Column, prefix: str) -> Column:
    """``prefix`` and "domain slot: value, " for each entry, in the order of slots."""
    entries = F.array_sort(F.map_entries(m))
    parts = F.transform(entries, lambda e: F.concat(F.replace(e["key"], F.lit("-"), F.lit(" ")), F.lit(": "), first_value(e["value"]), F.lit(", ")))
    return F.concat(F.lit(prefix), F.array_join(parts, ""))


def slot_names(m: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.array_join(F.array_sort(F.map_keys(m)), ", "))


def input_text(context: Column | None, sys: Column, usr: Column) -> Column:
    head = spelled_state(context, "[CONTEXT] ") if context is not None else F.lit("[CONTEXT] ")
    return F.concat(head, F.lit(" [SYS] "), blank_none(sys), F.lit(" [USER] "), blank_none(usr))


def truth_suffix(kind: str | None, full: Column, delta: Column) -> Column:
    """The gold suffix of a turn's text: full or delta state, with values or slot names alone."""
    if kind is None:
        return F.lit("")
    builders = {
        "gt_full_bs": lambda: spelled_state(full, " [BS] "),
        "gt_full_slot": lambda: slot_names(full, " [BS] "),
        "gt_delta_bs": lambda: spelled_state(delta, " [BS] "),
        "gt_delta_slot": lambda: slot_names(delta, " [BS] "),
    }
    if kind not in builders:
        raise ValueError(f"unsupported ground truth type: {kind}")
    return builders[kind]()


def turn_text(input_type: str = "dialog_context", *, sys: str = "sys", usr: str = "usr", context: str = "last_slot_values", full: str = "slot_values", delta: str = "turn_slot_values", full_history: bool = False, only_slot: bool = False, gt_type: str | None = None) -> Column:
    """The text of a turn for retrieval. ``sys`` and ``usr`` are array columns, the history up to the turn."""
    s, u, c = F.col(sys), F.col(usr), F.col(context)
    gold = truth_suffix(gt_type, F.col(full), F.col(delta))
    last_s, last_u = F.element_at(s, -1), F.element_at(u, -1)

    def history(s: Column, u: Column) -> Column:
        return F.array_join(F.transform(F.arrays_zip(s.alias("s"), u.alias("u")), lambda p: input_text(None, p["s"], p["u"])), "")

    if input_type == "dialog_context":
        if full_history:
            return F.concat(history(s, u), gold)
        if only_slot:
            return F.concat(slot_names(c, "[CONTEXT] "), F.lit(" [SYS] "), blank_none(last_s), F.lit(" [USER] "), blank_none(last_u), gold)
        return F.concat(input_text(c, last_s, last_u), gold)
    if input_type == "context":
        if full_history:
            before = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)
            return F.when(F.size(s) == 1, "[CONTEXT]  [SYS]  [USER] ").otherwise(F.concat(history(before(s), before(u)), gold))
        if only_slot:
            return F.concat(slot_names(c, "[CONTEXT] "), F.lit(" [SYS]  [USER] "), gold)
        return F.concat(input_text(c, F.lit(""), F.lit("")), gold)
    if input_type == "dialog":
        return F.concat(input_text(None, last_s, last_u), gold)
    if "gt" in input_type:
        return truth_suffix(input_type, F.col(full), F.col(delta))
    raise ValueError(f"unsupported input_type: {input_type}")


def important_values(delta: Column, domains: tuple[str, ...] | None = DOMAINS) -> Column:
    """slot-value strings of a delta; sentinels follow their slot without a dash."""
    m = delta if domains is None else F.map_filter(delta, lambda k, _: F.split_part(k, F.lit("-"), F.lit(1)).isin(*domains))
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.when(e["value"].isin("none", "dontcare"), "").otherwise("-"), e["value"]))


def spaced(c: Column, token: str) -> Column:
    """Spaces around a one-character token, except between digits."""
    t = {"?": r"\?", ".": r"\.", "!": "!", ",": ","}[token]
    return F.regexp_replace(F.regexp_replace(c, rf"(?<=[^ ])(?!(?<=\d){t}\d)(?={t})", " "), rf"(?<!\d){t}(?=[^ ])|{t}(?=[^ \d])", f"{token} ")


#: Neighbouring words of digits alone become one: each gets a mark at both ends (noncharacters, which no text has), the space
#: between two marks goes, then the marks.
JOINED = ((r"(?<!\S)(\d+)(?!\S)", "\ufdd0$1\ufdd1"), ("\ufdd1\\s+\ufdd0", ""), ("[\ufdd0\ufdd1]", ""))


def normalize(c: Column) -> Column:
    """A surface value in canonical spelling: case, spacing, punctuation, adjoining numbers and known variants."""
    c = F.lower(c)
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    for old, new in (("b&b", "bed and breakfast"), ("b and b", "bed and breakfast"), ("guesthouse", "guest house")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, "[‘’]", "'")
    for old, new in ((";", ","), ("/", " and "), ("-", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, r'["<>@()]', "")
    for token in "?.,!":
        c = spaced(c, token)
    c = F.regexp_replace(c, r"(?<=[^ ])(?='s)", " ")
    c = F.regexp_replace(c, r"'s(?=[^ ])", "'s ")
    for old, new in ((r"^'", ""), (r"'$", ""), (r"'\s", " "), (r"\s'", " "), (r" +", " "), *JOINED, (r"^\s+|\s+$", ""), (r"\s+", " "), (r" s ", "s "), (r" s$", "s")):
        c = F.regexp_replace(c, old, new)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in VALUE_REPLACEMENTS.items() for x in kv)), c), c)


#: How phone numbers and postcodes are written in dialogues; their parts are put together.
PHONE = r"\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4,5})"
POSTCODE = r"([a-z])[. ]?([a-z])[. ]?(\d{1,2})[, ]+(\d)[. ]?([a-z])[. ]?([a-z])"


def clean_text(c: Column, pairs: Sequence[tuple[str, str]] = ()) -> Column:
    """A dialogue text as it is put on file: case, phone numbers, postcodes, spacing, punctuation, ``pairs`` of words mended one
    after the other, and adjoining numbers of any length put together."""
    c = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    for old, new in (("b&b", "bed and breakfast"), ("b and b", "bed and breakfast"), ("guesthouse", "guest house")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(F.regexp_replace(c, PHONE, "$1$2$3"), POSTCODE, "$1$2$3$4$5$6")
    c = F.regexp_replace(c, "[‘’]", "'")
    for old, new in ((";", ","), ("/", " and "), ("-", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, r'["<>@()]', "")
    for token in "?.,!":
        c = spaced(c, token)
    c = F.regexp_replace(F.regexp_replace(c, r"(?<=[^ ])(?='s)", " "), r"'s(?=[^ ])", "'s ")
    for old, new in ((r"^'", ""), (r"'$", ""), (r"'\s", " "), (r"\s'", " ")):
        c = F.regexp_replace(c, old, new)
    c = mended(c, pairs)
    for old, new in (*JOINED, (r"^\s+|\s+$", ""), (r"\s+", " ")):
        c = F.regexp_replace(c, old, new)
    return c


def fix_typos(c: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), TYPOS.items(), c)


def is_time(c: Column) -> Column:
    return c.rlike(r"^([0-1]?[0-9]|2[0-4]):[0-5][0-9]$")


def canonical_time(c: Column) -> Column:
    """A time as hh:mm, dontcare, or null."""
    padded = F.when(c.contains(":") & (F.length(c) < 5), F.concat(F.lit("0"), c)).otherwise(c)
    return F.when(is_time(padded) | (padded == "dontcare"), padded)


def slug(c: Column) -> Column:
    c = F.replace(F.trim(c), F.lit("%"), F.lit("p"))
    c = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.+-]+", "_"), "_+", "_")
    c = F.lower(F.regexp_replace(c, r"^[._-]+|[._-]+$", ""))
    return F.when(F.coalesce(c, F.lit("")) == "", "none").otherwise(c)


def ascii_only(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def mended(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """A text in which each first of a pair, where it stands between spaces or at an end, is replaced by the second, pair
    after pair. Of two in a row that share a space only the first is."""
    for a, b in pairs:
        text = F.replace(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {a} "), F.lit(f" {b} "))
        text = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
    return text
