"""Annotated belief states of a corpus as a vector of bits and a list of slot-value pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains with their booking and their search slots, in the order of the vector (94 bits).
LAYOUT = (
    ("taxi", ("booked",), ("leaveAt", "destination", "departure", "arriveBy")),
    ("restaurant", ("booked", "day", "people", "time"), ("food", "pricerange", "name", "area")),
    ("hospital", ("booked",), ("department",)),
    ("hotel", ("booked", "day", "people", "stay"), ("name", "area", "parking", "pricerange", "stars", "internet", "type")),
    ("attraction", ("booked",), ("type", "name", "area")),
    ("train", ("booked", "people", "ticket"), ("leaveAt", "destination", "day", "arriveBy", "departure")),
    ("police", ("booked",), ()),
)
#: What says that any value will do, and spellings that differ between versions of the ontology.
ANY = ("dont care", "dontcare", "don't care", "do not care")
SPELLINGS = {"night club": "nightclub", "concerthall": "concert hall"}

META = "map<string,struct<book:map<string,string>,semi:map<string,string>>>"


def _plain(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, "[<>]", "|")))


def belief_summary(meta: Column, layout: Sequence = LAYOUT, clean: Callable[[Column], Column] = lambda c: c) -> Column:
    """bits, active (domains) and pairs (slot, value) of a state of the type META.

    A domain gives a bit a booking slot (it has a value; an empty list is none), three a search slot (not mentioned, any,
    a value), and one if any of those three-bit groups says something. A slot or domain that is absent gives zeros; so
    does an empty value of a search slot. A null state gives zeros, no domain and no pair.
    """
    bits, active, pairs = [], [], []
    spelled = F.create_map(*(F.lit(x) for kv in SPELLINGS.items() for x in kv))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    for domain, book, semi in layout:
        block, groups = F.element_at(meta, F.lit(domain)), []
        for slot in book:
            v = F.element_at(block["book"], F.lit(slot))
            filled = (v != "") & ((v != "[]") if slot == "booked" else F.lit(True))
            bits.append(one(filled))
            if slot != "booked":
                pairs.append(F.when(filled, F.struct(F.lit(f"{domain}-book {slot.lower()}").alias("slot"), clean(_plain(v)).alias("value"))))
        for slot in semi:
            v = F.element_at(block["semi"], F.lit(slot))
            silent, free = v == "not mentioned", v.isin(*ANY)
            filled = ~silent & ~free & (v != "")
            groups += [one(silent), one(free), one(filled)]
            value = clean(_plain(v))
            value = F.coalesce(F.element_at(spelled, value), value)
            pairs.append(F.when(free | filled, F.struct(F.lit(f"{domain}-{slot.lower()}").alias("slot"), F.when(free, F.lit("dontcare")).otherwise(value).alias("value"))))
        says = F.greatest(*groups, F.lit(0)) if groups else F.lit(0)
        bits += [*groups, says]
        active.append(F.when(says == 1, F.lit(domain)))
    return F.struct(F.array(*bits).alias("bits"), F.array_compact(F.array(*active)).alias("active"), F.array_compact(F.array(*pairs)).alias("pairs"))
