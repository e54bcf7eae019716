"""Alignment against the standard library's, and the query against plain Python."""

from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions import align
from turnloom.plans import catalog
from turnloom.plans import fixtures as fx

TOKENS = st.lists(st.sampled_from("a b c d".split()), max_size=14)


def plain(a, b):
    return [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]


@settings(max_examples=400, deadline=None)
@given(TOKENS, TOKENS)
def test_blocks(a, b):
    assert align.blocks(a, b) == plain(a, b)


def test_long_lists():
    a = [f"w{i % 97}" for i in range(3000)]
    assert align.blocks(a, a) == [(0, 0, 3000)] and align.blocks(a, a[100:]) == plain(a, a[100:])


def test_columns(spark):
    rows = [("i want [value] in the [area] now".split(), "i want cheap food in the north part now".split()), (None, ["a"]), ([], []), (["a"], ["b"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select(align.matching_blocks(F.col("a"), F.col("b")).alias("m"), align.filled(F.col("a"), F.col("b")).alias("f")).collect()
    assert [tuple(x) for x in got[0].m] == [(0, 0, 2), (3, 4, 2), (6, 8, 1)] and got[0].f == {2: "cheap food", 5: "north part"}
    assert all(x.m == [] and x.f == {} for x in got[1:])


def test_aligned_turns(spark):
    sf = "/root/testdata/sf0.001"
    said = {(r.id, r.turn_id): (r.sys.lower().split(), r.usr.lower().split()) for r in fx.conversation_turns(spark, sf).collect()}
    rows = catalog.queries()["aligned_turns"](spark, sf).collect()
    assert len(rows) == len(said) and any(r.blocks for r in rows)
    for r in rows:
        assert r.blocks == ";".join(f"{i}:{j}:{n}" for i, j, n in plain(*said[r.id, r.turn_id]))
