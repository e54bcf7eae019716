"""Filters of dialogues, turns and slots, by hand."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators import filters


def test_domains_and_services(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (4, "a"), (4, "c")], "id int, d string")
    assert sorted(r.id for r in filters.within(d, "id", "d", ["a", "b"]).collect()) == [1, 3]
    assert sorted(r.id for r in filters.within(d, "id", "d", []).collect()) == [3]
    assert sorted((r.id, r.n) for r in filters.having_any(d, "id", "d", ["c"]).collect()) == [(2, 1), (4, 2)]
    assert filters.having_any(d, "id", "d", []).count() == 0


def test_valid_dialogues(spark):
    rows = [(1, "a b"), (1, None), (2, "a"), (3, "é"), (3, "a"), (4, "w " * 51), (4, "a"), (5, ""), (5, "")]
    assert sorted(tuple(r) for r in filters.valid_dialogues(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()) == [(1, 2), (5, 2)]


def test_slots_runs_and_named_turns(spark):
    s = spark.createDataFrame([({"a-b": "1", "c-d": "2"},)], "m map<string,string>")
    assert s.select(filters.valid_slots(F.col("m"), ["c-d", "x-y"]).alias("m")).first().m == {"c-d": "2"}
    logs = spark.createDataFrame([("r", 1, 0), ("r", 1, 1), ("s", 1, 0)], "run string, id int, turn_id int")
    own = spark.createDataFrame([("r", 1, 1), ("r", 9, 9)], "run string, id int, turn_id int")
    assert sorted(tuple(r) for r in filters.of_runs(logs, own).collect()) == [("r", 1, 1), ("s", 1, 0)]
    turns = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z"), (2, 0, "w")], "id int, turn_id int, t string")
    named = lambda *rows: spark.createDataFrame(rows, "id int, turn_id int")
    assert [tuple(r) for r in filters.only_turns(turns, named((1, 1), (1, 1))).collect()] == [(1, 1, "y")]
    for missing in ((3, 0), (2, 0)):
        with pytest.raises(Exception, match="not there just once"):
            filters.only_turns(turns, named((1, 0), missing)).collect()


def test_collisions(spark):
    d = spark.createDataFrame([("p", "b"), ("p", "a"), ("q", "c")], "path string, source string")
    assert [(r.path, r.sources) for r in filters.collisions(d, "path", "source").collect()] == [("p", ["a", "b"])]
