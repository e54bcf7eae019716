"""The jobs around a model: hand cases and brute force."""

import pytest
from pyspark.sql import functions as F

from turnloom.functions import beliefs, prompting, state
from turnloom.functions import text as X
from turnloom.operators import dialogue, jobs
from turnloom.sources import turns as sources


def test_demonstrations_drop_the_own_dialogue_and_the_first_of_too_many(spark):
    asked = spark.createDataFrame([(1, 0), (2, 5)], "q long, dialogue long")
    found = spark.createDataFrame([(1, 10, 0, 1), (1, 11, 1, 2), (1, 12, 2, 3), (2, 12, 2, 1)], "q long, label long, dialogue long, rk int")

    def prompt(fixed, k):
        rows = jobs.demonstrations(asked, found, fixed, k).collect()
        return {q: [r.label for r in sorted(rows, key=lambda r: r.place) if r.q == q] for q in (1, 2)}

    assert prompt([(90, 7), (91, 5)], 3) == {1: [91, 12, 11], 2: [90, 12]}
    assert prompt([(90, 7), (91, 5)], 2) == {1: [90, 91], 2: [90]}
    assert prompt([], 5) == {1: [12, 11], 2: [12]}


def test_replayed_predictions_come_first(spark):
    log = spark.createDataFrame([(1, 0, {"a": "1"}), (1, 1, None), (2, 0, {})], "id long, turn_id long, pred map<string,string>")
    cached = spark.createDataFrame([(1, 1, {"a": "2"}), (1, 1, None), (9, 9, {"a": "3"}), (2, 0, {"b": "1"}), (2, 0, {"b": "2"})], log.schema)
    r = {(x.id, x.turn_id): (x.pred, x.replayed) for x in jobs.replay(log, cached).collect()}
    assert r == {(1, 0): ({"a": "1"}, False), (1, 1): ({"a": "2"}, True), (2, 0): ({"b": "2"}, True)}


def test_runs_are_scored_missing_or_in_error(spark):
    gold = spark.createDataFrame([(1, 0, {"a": "x"}), (1, 1, {"a": "y"})], "id long, turn_id long, gold map<string,string>")
    rows = [("t/ok", 1, 0, {"a": "x"}), ("t/ok", 1, 1, {"a": "x"}), ("t/twice", 1, 0, {}), ("t/twice", 1, 0, {}), ("t/odd", 7, 0, {}), ("stray", 1, 0, {})]
    logs = spark.createDataFrame(rows, "path string, id long, turn_id long, pred map<string,string>")
    configs = spark.createDataFrame([("t/ok",), ("t/ok",), ("t/twice",), ("t/odd",), ("t/none",), ("u/none",)], "path string")
    r = {x.path: x for x in jobs.score_runs(configs, logs, gold, 5, table="t/").collect()}
    assert {p: x.status for p, x in r.items()} == {"t/ok": "scored", "t/twice": "error", "t/odd": "error", "t/none": "missing"}
    assert (r["t/ok"].jga, r["t/ok"].n_total, r["t/ok"].grp, r["t/ok"].split) == (0.5, 2, "t", "ok") and r["t/odd"].jga is None
    one = {x.path: x for x in jobs.score_runs(configs, logs, gold, 5, turn=0).collect()}
    assert (one["t/ok"].jga, one["t/ok"].n_total) == (1.0, 1)
    assert {x.status for x in jobs.score_runs(configs, logs.limit(0), gold, 5).collect()} == {"missing"}


def test_repeated_keys_fail(spark):
    assert jobs.asserted_unique(spark.range(5), ["id"]).count() == 5
    with pytest.raises(Exception, match="repeated"):
        jobs.asserted_unique(spark.range(5).union(spark.range(1)), ["id"]).collect()


def test_training_rows_have_labels_if_any_says_something(spark):
    pairs = spark.createDataFrame([(["a", "b"], 0.0), (["c"], 0.0)], "texts array<string>, label double")
    assert sorted(map(tuple, jobs.training_rows(pairs, "texts", 2).collect())) == [("a", "b"), ("c", None)]
    assert jobs.training_rows(pairs.withColumn("label", F.lit(1.0)), "texts", 2).columns == ["sentence_0", "sentence_1", "label"]


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0]), ([[4.0, 2.0]], [1])], "v array<array<double>>, m array<int>")
    assert [r[0] for r in df.select(jobs.masked_mean("v", "m")).collect()] == [[2.0, 4.0], [0.0, 0.0], [4.0, 2.0]]


def test_remembered_parameters(spark):
    old = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 1.0, 3.0), (2, 1, 0.5, 2.0)], "q long, label long, s double, b double")
    new = spark.createDataFrame([(1, 9, 1.0, 5.0), (2, 9, 1.0, 5.0), (3, 9, 1.0, 5.0)], old.schema)
    r = {x.q: (x.zs, x.zb) for x in jobs.standardized_by(new, jobs.remembered(old)).collect()}
    assert r == {1: (1.0, 3.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_states_by_domain(spark):
    m = {"zoo-area": "007", "taxi-leaveat": "-0", "hotel-book stay": "+3", "hotel-some slot": "3 nights", "taxi-departure": " 10 ", "taxi-food": "-012", "taxi-x": "000"}
    df = spark.createDataFrame([(m,), ({},), (None,)], "m map<string,string>")
    got = [r[0] for r in df.select(state.by_domain(F.col("m"), ("taxi", "hotel"), {"leaveat": "depart_time", "departure": "leave_from"})).collect()]
    assert [(b.domain, b.slots) for b in got[0]] == [("taxi", {"depart_time": "0", "leave_from": "10", "food": "-12", "x": "0"}), ("hotel", {"book_stay": "3", "some_slot": "3 nights"}), ("zoo", {"area": "7"})]
    assert got[1:] == [[], None]


def test_turns_without_a_change_keep_their_domain(spark):
    rows = [(1, 0, {}, {}), (1, 1, {}, {"b": "1"}), (1, 2, {"b": "1"}, {"b": "1"}), (1, 3, {"b": "1"}, {"a": "2"}), (1, 4, None, {"b": "2"}), (2, 0, {}, {"b": "1"})]
    df = spark.createDataFrame(rows, "id long, turn_id long, p map<string,string>, n map<string,string>")
    r = {(x.id, x.turn_id): (x.domain, x.changed) for x in dialogue.turn_domain(df, "p", "n", ["a", "b"]).collect()}
    assert r == {(1, 0): ("a", []), (1, 1): ("b", ["b"]), (1, 2): ("b", []), (1, 3): ("a", ["a", "b"]), (1, 4): ("a", []), (2, 0): ("b", ["b"])}


def test_completions_end_at_the_first_stop(spark):
    df = spark.createDataFrame([("a#b\n\nc",), ("\n\nx",), ("plain",), (None,)], "c string")
    assert [r[0] for r in df.select(prompting.stopped(F.col("c"), prompting.STOPS["python-prompt"])).collect()] == ["a", "", "plain", None]
    assert [r[0] for r in df.select(prompting.stopped(F.col("c"), [])).collect()][0] == "a#b\n\nc"


def test_parsers_by_format():
    slots, said = frozenset(["hotel-area"]), "{'hotel-area': 'north', 'x-y': '1'}"
    assert prompting.parser_of("nl", slots)(said, {}) == {"hotel-area": "north"}
    assert prompting.parser_of("SGD-nl", slots)(said, {}) == {"hotel-area": "north", "x-y": "1"}
    assert prompting.parser_of("python-prompt")('agent.state.hotel = agent.find_hotel(area="north")', {"taxi-food": "x"}) == {"taxi-food": "x", "hotel-area": "north"}


def test_belief_summaries(spark):
    meta = {"hotel": {"book": {"booked": "[]", "day": "<Monday>", "stay": ""}, "semi": {"name": "not mentioned", "area": "do not care", "type": " Concerthall"}}, "police": {"book": {"booked": "[x]"}, "semi": {}}}
    df = spark.createDataFrame([(meta,), (None,), ({},)], f"m {beliefs.META}")
    full, *none = [r.r for r in df.select(beliefs.belief_summary(F.col("m")).alias("r")).collect()]
    assert all(len(r.bits) == 94 for r in (full, *none)) and all(sum(r.bits) == 0 and r.active == r.pairs == [] for r in none)
    hotel = 14 + 17 + 5
    assert full.bits[hotel : hotel + 26] == [0, 1, 0, 0, 1, 0, 0, 0, 1, 0] + [0] * 12 + [0, 0, 1, 1] and full.bits[-2:] == [1, 0] and full.active == ["hotel"]
    assert [tuple(p) for p in full.pairs] == [("hotel-book day", "|monday|"), ("hotel-area", "dontcare"), ("hotel-type", "concert hall")]


def test_replacements(spark, tmp_path):
    f = tmp_path / "pairs.tsv"
    f.write_text("it's\tit is\nis\twas\n\n")
    pairs = sources.read_replacements(spark, str(f))
    assert pairs == [("it's", "it is"), ("is", "was")]
    df = spark.createDataFrame([("it's so, is it",), ("this",), ("is",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.mended(F.col("t"), pairs)).collect()] == ["it was so, was it", "this", "was", "", None]
    f.write_text("no tab\n")
    with pytest.raises(ValueError):
        sources.read_replacements(spark, str(f))
