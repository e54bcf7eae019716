"""Hand cases of the scalar functions, and properties of the state algebra."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions import parsing as P
from turnloom.functions import prompting as M
from turnloom.functions import state as S
from turnloom.functions import text as X
from turnloom.operators import canonical, selection

MAPS = st.dictionaries(st.sampled_from("a-x a-y b-x b-z".split()), st.sampled_from("1 2 3".split()), max_size=4)


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


@pytest.mark.parametrize(
    "gold, pred, jga, f1",
    [({}, {}, 1, 0.0), ({}, {"a": "1"}, 0, 0.0), ({"a": "1"}, {"a": "2"}, 0, 0.0), ({"a": "1"}, {"a": "1", "b": "2"}, 0, 2 / 3), ({"a": "x|y"}, {"a": "y"}, 1, 1.0), ({"a": "x|y"}, {"a": "z"}, 0, 0.0)],
)
def test_evaluate(spark, gold, pred, jga, f1):
    e = S.evaluate(F.col("g"), F.col("p"))
    r = one(spark, "g map<string,string>, p map<string,string>", (gold, pred), e["jga"].alias("jga"), e["f1"].alias("f1"))
    assert (r.jga, round(r.f1, 9)) == (jga, round(f1, 9))


@pytest.mark.parametrize("g, p, f", [([], [], 1.0), ([], ["a"], 0.0), (["a"], [], 0.0), (["a", "a", "b"], ["a"], 0.8), (["a"], ["a"], 1.0)])
def test_fbeta(spark, g, p, f):
    assert one(spark, "g array<string>, p array<string>", (g, p), S.fbeta(F.col("g"), F.col("p")).alias("f")).f == pytest.approx(f)


def test_single_keeps_the_published_reading_of_sentinels(spark):
    r = one(spark, "b array<string>", (["hotel-area-north|east", "hotel-areadontcare", "a-b-c-d"],), S.single(F.col("b")).alias("s"))
    assert r.s == ["hotel-area-north", "hotel-areadontcare-areadontcare", "a-b-d"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(MAPS, MAPS), min_size=1, max_size=20))
def test_update_undoes_delta(spark, pairs):
    df = spark.createDataFrame(pairs, "a map<string,string>, b map<string,string>")
    out = df.select("b", S.update(F.col("a"), S.compute_delta(F.col("a"), F.col("b"))).alias("c")).collect()
    assert all(r.b == r.c for r in out)


@pytest.mark.parametrize("t, want", [("9:00", "09:00"), ("24:30", "24:30"), ("7pm", None), ("dontcare", "dontcare"), ("25:00", None)])
def test_times(spark, t, want):
    assert one(spark, "t string", (t,), X.canonical_time(F.col("t")).alias("c")).c == want


@pytest.mark.parametrize(
    "t, want",
    [("  The B&B ", "the bed and breakfast"), ("guesthouse", "guest house"), ("sat", "saturday"), ("a;b/c-d", "a , b and c d"), ("no.5", "no . 5"), ("2.5", "2.5"), ("01223 358 966 x", "01223358966 x"), ("king's", "kings"), ("(hi)", "hi")],
)
def test_normalize(spark, t, want):
    assert one(spark, "t string", (t,), X.normalize(F.col("t")).alias("c")).c == want


def test_labels_with_underscores(spark):
    r = one(spark, "l string", ("a_b_turn_1_turn_12",), X.label_dialogue(F.col("l")).alias("d"), X.label_turn(F.col("l")).alias("t"))
    assert (r.d, r.t) == ("a_b_turn_1", 12)


def test_turn_text(spark):
    row = (["none"], ["hello"], {"hotel-area": "north|east"}, {"hotel-area": "north"}, {})
    schema = "sys array<string>, usr array<string>, last_slot_values map<string,string>, slot_values map<string,string>, turn_slot_values map<string,string>"
    r = one(spark, schema, row, X.turn_text().alias("a"), X.turn_text("context", full_history=True).alias("b"), X.turn_text("dialog", gt_type="gt_full_bs").alias("c"))
    assert r.a == "[CONTEXT] hotel area: north,  [SYS]  [USER] hello"
    assert r.b == "[CONTEXT]  [SYS]  [USER] "
    assert r.c == "[CONTEXT]  [SYS]  [USER] hello [BS] hotel area: north, "
    with pytest.raises(ValueError):
        X.turn_text("nonsense")


def test_parsers(spark):
    assert one(spark, "c string", ("{'a-b': 'x', \"c-d\": 5, 'a-b': 'y'}",), P.parse_pairs("c").alias("m")).m == {"a-b": "y", "c-d": "5"}
    assert P.parse_nl_completion("{'a': 'x', 'b': __import__('os'), 'c': 'z'}") == {"a": "x"}
    state = {"hotel-area": "north"}
    text = 'agent.state.taxi = agent.find_taxi(departure=state.hotel.area, leave_from="x")\ndel agent.state.hotel.area'
    assert P.parse_python_completion(text, state) == {"hotel-area": "[DELETE]", "taxi-departure": "x"}
    assert P.parse_python_completion("hotel = evil()", state) == state


def test_aliases_and_numbers():
    assert {"acorn", "the acorn", "the acorn hotel"} <= canonical.aliases("the acorn guest house")
    assert canonical.reads_as("restaurant 2 2", "restaurant two two", False)
    assert canonical.spell(1234) == "one thousand, two hundred and thirty-four"


def test_number_runs_of_any_length_are_joined(spark):
    long = "9" * 500
    for value, want in ((f"{long} {long}  7", f"{long}{long}7"), ("a 1 2 b 3 4c 5 6", "a 12 b 3 4c 56"), ("1 2 3 4 5", "12345"), ("1a 2 b2 3", "1a 2 b2 3")):
        assert one(spark, "v string", (value,), X.normalize(F.col("v")).alias("n")).n == want


def test_numbers_of_any_length_and_number():
    names = "zero one two three four five six seven eight nine".split()
    for value in ("1 2 3 4 5", "17 9 a 200 0", " ".join("7" * 40), "12345678901234567 x"):
        toks = value.split()
        for picked in (set(), {0}, {len(toks) - 1}, {1, 3}, set(range(len(toks)))):
            for digits in (False, True):
                alias = " ".join(canonical.worded(t, digits) if i in picked else t for i, t in enumerate(toks))
                assert canonical.reads_as(value, alias, digits) and canonical.fold(alias, digits) == canonical.fold(value, digits)
    assert canonical.fold("1 2 3 4 5", False) == " ".join(names[1:6])
    assert not canonical.reads_as("two", "2", False) and not canonical.reads_as("2 2", "two", False) and not canonical.reads_as("2", "2 2", False)
    assert canonical.spell(10**15 + 7) == "one quadrillion and seven" and canonical.worded("9" * 70, False) == "9" * 70
    assert canonical.worded("9" * 66, False).startswith("nine hundred and ninety-nine vigintillion")


@pytest.mark.parametrize("fuzzy", [40, 60, 70, 85, 95])
def test_fuzzy_pairs_equal_all_comparisons(spark, fuzzy):
    r = random.Random(fuzzy)
    word = lambda: "".join(r.choice("abAB- ") for _ in range(r.randrange(1, 14)))
    known = {(s, word()) for s in "xy" for _ in range(60)} | {("x", "a"), ("y", "")}
    asked = {(s, w[:3] + r.choice(["", "a", "bb"]) + w[4:]) for s, w in known} | {("x", "b"), ("x", "")}
    got = canonical._fuzzy(spark.createDataFrame(sorted(asked), "slot string, form string"), spark.createDataFrame(sorted(known), "slot string, canonical string"), fuzzy).collect()
    score = lambda a, b: canonical.ratio(canonical.processed(a), canonical.processed(b))
    assert {tuple(x) for x in got} == {(s, a, k, score(a, k)) for s, a in asked for z, k in known if s == z and score(a, k) >= fuzzy}


def test_canonical_forms(spark):
    known = [("hotel-name", "acorn guest house"), ("hotel-name", "hotel 1 two 3 4 5"), ("hotel-name", "pizza hut fen ditton"), ("hotel-name", "arbury lodge"), ("hotel-name", "arbury lodgf"), (None, "x"), ("hotel-name", None)]
    values = {
        ("hotel-name", "acorn guest house"): "acorn guest house",
        ("hotel-name", "the acorn"): "acorn guest house",
        ("hotel-name", "hotel 1 2 3 4 5"): "hotel 1 two 3 4 5",
        ("hotel-name", "the hotel 1 2 3 4 5"): "hotel 1 two 3 4 5",
        ("hotel-name", "pizza hut fenditton"): "pizza hut fen ditton",
        ("hotel-name", "nothing like it"): None,
        ("train-leaveat", "9:05"): "09:05",
        ("train-leaveat", "noon"): None,
        ("train-arriveby", "dontcare"): "dontcare",
        ("taxi-colour", "red"): None,
    }
    v = spark.createDataFrame([*values, ("hotel-name", None), (None, "x"), ("hotel-name", "the acorn")], "slot string, value string")
    got = {(r.slot, r.value): r.canonical for r in canonical.canonical(v, spark.createDataFrame(known, "slot string, value string"), 95).collect()}
    assert got == values
    assert canonical.canonical(v.limit(0), spark.createDataFrame(known, "slot string, value string")).count() == 0


def test_round_robin_ends_and_skips():
    assert selection.alternate([1, 2, 3], [1, 4], 10) == [1, 4, 2, 3]
    assert selection.alternate([], [], 3) == []


def test_greedy_without_weight_is_top_k():
    import numpy as np

    s = np.array([0.1, 0.9, 0.5])
    assert selection.greedy(s, np.eye(3), 5, 0.0) == [1, 2, 0]


def test_prompt(spark):
    row = ([({"hotel-area": "x"}, "hi", "yes", {"hotel-area": "north"})], {}, "none", "taxi")
    df = spark.createDataFrame([row], "ex array<struct<context:map<string,string>,sys:string,usr:string,delta:map<string,string>>>, c map<string,string>, s string, u string")
    p = M.chat_prompt("do it", F.col("ex"), F.col("c"), F.col("s"), F.col("u"))
    r = df.select(p.alias("p"), M.best_completion(M.model(M.stub)(p)).alias("b")).first()
    assert [m.role for m in r.p] == ["system", "user", "assistant", "user"] and r.b == "{'hotel-area': 'north'}"


def test_configs(spark, tmp_path):
    from turnloom.sources.configs import config_table

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps({"test_fn": "t", "llm_engine": "m", "num_examples": {"SBERT": 0, "BM25": 5}, "prompt_format": "sgd_nl-prompt-chat"}))
    (tmp_path / "a" / "bad.json").write_text("{")
    r = config_table(spark, str(tmp_path)).collect()
    assert [(x.stage, x.strategy) for x in r] == [("dst_run", "bm25")] and "missing train_fn" in r[0].problems


def test_turns(spark, tmp_path):
    from turnloom.sources.turns import read_turns, scored_pool

    t = {"ID": "d1", "turn_id": 0, "domains": ["hotel"], "dialog": {"sys": [""], "usr": ["hi"]}, "slot_values": {"hotel-area": "north"}, "turn_slot_values": {}, "last_slot_values": {}}
    p = tmp_path / "t.json"
    p.write_text(json.dumps([t, t | {"ID": "d2", "domains": ["bus"]}]))
    assert [r.label for r in read_turns(spark, str(p), domains=("hotel",)).collect()] == ["d1_turn_0"]
    with pytest.raises(ValueError):
        scored_pool(spark.createDataFrame([("d", 1, None)], "ID string, turn_id int, final_scores map<string,map<string,double>>"), "score_full")


def test_stream_equals_batch(spark, tmp_path):
    from turnloom.plans import fixtures as fx
    from turnloom.streaming.states import stream_fold

    e = fx.gold_events(spark, "/root/testdata/sf0.001").select("id", F.col("turn_id").cast("long").alias("turn_id"), "slot", "value")
    e.write.parquet(str(tmp_path / "in"))
    s = stream_fold(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    from turnloom.plans.catalog import queries

    batch = {tuple(r) for r in queries()["state_fold"](spark, "/root/testdata/sf0.001").select("id", "turn_id", "state").collect()}
    assert {tuple(r) for r in spark.table("folded").collect()} == batch
