"""What the third review found."""

import pickle
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnloom.functions import code, parsing, state
from turnloom.operators import canonical, inference, mining, scan, search
from turnloom.plans import catalog

from .test_diversity import okapi
from .test_scan import texts


def sql(name, **tables):
    con = duckdb.connect()
    con.execute("set threads = 1")  # ties that SQL leaves open go to the first row
    for t, p in tables.items():
        con.execute(f"create view {t} as select * from '{p}/*.parquet'")
    return con.execute(catalog.oracle_sql()[name]).fetchall()


def test_best_completion_of_equal_values_is_the_first(spark, tmp_path):
    """equal values, infinite ones, and null values and types."""
    low = float("-inf")
    rows = [(9, 1, "view", 5.0), (2, 1, "click", 5.0), (3, 1, "error", 1.0), (4, 2, "view", None), (5, 3, "error", low), (6, 4, None, 9.0), (7, 4, "view", 2.0)]
    rows += [(100 + i, 10 + i % 40, ["view", "click", "error", "signup"][i * 7919 % 11 % 4], float(i * 31 % 3)) for i in range(400)]
    spark.createDataFrame(sorted(rows), "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {x.id: x.completion for x in catalog.queries()["best_completion"](spark, str(tmp_path)).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == dict(sql("best_completion", events=tmp_path / "events.parquet"))
        assert got[1] == "click" and got[2] is None and got[3] == "error" and got[4] == "view"


def test_bm25_in_a_pool_carries_no_texts_by_token(spark):
    """rows that are as many as tokens hold no text and no list; a long query equals the plain sum."""
    pool = spark.createDataFrame([(1, "a b b c " * 3, i, t) for i, t in enumerate(["a b", "b b c d", "", "x y", None, "a a a"])] + [(2, "a", 0, "a b"), (2, "a", 7, "b")], "q long, qtext string, label long, text string")
    out = search.bm25_pool_scores(pool)
    plan = out._jdf.queryExecution().optimizedPlan()
    todo, sizes = [plan], []
    while todo:
        p = todo.pop()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName() in ("Aggregate", "Window"):
            names = [p.output().apply(i) for i in range(p.output().size())]
            if any(a.name() == "tok" for a in names):
                sizes += [a.dataType().typeName() for a in names]
    assert sizes and "array" not in sizes
    got = {(x.q, x.label): round(x.score, 9) for x in out.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 3), (1, 5), (2, 0), (2, 7)}
    docs = ["a b".split(), "b b c d".split(), [], "x y".split(), "a a a".split()]
    assert {k: x for k, x in got.items() if x == 0} == {(1, 3): 0.0, (2, 0): 0.0, (2, 7): 0.0}  # members that share no token, or one of half the pool
    apart = pool.select("q", F.col("qtext").alias("text")).distinct()
    assert {(x.q, x.label): round(x.score, 9) for x in search.bm25_pool_scores(pool.drop("qtext"), apart).collect()} == got
    no_null = {x.label: x.score for x in search.bm25_pool_scores(pool.where("q = 1 and text is not null")).collect()}
    want = okapi(docs, "a b b c a b b c a b b c".split())
    assert no_null[1] == pytest.approx(want[1]) and no_null[5] == pytest.approx(want[4])


def test_a_block_holds_arrays_only():
    """F5 to F16, F20: nothing in what a task gets is an object a query or a token; common, rare and repeated tokens add up
    alike; a side alone is ranked without the other."""
    docs = [x.split() for x in texts(4, 700)]
    weight = {t: 1 + len(t) / 7 for d in docs for t in d}
    rows = [scan.Row(q=i, v=[1.0], terms=[scan.Row(tok=t, w=weight[t] * d.count(t)) for t in sorted(set(d))], wanted=[scan.Row(label=i, s=0.0, b=1.0)]) for i, d in enumerate(docs[:300])]
    block = scan._Block(rows, 5.0)
    held = [x for x in vars(block).values() if isinstance(x, (list, tuple, dict)) and len(x) > 3]
    assert not held and len(pickle.dumps(block)) < 100 * sum(len(r.terms) for r in rows)
    lists = [sorted(set(x)) for x in docs]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array([len(x) for x in docs]), pa.array(lists), pa.array([[x.count(t) for t in y] for x, y in zip(docs, lists)], pa.list_(pa.int32()))], names=["label", "dl", "toks", "f"])
    impact = lambda f, n: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / 5.0))
    want = [[sum(weight[t] * a.count(t) * impact(b.count(t), len(b)) for t in set(a) & set(b)) for b in docs] for a in docs[:300]]
    assert np.allclose(block.bm25(batch), want, atol=1e-9)
    least = np.sort(np.array(want), axis=1)[:, -5]
    got = block.bm25(batch.slice(0, 9), least)
    for i in range(300):
        assert np.isneginf(got[i]).all() and max(want[i][:9]) < least[i] or np.allclose(got[i], want[i][:9], atol=1e-9)


def test_places_before_equal_scores():
    r = np.random.default_rng(5)
    for _ in range(50):
        x, names = r.integers(0, 4, 30) / 2, np.sort(r.choice(200, 30, False))
        keys, labels = r.integers(-1, 5, 12) / 2, r.choice(200, 12, False)
        assert scan._before(keys, labels, x, names).tolist() == [sum(a > k or a == k and n < y for a, n in zip(x, names)) for k, y in zip(keys, labels)]


def test_negatives_are_joined_off_the_driver(spark):
    """of what grows with turns nothing is broadcast, however small; only the starts of the buckets are."""
    mined = spark.createDataFrame([(q, q * 10 + i, "pos" if i < 5 else "neg", i) for q in range(6) for i in range(9)], "q long, label long, kind string, place int")
    out = mining.easy_negatives(mined, spark.range(500).withColumnRenamed("id", "label"), 8)
    assert out._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1
    rows = out.collect()
    assert len(rows) == 6 * 5 * 4 and not any(r.label in (r.q, r.pos) or r.label in range(r.q * 10 + 5, r.q * 10 + 9) for r in rows)


def test_fuzzy_candidates_hold_parts_of_a_form(spark):
    """words of common syllables are hardly compared with each other, and no pair that reaches the ratio is lost."""
    r = random.Random(3)
    words = sorted({"".join(r.choice(["th", "er", "an", "ing", "ver", "on", "ch"]) for _ in range(r.randrange(4, 9))) for _ in range(400)})
    asked = sorted({w[: len(w) // 2] + w[len(w) // 2 - 1 :] for w in words} | {"the " + w + " hotel" for w in words[::3]} | {"an" * 40 + "x" + "ver" * 9, ""})
    known = [*words, "an" * 40 + "ver" * 9, ""]
    held = [set(canonical.held_parts(w, 0.925)) for w in known]
    keys = [set(canonical.asked_parts(w, 0.925)) for w in asked]
    assert sum(not k.isdisjoint(h) for k in keys for h in held) < 0.02 * len(asked) * len(known)
    column = lambda n, x: spark.createDataFrame([("s", w) for w in x], f"slot string, {n} string")
    got = {(x.form, x.canonical): x.r for x in canonical._fuzzy(column("form", asked), column("canonical", known), 93).collect()}
    near = {(a, b): canonical.ratio(a, b) for a in asked for b in known if abs(len(a) - len(b)) < 9}
    assert got == {k: x for k, x in near.items() if x >= 93} and len(got) > 300


def expressions(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_metrics_evaluate_their_parts_once(spark):
    """what is counted stands once in the plan, and metrics keep their values."""
    df = spark.createDataFrame([(["a-1", "a-1", "b-2"], ["a-1", "c-3"], {"a": "1|2", "b": "3", "n": None}, {"a": "2", "b": "3", "n": None})], "g array<string>, p array<string>, gold map<string,string>, pred map<string,string>")
    f = df.select(state.fbeta(F.col("g"), F.col("p")).alias("f"))
    assert expressions(f).count("array_contains(") <= 2 and round(f.first().f, 6) == 0.666667
    m = df.select(state.evaluated(F.col("gold"), F.col("pred"), 5).alias("m")).select("m.*")
    assert expressions(m).count("split_part") + expressions(m).count("transform_values") <= 3
    assert m.first().asDict() == {"jga": 1, "acc": 0.8, "f1": 0.8}  # a slot without a value is a miss, but the same
    assert df.select(state.evaluate(F.col("gold"), F.lit(None).cast("map<string,string>"))["jga"].alias("j")).first().j is None


def test_a_line_of_code_is_read_once(spark):
    """what a line says stands once in the plan of the parse, and merges as before."""
    said = "agent.state.shop = agent.find_shop(view='3', click=agent.state.shop.error)\ndel agent.state.shop.error\nnothing\nagent.state.shop.view = '4'"
    df = spark.createDataFrame([(said, {"shop-error": "7", "shop-view": "1"})], "said string, before map<string,string>")
    out = df.select(code.parsed_code(F.col("said"), F.col("before")).alias("x"))
    assert expressions(out).count("regexp_extract_all") <= 2
    assert out.first().x == {"shop-view": "3", "shop-click": "7", "shop-error": "[DELETE]"}


def test_texts_of_a_small_file_are_cleaned_on_all_cores(spark):
    """a file of one row group is not one task."""
    out = catalog.queries()["cleaned_texts"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() >= 4 and out.count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()


def test_a_sparse_choice_runs_no_dense_search(spark, monkeypatch):
    """only the side that is chosen from is searched."""
    asked = []
    one = scan.Hybrid.one
    monkeypatch.setattr(scan.Hybrid, "one", lambda self, side, *a, **k: asked.append(side) or one(self, side, *a, **k))
    assert catalog.queries()["div_select_bm25"](spark, "/root/testdata/sf0.001").count() and asked == ["b"]


def test_an_answer_is_read_once(spark):
    """each group of the pattern of a pair stands once in the plan, also where the state after an answer is taken; of
    equal keys the last counts as before."""
    said = [("{'a-x': '1|3', \"b\": -4.5, 'a-x': '2'} 'c': \"\", 'd' '5'",), ("",), (None,)]
    df = spark.createDataFrame(said, "best string").withColumn("before", F.create_map(F.lit("b"), F.lit("7"), F.lit("e"), F.lit("8")))
    read = df.select(parsing.parse_pairs("best").alias("m"))
    assert expressions(read).count("regexp_extract_all(") <= 5
    assert [r.m for r in read.collect()] == [{"b": "-4.5", "a-x": "2", "c": ""}, {}, None]
    after = df.select(inference._after(F.col("before"), inference._pairs(F.col("best"))).alias("m"))
    assert expressions(after).count("regexp_extract_all(") <= 5
    assert [r.m for r in after.collect()] == [{"e": "8", "b": "-4.5", "a-x": "2", "c": ""}, {"b": "7", "e": "8"}, {"b": "7", "e": "8"}]


def test_scores_ask_no_last_prompt(spark, monkeypatch):
    """prompts with the chosen examples are asked where choices are wanted, and not for the scores alone."""
    asked = []
    one = inference.answered
    monkeypatch.setattr(inference, "answered", lambda requests, keys, *a, **k: asked.append(keys) or one(requests, keys, *a, **k))
    scores = catalog.queries()["generated_scores"](spark, "/root/testdata/sf0.001")
    assert asked == [["q", "iter", "grp"]] and scores.count()
    assert catalog.queries()["generated_choices"](spark, "/root/testdata/sf0.001").count() and asked[1:] == [["q", "iter", "grp"], ["q"]]
