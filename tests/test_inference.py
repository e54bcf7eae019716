"""The jobs around a model: answers are kept, asked for once, retried as the rules say; scores by hand."""

import random
import time

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from turnloom.functions import prompting
from turnloom.operators import inference

SHOT = "struct<context:map<string,string>,sys:string,usr:string,delta:map<string,string>>"


def shot(value, slot="a-x"):
    return ({}, "none", "hi", {slot: value})


def requests(spark, rows):
    return spark.createDataFrame([(i, {}, "none", usr, [shot(x) for x in shots]) for i, usr, shots in rows], f"id long, context map<string,string>, sys string, usr string, examples array<{SHOT}>")


def counting(log, answer):
    """A model that writes down what it is asked."""

    def model(messages):
        with open(log, "a") as f:
            f.write(messages[-1]["content"].split("user: ")[1].split("\n")[0] + f" {len(messages)}\n")
        return answer(messages)

    return model


def asked(log):
    return sorted(log.read_text().split("\n")[:-1]) if log.exists() else []


def test_a_killed_run_goes_on(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    rows = [(i, f"u{i % 12}", ["1"]) for i in range(24)]  # each prompt twice
    trap = tmp_path / "trap"
    trap.touch()

    def dies(messages):
        if trap.exists() and "user: u7\n" in messages[-1]["content"]:
            raise ValueError("killed")
        return prompting.stub(messages)

    ask = lambda: inference.answered(requests(spark, rows), ["id"], "s", counting(log, dies), store, batches=6)
    with pytest.raises(PythonException, match="killed"):
        ask()
    kept = {r.key for r in spark.read.parquet(store).collect()}
    assert 0 < len(kept) < 12
    before = asked(log)
    trap.unlink()
    got = sorted((r.id, r.status, r.best, r.n_examples) for r in ask().collect())
    assert got == [(i, "ok", "{'a-x': '1'}", 1) for i in range(24)]
    assert len(asked(log)) - len(before) == 12 - len(kept)  # no second answer for a stored key
    again = asked(log)
    assert sorted((r.id, r.best) for r in ask().collect()) == [(i, b) for i, _, b, _ in got] and asked(log) == again


def test_retries(spark, tmp_path):
    log = tmp_path / "log"

    def model(messages):
        text = messages[-1]["content"]
        if len(messages) > 6:
            raise prompting.TooLong
        if "user: never\n" in text:
            raise RuntimeError
        if "user: long\n" in text and len(messages) > 2:
            raise prompting.TooLong
        if "user: odd\n" in text:
            return {"no pairs": 0.0}
        return {"{'a-x': 'least'}": -3.0, "agent.state.{'a-x': 'best'}": -1.0}

    def parse(text):
        if "{" not in text:
            raise ValueError

    rows = [(1, "fine", "12"), (2, "never", "1"), (3, "long", "12"), (4, "odd", "1"), (5, "window", "1234"), (6, "bare", "")]
    got = {r.id: (r.status, r.best, r.n_examples) for r in inference.answered(requests(spark, rows), ["id"], "s", counting(log, model), parse=parse).collect()}
    ok = "{'a-x': 'best'}"
    assert got == {1: ("ok", ok, 2), 2: ("failed", None, 1), 3: ("ok", ok, 0), 4: ("failed", None, 1), 5: ("ok", ok, 2), 6: ("ok", ok, 0)}
    calls = asked(log)
    assert calls.count("never 4") == calls.count("odd 4") == prompting.ATTEMPTS
    assert [c for c in calls if c.startswith("long")] == ["long 2", "long 4", "long 6"] and [c for c in calls if c.startswith("window")] == ["window 10", "window 6", "window 8"]


def test_spacing_and_empty_tables(spark, tmp_path):
    r = requests(spark, [(i, f"u{i}", ["1"]) for i in range(5)]).coalesce(1)
    assert inference.answered(r.limit(0), ["id"], "s", prompting.stub).count() == 0
    began = time.time()
    assert inference.answered(r, ["id"], "s", prompting.stub, spacing=0.2).count() == 5
    assert time.time() - began > 0.8


def test_dialogues_by_turn(spark):
    rows = [(1, 0, [shot("1")]), (1, 2, [shot("2", "a-y")]), (2, 1, [shot("[DELETE]")]), (2, 0, [shot("3|4")]), (3, 5, [])]
    t = spark.createDataFrame([(i, n, "none", "u", x) for i, n, x in rows], f"id long, turn_id int, sys string, usr string, examples array<{SHOT}>")
    got = {(r.id, r.turn_id): (r.context, r.pred) for r in inference.run_dialogues(t, "s", prompting.stub).collect()}
    assert got == {(1, 0): ({}, {"a-x": "1"}), (1, 2): ({"a-x": "1"}, {"a-x": "1", "a-y": "2"}), (2, 0): ({}, {"a-x": "3"}), (2, 1): ({"a-x": "3"}, {}), (3, 5): ({}, {})}
    assert inference.run_dialogues(t.limit(0), "s", prompting.stub).count() == 0


def test_scores_of_groups(spark):
    r = random.Random(1)
    members, want = [], {}
    for q, n, group in ((1, 7, 3), (2, 4, 4), (3, 6, 2)):
        for it in range(3):
            grps = [list(range(n))[i : i + group] for i in range(0, n, group)]
            score = [(float(r.random() < 0.5), float(r.random() < 0.3)) for _ in grps]
            for g, labels in enumerate(grps):
                for x in labels:
                    members.append((q, x, it, g, *score[g]))
                for k in (0, 1):
                    for x in range(n):
                        s = want.setdefault((q, x), [0, 0.0, 0.0, 0.0, 0.0])
                        if x in labels:
                            s[0] += 1 - k
                            s[1 + k] += score[g][k]
                            s[3 + k] += score[g][k]
                        elif n // group > 1:
                            s[3 + k] -= score[g][k] / (n // group - 1)
    d = spark.createDataFrame(members, "q long, label long, iter int, grp int, delta double, full double")
    for q, group in ((1, 3), (2, 4), (3, 2)):
        for x in inference.scored_groups(d.where(F.col("q") == q), group).collect():
            assert (x.occurence, x.score_delta, x.score_full, x.influence_delta, x.influence_full) == pytest.approx(want[q, x.label], abs=1e-5)
