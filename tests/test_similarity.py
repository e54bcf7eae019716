"""Similar beliefs from postings, against all comparisons."""

import random

import pytest

from turnloom.operators import similarity

SCHEMA = "label long, b array<string>"


def plain(a, b):
    f1 = lambda x, y: 1.0 if not x | y else 2 * len(x & y) / (len(x) + len(y))
    slots = lambda x: {"-".join(v.split("-")[:2]) for v in x}
    return round(f1(a, b) + f1(slots(a), slots(b)) - 1, 6)


def beliefs(seed, rows, slots, values, several=False):
    r = random.Random(seed)
    out = []
    for i in range(rows):
        held = r.sample(range(slots), r.choice([0, slots, r.randrange(slots + 1)]))
        b = {f"d{s % 3}-s{s}-{r.choice(values)}" for s in held for _ in range(1 + (several and r.random() < 0.3))}
        out.append((r.randrange(10**6) * 1000 + i, sorted(b)))
    return out


@pytest.fixture(params=[(1, 120, 5, "ab", False), (2, 150, 9, "abcdef", False), (3, 120, 5, "abc", True), (4, 60, 34, "a", False), (5, 30, 3, "abcdefgh", False)])
def known(request, spark):
    rows = beliefs(*request.param)
    c = {}
    for label, b in sorted(rows):
        c.setdefault(tuple(b), label)
    return spark, rows, {label: set(b) for b, label in c.items()}


@pytest.mark.parametrize("k", [1, 5, 60])
def test_most_similar(known, k):
    spark, rows, c = known
    classes = similarity.classes(spark.createDataFrame(rows, SCHEMA))
    got = similarity.most_similar(classes.where("label % 3 = 0"), classes, k).collect()
    want = set()
    for q, b in c.items():
        if q % 3 == 0:
            order = sorted((-plain(b, x), label) for label, x in c.items())[:k]
            want |= {(q, label, -s, i) for i, (s, label) in enumerate(order, 1)}
    assert {(r.q, r.label, r.sim, r.rk) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_similar(known, least):
    spark, rows, c = known
    classes = similarity.classes(spark.createDataFrame(rows, SCHEMA))
    got = similarity.similar(classes.where("label % 3 = 0"), classes, least).collect()
    assert {(r.q, r.label, r.sim) for r in got} == {(q, x, plain(c[q], c[x])) for q in c if q % 3 == 0 for x in c if plain(c[q], c[x]) >= least}
    assert len(got) == len({(r.q, r.label) for r in got})


def test_membership_and_odd_rows(spark):
    rows = [(4, ["a-b-1"]), (2, ["a-b-1"]), (2, ["a-b-1"]), (7, []), (9, None)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in similarity.membership(d).collect()} == {(4, 2, 3), (2, 2, 3), (7, 7, 1)}
    none = similarity.classes(d.limit(0))
    assert similarity.most_similar(none, none, 3).count() == similarity.similar(none, none, 0.5).count() == 0
    alone = similarity.most_similar(similarity.classes(d.where("label = 7")), similarity.classes(d), 5).collect()
    assert [(r.label, r.sim) for r in alone] == [(7, 1.0), (2, -1.0)]


def test_no_nested_loop(spark):
    rows = beliefs(2, 150, 9, "abcdef")
    c = similarity.classes(spark.createDataFrame(rows, SCHEMA))
    for df in (similarity.most_similar(c, c, 5), similarity.similar(c, c, 0.6)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
