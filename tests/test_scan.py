"""Searches over whole tables against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import scan

from .test_diversity import okapi


def ranked(scores, k):
    """(label, score, place) of a {label: score}."""
    order = sorted(scores, key=lambda x: (-round(scores[x], 6), x))[:k]
    return [(x, round(scores[x], 6), i) for i, x in enumerate(order, 1)]


def texts(seed, n):
    r = random.Random(seed)
    rare = [f"r{i}" for i in range(n)]
    return ["every " + " ".join(r.choice(["a", "b", "c", "d", r.choice(rare)]) for _ in range(r.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("own, rows, terms", [(True, 2048, 1 << 20), (False, 7, 1 << 20), (True, 2048, 40)])
def test_bm25_with_a_token_in_every_document(spark, monkeypatch, own, rows, terms):
    monkeypatch.setattr(scan, "ROWS", rows)
    monkeypatch.setattr(scan, "TERMS", terms)
    docs = texts(1, 3000)  # several chunks a task, so that bounds are used
    queries = {0: docs[0], 5: "every a", 6: "r1 r2 r3", 7: "nothing known", 8: "", 11: "a a b r9 r9", **{i: docs[i] for i in range(100, 120)}}
    d = spark.createDataFrame(list(enumerate(docs)), "label long, text string").repartition(3)
    q = spark.createDataFrame(list(queries.items()), "q long, text string")
    got = {}
    for r in scan.bm25_top(q, d, 6, own=own).orderBy("q", "rk").collect():
        got.setdefault(r.q, []).append((r.label, r.score, r.rk))
    split = [x.split() for x in docs]
    for i, text in queries.items():
        scores = {x: s for x, s in enumerate(okapi(split, text.split())) if own or x != i}
        assert got[i] == ranked(scores, 6)


def test_documents_that_share_nothing_fill_up(spark):
    d = spark.createDataFrame([(3, "x y"), (1, "z"), (2, None), (7, "x"), (8, "z w"), (9, "u"), (None, "x")], "label long, text string")
    q = spark.createDataFrame([(1, "x"), (2, None)], "q long, text string")
    rows = sorted(tuple(r) for r in scan.bm25_top(q, d, 10).select("q", "rk", "label", (F.col("score") > 0).alias("some")).collect())
    assert rows == [(1, 1, 7, True), (1, 2, 3, True), *((1, i, x, False) for i, x in enumerate([1, 2, 8, 9], 3)), *((2, i, x, False) for i, x in enumerate([1, 2, 3, 7, 8, 9], 1))]
    assert scan.bm25_top(q, d.limit(0), 3).count() == scan.bm25_top(q.limit(0), d, 3).count() == 0


def test_impacts_bound_every_score():
    """A chunk that is left out has no document that reaches the k-th score."""
    docs = [x.split() for x in texts(4, 200)]
    rows = [scan.Row(q=0, terms=[scan.Row(tok=t, w=w) for t, w in (("every", 0.5), ("a", 2.0), ("r7", 3.0), ("d", -1.0))])]
    block = scan._Block(rows, 5.0)
    import pyarrow as pa

    lists = pa.array([sorted(set(x)) for x in docs])
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([len(x) for x in docs]), lists, pa.array([[x.count(t) for t in sorted(set(x))] for x in docs])], names=["label", "dl", "toks", "f"])
    full = block.bm25(batch)
    top = float(full.max())
    assert (block.bm25(batch, np.array([top])) == full).all()
    assert np.isneginf(block.bm25(batch, np.array([100.0]))).all()


@pytest.mark.parametrize("rows", [3, 2048])
def test_dense_top(spark, monkeypatch, rows):
    monkeypatch.setattr(scan, "ROWS", rows)
    r = np.random.default_rng(3)
    vectors = {}
    for i in range(60):
        v = r.standard_normal(8 if i % 3 else 5)
        vectors[i] = vectors[i + 100] = v / np.linalg.norm(v)  # ties
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "label long, v array<double>").repartition(3)
    queries = corpus.where("label < 30")
    got = {}
    for x in scan.dense_top(queries, corpus, 4).orderBy("q", "rk").collect():
        got.setdefault(x.q, []).append((x.label, x.score, x.rk))
    for q in range(30):  # a vector is compared with those of its dimension
        assert got[q] == ranked({x: float(vectors[q] @ v) for x, v in vectors.items() if x != q and len(v) == len(vectors[q])}, 4)
    assert scan.dense_top(corpus.limit(0), corpus, 3).count() == scan.dense_top(corpus, corpus.limit(0), 3).count() == 0


def test_the_driver_holds_one_block(spark, monkeypatch):
    """Blocks are collected, run and let go one after the other."""
    held, most = [], []
    made = scan._Block.__init__

    def counted(self, *a):
        made(self, *a)
        held.append(__import__("weakref").ref(self))
        __import__("gc").collect()
        most.append(sum(x() is not None for x in held))

    monkeypatch.setattr(scan._Block, "__init__", counted)
    monkeypatch.setattr(scan, "ROWS", 4)
    corpus = spark.createDataFrame([(i, [1.0 * i, 1.0]) for i in range(40)], "label long, v array<double>")
    assert scan.dense_top(corpus, corpus, 2).count() == 80
    assert len(held) == 10 and max(most) <= 2


def test_sums_and_places(spark):
    docs = texts(2, 50)
    r = np.random.default_rng(1)
    v = [x / np.linalg.norm(x) for x in r.standard_normal((50, 4))]
    corpus = spark.createDataFrame([(i, v[i].tolist(), docs[i], i // 10 if i % 7 else None) for i in range(50)], "label long, v array<double>, text string, dialogue long").repartition(4)
    sides = scan.Hybrid(corpus.where("label % 10 = 3"), corpus)
    split = [x.split() for x in docs]
    sums = {x.q: x for x in sides.sums().collect()}
    lists = sides.lists(5)
    places = {(x.q, x.label): (x.rs, x.rb) for x in sides.places(lists).collect()}
    assert len(places) == lists.count()
    for q in range(3, 50, 10):
        own = lambda x: x == q or (x // 10 if x % 7 else None) == (q // 10 if q % 7 else None)  # noqa: E731, B023
        b = {x: s for x, s in enumerate(okapi(split, split[q])) if not own(x)}
        s = {x: float(v[q] @ v[x]) for x in b}
        m = sums[q]
        assert m.n == len(b)
        for got, want in ((m.s_mean, np.mean([(x + 1) / 2 for x in s.values()])), (m.s_dev, np.std([(x + 1) / 2 for x in s.values()])), (m.b_mean, np.mean(list(b.values()))), (m.b_dev, np.std(list(b.values()))), (m.b_low, min(b.values())), (m.b_high, max(b.values()))):
            assert got == pytest.approx(want, abs=1e-9)
        at = lambda m: {x: i for i, x in enumerate(sorted(m, key=lambda x: (-round(m[x], 9), x)), 1)}
        ps, pb = at(s), at(b)
        assert {k: x for k, x in places.items() if k[0] == q} == {(q, x): (ps[x], pb[x]) for x in b if ps[x] <= 5 or pb[x] <= 5}


def test_equal_scores_have_no_deviation(spark):
    corpus = spark.createDataFrame([(i, [0.6, 0.8], "same text") for i in range(30)], "label long, v array<double>, text string").repartition(5)
    m = scan.Hybrid(corpus.where("label = 0"), corpus).sums().first()
    assert m.s_dev < 1e-12 and m.b_dev < 1e-12 and m.n == 29
