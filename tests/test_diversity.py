"""Lexical diversity against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnloom.operators import selection
from turnloom.plans import catalog
from turnloom.plans import fixtures as fx
from turnloom.session import table

SF = "/root/testdata/sf0.001"


def okapi(docs, query):
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    w = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    low = 0.25 * sum(w.values()) / len(w)
    idf = {t: low if x < 0 else x for t, x in w.items()}
    return [sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query if t in df) for d in docs]


def picked(scores, like, k, weight):
    left, out = list(scores), []
    for _ in range(min(k, len(left))):
        i = max((x for x in range(len(left)) if x not in out), key=lambda x: (round(left[x], 9), -x))
        out.append(i)
        left = [s - weight * d for s, d in zip(left, like(i))]
    return out


def test_bm25_between_members():
    docs = ["a b b c".split(), "b c d".split(), [], "e e a".split(), "b".split()]
    m = selection.bm25_between(docs)
    for i, d in enumerate(docs):
        assert m[i].tolist() == pytest.approx(okapi(docs, d))
    assert selection.bm25_between([[]]).tolist() == [[0.0]]


@pytest.fixture(scope="module")
def lists(spark):
    text = {r.doc_id: [t for t in re.split(r"[ \t\n\x0b\f\r]+", r.text) if t] for r in table(spark, SF, "documents").collect()}
    vector = {r.label: np.array(r.v) for r in fx.vectors(spark, SF).collect()}
    sides = []
    for side in catalog._lists(spark, SF):
        found = defaultdict(list)
        for r in sorted(side.collect(), key=lambda r: r.rk):
            found[r.q].append((r.label, r.score))
        sides.append(found)
    return text, vector, *sides


def chosen(spark, name):
    out = defaultdict(list)
    for r in sorted(catalog.queries()[name](spark, SF).collect(), key=lambda r: r.rk):
        out[r.q].append(r.label)
    return dict(out)


def lexical(text, pool, k=5):
    docs = [text[x] for x, _ in pool]
    return [pool[i][0] for i in picked([s for _, s in pool], lambda i: okapi(docs, docs[i]), k, 0.5)]


def test_div_select_bm25(spark, lists):
    text, _, sparse, _ = lists
    assert chosen(spark, "div_select_bm25") == {q: lexical(text, p) for q, p in sparse.items()}


def test_div_round_robin(spark, lists):
    text, vector, sparse, dense = lists
    want = {}
    for q, p in dense.items():
        first = [p[i][0] for i in picked([s for _, s in p], lambda i: [float(vector[p[i][0]] @ vector[x]) for x, _ in p], 5, 0.5)]
        want[q] = selection.alternate(first, lexical(text, sparse[q]), 5)
    assert chosen(spark, "div_round_robin") == want


def test_round_robin_div(spark, lists):
    text, vector, sparse, dense = lists
    want = {}
    for q in dense:
        names = [[x for x, _ in dense[q]], [x for x, _ in sparse[q]]]
        side = {x: i % 2 if x in names[i % 2] else 1 - i % 2 for i, x in enumerate(selection.alternate(*names, 40))}
        own = sorted(((x, dict((dense, sparse)[s][q])[x]) for x, s in side.items()), key=lambda p: (-p[1], p[0]))
        docs = [text[x] for x, _ in own]

        def like(i):
            lex = okapi(docs, docs[i])
            return [lex[j] if side[x] else float(vector[own[i][0]] @ vector[x]) for j, (x, _) in enumerate(own)]

        want[q] = [own[i][0] for i in picked([s for _, s in own], like, 5, 0.5)]
    assert chosen(spark, "round_robin_div") == want


def test_multiply_div_top_k(spark, lists):
    text, vector, _, _ = lists
    from turnloom.operators import fusion

    pools = defaultdict(list)
    for r in fusion.fuse(catalog._sides(spark, SF), k_s=10, k_b=10).collect():
        pools[r.q].append((r.label, r.score))
    want = {}
    for q, p in pools.items():
        p = sorted(p, key=lambda x: (-x[1], x[0]))[:20]
        docs, v = [text[x] for x, _ in p], np.stack([vector[x] for x, _ in p])
        z = lambda m: (m - m.mean()) / (m.std() or 1.0)
        m = z(v @ v.T) * z(np.array([okapi(docs, d) for d in docs]))
        want[q] = [p[i][0] for i in picked([s for _, s in p], lambda i: m[i], 5, 0.2)]
    assert chosen(spark, "multiply_div_top_k") == want
