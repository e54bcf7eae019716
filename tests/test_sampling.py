"""Sampling by text keys, permutations that aren't rotations, and hybrid strategies by name."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import sampling, scan, selection
from turnloom.plans import retrievers

from .test_diversity import okapi


def _order(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("ratio", [0.0, 0.13, 1.0])
def test_samples_of_text_and_large_keys(spark, ratio):
    for keys in ([f"PMUL{i}.json" for i in range(300)], [(1 << 60) + i for i in range(300)]):
        df = spark.createDataFrame([(k, t) for k in keys for t in range(2)], ["id", "turn"])
        got = {r.id for r in sampling.by_row(df.where("turn = 0"), "id", ratio, 7).collect()}
        assert got == set(_order(keys, 7)[: int(300 * ratio)])
        whole = sampling.by_dialogue(df, "id", ratio, 7)
        assert whole.count() == 2 * int(300 * ratio)
        dev = sampling.disjoint(df, df.where("turn = 0").select("id").limit(100), "id", ratio).count()
        assert dev == min(200, int(300 * ratio))


def test_sampling_by_name(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "dialogue string, key int")
    assert sampling.sampled(df, "none", "key", "dialogue").count() == 2
    assert sampling.sampled(df, "random_by_dialog", "key", "dialogue", 0.5).count() == 1
    assert sampling.sampled(df, "pre_assigned", "key", "dialogue", ids=df.select("dialogue").limit(1)).count() == 1
    for how, ids in (("else", None), ("pre_assigned", None)):
        with pytest.raises(ValueError):
            sampling.sampled(df, how, "key", "dialogue", ids=ids)


def test_permutations_are_not_rotations(spark):
    pool = spark.createDataFrame([(50, f"l{i}", i) for i in range(20)], "q long, label string, pos int")
    rows = sampling.permutations(pool, 3).collect()
    lists = [[r.label for r in sorted(rows, key=lambda r: r.out_pos) if r.iter == i] for i in range(3)]
    assert all(sorted(x) == sorted(lists[0]) for x in lists)
    for a in range(3):
        for b in range(a):
            assert all(lists[a] != lists[b][i:] + lists[b][:i] for i in range(20))


@pytest.fixture(scope="module")
def sides(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(40):
        v = r.standard_normal(8)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), " ".join(r.choice(words, 12))))
    corpus = spark.createDataFrame(rows, "label long, v array<double>, text string").cache()
    vectors = {i: np.array(v) for i, v, _ in rows}
    s = {(q, x): float(vectors[q] @ vectors[x]) for q in range(0, 40, 10) for x in range(40) if x != q}
    b = {(q, x): score for q in range(0, 40, 10) for x, score in enumerate(okapi([t.split() for *_, t in rows], rows[q][2].split())) if x != q}
    return corpus, s, b


def hybrid(corpus, dialogues=None):
    if dialogues is not None:
        corpus = corpus.join(dialogues, "label")
    return scan.Hybrid(corpus.where("label % 10 = 0"), corpus)


@pytest.mark.parametrize("logic", retrievers.LOGICS)
def test_every_strategy_by_name(spark, sides, logic):
    corpus, _, _ = sides
    dialogues = corpus.select("label", F.floor(F.col("label") / 5).alias("dialogue"))
    got = retrievers.decode_hybrid(hybrid(corpus, dialogues), logic, 3, 2, corpus).collect()
    for q in range(0, 40, 10):
        mine = sorted((r.rk, r.label) for r in got if r.q == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and len({m[1] for m in mine}) == 5
        assert all(m[1] // 5 != q // 5 for m in mine)


def test_strategies_by_brute_force(spark, sides):
    corpus, s, b = sides
    both = hybrid(corpus)
    v = {r.label: np.array(r.v) for r in corpus.collect()}
    first = lambda score, q: sorted((x for x in range(40) if x != q), key=lambda x: (-round(score.get((q, x), 0.0), 6), x))
    for q in range(0, 40, 10):
        of = lambda logic: [r.label for r in sorted(retrievers.decode_hybrid(both, logic, 3, 3, corpus).where(F.col("q") == q).collect(), key=lambda r: r.rk)]  # noqa: E731, B023
        assert of("top_k_round_robin") == selection.alternate(first(s, q), first(b, q), 6)
        left, chosen = {x: round(s[q, x], 6) for x in first(s, q)[:6]}, []
        while left:
            x = max(left, key=lambda x: (round(left[x], 9), -first(s, q).index(x)))  # noqa: B023
            chosen.append(x)
            del left[x]
            left = {y: z - 0.2 * float(v[x] @ v[y]) for y, z in left.items()}
        assert of("sbert_div") == chosen
        z = lambda m: {x: (m[x] - np.mean(list(m.values()))) / np.std(list(m.values())) for x in m}
        zs, zb = z({x: s[q, x] for x in range(40) if x != q}), z({x: b.get((q, x), 0.0) for x in range(40) if x != q})
        pool = set(first(s, q)[:6]) | set(first(b, q)[:6])
        assert of("multiply_top_k") == sorted(pool, key=lambda x: (-round(zs[x] * zb[x], 6), x))[:6]  # noqa: B023
        assert of("weighted_sum") == sorted(pool, key=lambda x: (-round((zs[x] + zb[x]) / 2, 6), x))[:6]  # noqa: B023
        place = lambda m: {x: i for i, x in enumerate(sorted((x for x in range(40) if x != q), key=lambda x: (-round(m[q, x], 9), x)), 1)}  # noqa: E731, B023
        ps, pb = place(s), place(b)
        assert of("rrf") == sorted(ps, key=lambda x: (-round(1 / (59 + ps[x]) + 1 / (59 + pb[x]), 6), x))[:6]  # noqa: B023


def test_unknown_strategies_are_errors(sides):
    corpus, _, _ = sides
    for logic, c in (("else", corpus), ("sbert_div", None)):
        with pytest.raises(ValueError):
            retrievers.decode_hybrid(None, logic, corpus=c)
    assert retrievers.decoder("f1_top_k") is selection.most_similar_states
    assert retrievers.decoder("hybrid") is retrievers.decode_hybrid
