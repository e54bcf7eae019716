"""The negatives of a mined row that aren't hard ones."""

from collections import defaultdict

import pytest

from turnloom.operators import mining
from turnloom.plans import catalog

SF = "/root/testdata/sf0.001"


def sets(mined, easy):
    hard, pos, out = defaultdict(set), set(), defaultdict(list)
    for r in mined.collect():
        pos.add((r.q, r.label)) if r.kind == "pos" else hard[r.q].add(r.label)
    for r in easy.collect():
        out[r.q, r.pos].append((r.place, r.label))
    return hard, pos, out


def test_each_pair_of_the_query_has_all_its_easy_negatives(spark):
    hard, pos, out = sets(catalog.queries()["infonce_mining"](spark, SF), catalog.queries()["infonce_easy_negatives"](spark, SF))
    assert set(out) == pos
    for (q, p), got in out.items():
        labels = {x for _, x in got}
        assert sorted(x for x, _ in got) == [1, 2, 3, 4] and len(labels) == 4 and not labels & ({q, p} | hard[q])
    assert len({x for got in out.values() for _, x in got}) > len(pos)


@pytest.mark.parametrize("n, negatives, want", [(30, 7, 3), (12, 8, 4), (8, 8, 2), (6, 8, 0), (30, 1, 0), (0, 8, 0)])
def test_small_tables(spark, n, negatives, want):
    rows = [(0, 1, "pos", 1), (0, 2, "neg", 1), (0, 3, "neg", 2), (0, 4, "neg", 3), (0, 5, "neg", 4)]
    mined = spark.createDataFrame(rows, "q long, label long, kind string, place int")
    got = [r.label for r in mining.easy_negatives(mined, spark.range(n).toDF("label"), negatives).collect()]
    assert len(set(got)) == len(got) == want and not set(got) & set(range(6))


def test_a_pair_without_hard_negatives(spark):
    mined = spark.createDataFrame([(0, 1, "pos", 1)], "q long, label long, kind string, place int")
    assert mining.easy_negatives(mined, spark.range(5).toDF("label"), 4).count() == 2


def test_texts_of_mined_rows(spark):
    mined = spark.createDataFrame([(1, 2, "pos"), (1, 9, "neg")], "q long, label long, kind string")
    texts = spark.createDataFrame([(1, "a"), (2, None)], "label long, text string")
    got = sorted((r.q, r.label, r.kind, r.anchor, r.example) for r in mining.with_texts(mined, texts).collect())
    assert got == [(1, 2, "pos", "a", None), (1, 9, "neg", "a", None)]


def test_similarities_of_what_is_retrieved(spark):
    from turnloom.operators import scoring

    states = spark.createDataFrame([(1, ["a-x-1"], ["a-x-1", "a-y-2"]), (2, ["a-x-2|3"], ["a-x-1"]), (3, ["b-z-1"], []), (4, [], [])], "label long, turn array<string>, full array<string>")
    lists = spark.createDataFrame([(1, 2), (1, 3), (4, 3)], "q long, label long")
    queries = spark.createDataFrame([(1,), (4,), (5,)], "q long")
    r = scoring.retriever_similarities(lists, queries, states).first()
    # query 1: turn values 0 and 0, slots 1 and 0; all values 2/3 and 0, slots 2/3 and 0; query 4: 0, 0, 1, 1; query 5 has none
    assert tuple(r) == (0.0, round(0.5 / 3, 6), round((1 / 3 + 1) / 3, 6), round((1 / 3 + 1) / 3, 6), 3)
    assert scoring.retriever_similarities(lists.limit(0), queries.limit(0), states).first().queries == 0
