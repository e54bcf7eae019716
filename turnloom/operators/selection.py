"""Sequential selections within a bounded pool per query (Arrow-batched groups): greedy diversity, exact round robin.

Pools are cut to a fixed size by a window before they are grouped, so a group never grows with the data.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.state import distinct_similarity, heads
from .search import EPSILON, K1, B, ranked, tokens


def greedy(scores: np.ndarray, similarity: np.ndarray, k: int, weight: float) -> list[int]:
    """Repeatedly the highest score (ties: the first), after which all scores lose weight times their similarity to it."""
    left = scores.astype(float).copy()
    out: list[int] = []
    for _ in range(min(k, len(left))):
        i = int(np.argmax(np.round(left, 9)))
        out.append(i)
        left = left - weight * similarity[i]
        left[out] = -np.inf
    return out


def bm25_between(docs: list[list[str]]) -> np.ndarray:
    """BM25 scores within a pool of token lists, as in ``search.bm25_pool_scores``: a row is a member as the query."""
    n, counts = len(docs), [Counter(d) for d in docs]
    df = Counter(t for c in counts for t in c)
    at = {t: i for i, t in enumerate(sorted(df))}
    w = np.array([np.log(n - df[t] + 0.5) - np.log(df[t] + 0.5) for t in at])
    idf = np.where(w < 0, EPSILON * w.mean() if len(w) else 0.0, w)
    f = np.zeros((n, len(at)))
    for i, c in enumerate(counts):
        f[i, [at[t] for t in c]] = list(c.values())
    length = f.sum(1, keepdims=True)
    return f @ (idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / (length.mean() or 1.0)))).T


def diverse(pool: DataFrame, k: int, weight: float, size: int = 100) -> DataFrame:
    """q, label, rk chosen greedily. ``pool``: q, label, score, v (unit vectors); similarity is cosine."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "label"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf["v"].to_numpy())
        at = greedy(pdf["score"].to_numpy(), v @ v.T, k, weight)
        return pd.DataFrame({"q": pdf["q"].iloc[at].to_numpy(), "label": pdf["label"].iloc[at].to_numpy(), "rk": np.arange(1, len(at) + 1)})

    cut = ranked(pool, "q", k=size).select("q", "label", "score", "v")
    return cut.groupBy("q").applyInPandas(choose, "q long, label long, rk int")


def diverse_lexical(pool: DataFrame, k: int, weight: float, size: int = 100) -> DataFrame:
    """As ``diverse`` of a sparse list (q, label, score, text); similarity is BM25 within the pool."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "label"], ascending=[False, True]).reset_index(drop=True)
        at = greedy(pdf["score"].to_numpy(), bm25_between([list(t) for t in pdf["toks"]]), k, weight)
        return pd.DataFrame({"q": pdf["q"].iloc[at].to_numpy(), "label": pdf["label"].iloc[at].to_numpy(), "rk": np.arange(1, len(at) + 1)})

    cut = ranked(pool, "q", k=size).select("q", "label", "score", _toks())
    return cut.groupBy("q").applyInPandas(choose, "q long, label long, rk int")


def _toks():
    return F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("toks")


def diverse_mixed(pool: DataFrame, k: int, weight: float, size: int = 100) -> DataFrame:
    """As ``diverse`` with the product of both sides' similarities (cosine, and BM25 within the pool), each by its deviation
    in the pool; pool has text too."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "label"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf["v"].to_numpy())
        cos = v @ v.T
        lex = bm25_between([list(t) for t in pdf["toks"]])
        z = lambda m: (m - m.mean()) / (m.std() or 1.0)
        at = greedy(pdf["score"].to_numpy(), z(cos) * z(lex), k, weight)
        return pd.DataFrame({"q": pdf["q"].iloc[at].to_numpy(), "label": pdf["label"].iloc[at].to_numpy(), "rk": np.arange(1, len(at) + 1)})

    cut = ranked(pool, "q", k=size).select("q", "label", "score", "v", _toks())
    return cut.groupBy("q").applyInPandas(choose, "q long, label long, rk int")


def most_similar_states(pool: DataFrame, states: DataFrame, k: int, size: int = 200) -> DataFrame:
    """q, label, sim, rk: of the first ``size`` of each list (q, label, rk), the k whose states are most similar to the
    query's, ties to the better place. ``states``: label, b (slot-values without repeats); rows without one leave."""
    h = states.select("label", "b", heads(F.col("b")).alias("h"))
    first = pool.where(F.col("rk") <= size).select("q", "label", F.col("rk").alias("was"))
    both = first.join(h, "label").join(h.toDF("q", "qb", "qh"), "q")
    sim = F.round(distinct_similarity(F.col("qb"), F.col("qh"), F.col("b"), F.col("h")), 6)
    return ranked(both.select("q", "label", "was", sim.alias("sim")), "q", score="sim", tie="was", k=k).select("q", "label", "sim", "rk")


def alternate(first: list, second: list, k: int) -> list:
    """first, second, first, ...: a turn whose item was taken already goes on to the same list's next; ends with the lists."""
    out, seen = [], set()
    sides = [iter(first), iter(second)]
    turn, ended = 0, set()
    while len(out) < k and len(ended) < 2:
        for x in sides[turn]:
            if x not in seen:
                seen.add(x)
                out.append(x)
                break
        else:
            ended.add(turn)
        turn = 1 - turn
    return out


def round_robin(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """q, label, rk of the exact alternation. Both sides: q, label, rk; 2k of each side always suffice."""
    sides = dense.where(F.col("rk") <= 2 * k).withColumn("side", F.lit(0)).unionByName(sparse.where(F.col("rk") <= 2 * k).withColumn("side", F.lit(1)))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rk")
        got = alternate(*(pdf.loc[pdf["side"] == i, "label"].tolist() for i in (0, 1)), k)
        return pd.DataFrame({"q": pdf["q"].iloc[0], "label": got, "rk": np.arange(1, len(got) + 1)})

    return sides.select("q", "label", "rk", "side").groupBy("q").applyInPandas(choose, "q long, label long, rk int")


def diverse_round_robin(dense: DataFrame, sparse: DataFrame, k: int, weight: float, size: int = 100) -> DataFrame:
    """A diverse choice from each side (q, label, score, and v or text), then their exact alternation."""
    return round_robin(diverse(dense, k, weight, size), diverse_lexical(sparse, k, weight, size), k)


def round_robin_diverse(dense: DataFrame, sparse: DataFrame, k: int, weight: float, size: int = 100) -> DataFrame:
    """Greedy over both sides' pools (q, label, rk, score, v, text): the alternation says which side an item counts for;
    it has that side's score, and loses by that side's similarity (cosine, or BM25 within the pool) to what was chosen."""
    columns = ["q", "label", "rk", "score", "v", _toks(), "side"]
    both = dense.where(F.col("rk") <= size).withColumn("side", F.lit(0)).select(columns).unionByName(sparse.where(F.col("rk") <= size).withColumn("side", F.lit(1)).select(columns))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rk")
        lists = [pdf.loc[pdf["side"] == i, "label"].tolist() for i in (0, 1)]
        side: dict = {}
        for i, x in enumerate(alternate(*lists, len(pdf))):
            side[x] = i % 2 if x in lists[i % 2] else 1 - i % 2
        own = pdf[pdf["side"] == pdf["label"].map(side)].sort_values(["score", "label"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(own["v"].to_numpy())
        lexical = bm25_between([list(t) for t in own["toks"]])
        # a row is what an item does to the others: each of them loses by its own side's measure
        similarity = np.where((own["side"] == 0).to_numpy()[None, :], v @ v.T, lexical)
        at = greedy(own["score"].to_numpy(), similarity, k, weight)
        return pd.DataFrame({"q": own["q"].iloc[at].to_numpy(), "label": own["label"].iloc[at].to_numpy(), "rk": np.arange(1, len(at) + 1)})

    return both.groupBy("q").applyInPandas(choose, "q long, label long, rk int")
