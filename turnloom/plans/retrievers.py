"""Retrievers and decoders by name, each a function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, scan, search, selection


def bm25(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """queries: q, text; corpus: label, text."""
    return scan.bm25_top(queries, corpus, k)


def embedding(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Both with label and v, unit vectors."""
    return scan.dense_top(queries, corpus, k)


#: The strategies that a hybrid decoder is configured with by name; the last two decode one side alone.
LOGICS = ("multiply_top_k", "weighted_sum", "rrf", "top_k_round_robin", "div_topk_round_robin", "multiply_div_top_k", "round_robin_div_top_k", "bm25_div", "sbert_div")


def decode_hybrid(sides: scan.Hybrid, logic: str = "top_k_round_robin", k_s: int = 5, k_b: int = 5, corpus: DataFrame | None = None, alpha: float = 0.5, discount: float = 0.2, how: str = "z", pool: int | None = None) -> DataFrame:
    """q, label, rk of k_s + k_b choices from both sides, by the strategy of that name.

    ``corpus`` (label, v, text) is what the diverse strategies compare; ``pool`` is how many of a side they see (twice its
    k unless given).
    """
    if logic not in LOGICS:
        raise ValueError(f"unknown decoding logic: {logic}")
    if logic in ("multiply_top_k", "weighted_sum", "rrf"):
        return fusion.fuse(sides, logic, k_s, k_b, alpha, how)
    k = k_s + k_b
    if logic != "top_k_round_robin" and corpus is None:
        raise ValueError(f"{logic} needs the corpus")
    n_s, n_b = pool or 2 * k_s, pool or 2 * k_b
    if logic == "multiply_div_top_k":
        product = fusion.fuse(sides, "multiply_top_k", n_s, n_b, how=how)
        return selection.diverse_mixed(product.join(corpus, "label"), k, discount, n_s + n_b)
    s, b = sides.one("s", max(n_s, 2 * k)), sides.one("b", max(n_b, 2 * k))
    if logic == "top_k_round_robin":
        return selection.round_robin(s, b, k)
    s, b = (x.join(corpus, "label") for x in (s, b))
    if logic == "sbert_div":
        return selection.diverse(s, k, discount, max(n_s, k))
    if logic == "bm25_div":
        return selection.diverse_lexical(b, k, discount, max(n_b, k))
    chosen = selection.diverse_round_robin if logic == "div_topk_round_robin" else selection.round_robin_diverse
    return chosen(s, b, k, discount, max(n_s, n_b, k))


def hybrid(queries: DataFrame, corpus: DataFrame, k: int, logic: str = "multiply_top_k", dialogues: DataFrame | None = None) -> DataFrame:
    """Both with label, v and text. With ``dialogues`` (label, dialogue) a query's own dialogue is left out."""
    if dialogues is not None:
        queries, corpus = (x.join(dialogues.select("label", "dialogue"), "label", "left") for x in (queries, corpus))
    return decode_hybrid(scan.Hybrid(queries, corpus), logic, k, k, corpus.select("label", "v", "text"))


def random(queries: DataFrame, corpus: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return search.random_examples(queries, corpus, k, seed)


def none(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    raise ValueError("this run is configured without a retriever")


_RETRIEVERS: dict[str, Callable] = {"bm25": bm25, "embedding": embedding, "embeddingretriever": embedding, "sbert": embedding, "sgd": embedding, "hybrid": hybrid, "random": random, "no_retriever": none}
_DECODERS: dict[str, Callable] = {"top_k": search.top_k, "max_emb_distance": selection.diverse, "hybrid": decode_hybrid, "f1_top_k": selection.most_similar_states}


def retriever(name: str) -> Callable:
    if name.lower() not in _RETRIEVERS:
        raise ValueError(f"unknown retriever type: {name}")
    return _RETRIEVERS[name.lower()]


def decoder(name: str | None) -> Callable:
    if (name or "top_k") not in _DECODERS:
        raise ValueError(f"unknown decoder type: {name}")
    return _DECODERS[name or "top_k"]
