"""Vectors of texts by batch inference. A model is a function that a worker calls once: it returns ``tokenize`` (texts to lists
of token ids) and ``hidden`` (ids and mask, both texts by tokens, to a vector a token). Cutting, padding, the masked mean and
the length of 1 are the engine's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..sources.index import read_index, write_index

Load = Callable[[], tuple[Callable[[list[str]], list[list[int]]], Callable[[np.ndarray, np.ndarray], np.ndarray]]]
#: Texts of a batch, and tokens of a text that a model sees.
BATCH, LIMIT = 64, 512


def pooled(hidden: np.ndarray, mask: np.ndarray, unit: bool = True) -> np.ndarray:
    """The mean of each text's token vectors (zeros without a token), at length 1 if ``unit``; zeros stay zeros."""
    m = mask[:, :, None].astype(float)
    mean = (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12) if unit else mean


def encoded(texts: DataFrame, load: Load, unit: bool = True, batch: int = BATCH, limit: int = LIMIT) -> DataFrame:
    """label, embedding and utt of ``texts`` (label, text). Null texts are empty; tokens behind ``limit`` aren't seen, as the
    model's window has it. A worker loads the model once."""

    def make():
        tokenize, hidden = load()

        def predict(column: np.ndarray) -> np.ndarray:
            ids = [x[:limit] for x in tokenize([str(x) for x in column])]
            n = max(1, max(map(len, ids)))
            padded, mask = np.zeros((len(ids), n), np.int64), np.zeros((len(ids), n), np.int64)
            for i, x in enumerate(ids):
                padded[i, : len(x)], mask[i, : len(x)] = x, 1
            return pooled(np.asarray(hidden(padded, mask), float), mask, unit)

        return predict

    vector = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch)
    utt = F.coalesce("text", F.lit(""))
    return texts.select("label", vector(utt).alias("embedding"), utt.alias("utt"))


def build_index(texts: DataFrame, load: Load, path: str, **how) -> DataFrame:
    """Encode ``texts`` (label, text), write the index and read it back; no texts are an error."""
    write_index(encoded(texts, load, **how), path)
    return read_index(texts.sparkSession, path)


def load_stand_in():
    """A deterministic model without weights: a token is a word's length, its vector four small numbers."""
    tokenize = lambda texts: [[len(w) for w in t.split(" ") if w] for t in texts]
    hidden = lambda ids, mask: np.stack([np.ones_like(ids), ids % 7, ids % 5, ids % 3], axis=2)
    return tokenize, hidden
