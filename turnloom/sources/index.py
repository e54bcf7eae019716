"""Search indexes as tables: reading, writing, and uniting several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(df: DataFrame, path: str) -> None:
    """label, embedding and utt as Parquet; an empty index is an error."""
    if df.isEmpty():
        raise ValueError("nothing to index")
    df.select("label", "embedding", *(["utt"] if "utt" in df.columns else [])).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_indexes(indexes: list[DataFrame]) -> DataFrame:
    """One row a label; of labels in several files (column file) the last file's."""
    every = reduce(DataFrame.unionByName, indexes)
    rest = [c for c in every.columns if c != "label"]
    return every.groupBy("label").agg(F.max_by(F.struct(*rest), "file").alias("_r")).select("label", "_r.*")
