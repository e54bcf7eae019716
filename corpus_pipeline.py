"""From documents to packed training sequences, in five stages; counted as part of the subpackage turnloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.common import partitions, written
from turnloom.llm.mixing import mixed
from turnloom.llm.packing import pack
from turnloom.llm.pii import redacted
from turnloom.llm.simhash import deduplicated
from turnloom.llm.tokenizing import vocabulary
from turnloom.llm.toxicity import without_toxic
from turnloom.session import ship, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go; it learns from the labels of the data folder. Null and empty
    texts and null ids score as they are; very long texts are read whole; repeated rows go or stay together; without labels of
    both kinds all rows stay; an empty table stays empty; all columns are kept, whatever their names."""
    ship(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one of the smallest doc_id (null last), then of the smallest text
    hash; of repeated rows one. Texts without a word, null ones too, are one component; very long texts are read whole; an empty table stays empty;
    all columns are kept, whatever their names."""
    ship(spark)
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every document stays, repeated rows too. Null texts stay null;
    very long texts are read whole; an empty table stays empty; n_chars follows the text, other columns are kept as they are."""
    ship(spark)
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, dealt to shards, each shard in an order of its own: a task a shard.
    Null texts have a size of 0 and null sources are one source, the last; repeated rows are documents of their own; very long
    texts count whole; an empty table stays empty; all columns are kept, whatever their names."""
    shards = 1 << max(4, (partitions(spark) - 1).bit_length())
    dealt = mixed(docs, shards=shards).repartitionByRange(shards, "mix_shard").sortWithinPartitions("mix_shard", "mix_order")
    return dealt.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, a row a piece. Null texts are empty (the end id alone); longer documents are cut; repeated
    rows and null ids are documents of their own; an empty table gives no rows; other columns are left out."""
    ship(spark)
    return pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: Weak supervision, XXH64 fingerprints and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
