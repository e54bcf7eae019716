"""Queries of the operators, a thin one each, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .common import shared_dir, written
from .language import identify
from .media import features, store
from .mixing import mix
from .mixing_sql import mix_sql
from .neighbours import nearest
from .packing import pack
from .phrases import collocations, collocations_sql
from .pii import find_pii
from .prefix_counts import budgets, prefix_table
from .runs import periodic_runs, with_planted_period
from .secrets import find_secrets
from .simhash import near_duplicates
from .token_files import read_token_files, write_token_files
from .tokenizing import vocabulary
from .toxicity import toxicity


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"), vocabulary())
    return read_token_files(spark, files)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(store(table(spark, sf_dir, "documents")))
    return f.withColumn("seek_offsets", F.array_join(F.col("seek_offsets").cast("array<string>"), ","))


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_shards")).alias("taken"), F.array_join(F.col("mix_shards").cast("array<string>"), ",").alias("shards"))


def op8_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_rotated_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets(written(prefix_table(table(spark, sf_dir, "documents"), vocabulary()), "prefixes"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))


_OPERATORS = (op1_token_files, op2_simhash, op3_best_fit_packing, op4_mpeg_audio, op5_weak_toxicity, op6_zstd_novelty_secrets, op7_mixing, op8_deobfuscated_pii, op9_word_backoff_language, op10_rotated_bit_neighbours, op11_collocations, op12_prefix_counts, op13_lyndon_runs)


def _shipped(f: Callable) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    """The mix and the phrases have an SQL form; the others hash, encode, compress, extend or learn."""
    return {"op7_mixing": mix_sql(), "op11_collocations": collocations_sql()}
