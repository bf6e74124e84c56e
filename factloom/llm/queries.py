"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import cross_entropy, fill_middle, line_dedup, metric_tree, mixing, multiset_hash, packing, quality, simhash, token_counts, toxicity, training_order, vantage_tree
from factloom.llm.tables import table


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = training_order.new_folder(spark, "training-order")
    return training_order.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"), k=3)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_quality_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.where(scored["tail_probability"] >= quality.KEEP)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.document_fingerprints(table(spark, sf_dir, "documents"))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transformed(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", relabelled)
    return vantage_tree.hard_negatives(vectors, every=100, positives=5, negatives=5, share=80).drop("positive_rank")


QUERIES = (
    op1_training_order,
    op2_line_dedup,
    op3_token_counts,
    op4_mix_sources,
    op5_simhash_components,
    op6_exact_top_k,
    op7_quality_selection,
    op8_document_fingerprints,
    op9_cross_entropy_difference,
    op10_pack_sequences,
    op11_toxicity,
    op12_fill_middle,
    op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": mixing.query_sql(), "op6_exact_top_k": metric_tree.ORACLE_SQL, "op12_fill_middle": fill_middle.ORACLE_SQL, "op13_hard_negatives": vantage_tree.ORACLE_SQL}
