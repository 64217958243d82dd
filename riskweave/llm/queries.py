"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, mixing, repair, variants, vectors
from .common import table


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import scores

    return scores(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .wavelet import token_shards

    return token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    return plan(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, reports

    return reports(damaged(table(spark, sf_dir, "conversations")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import variants

    return variants(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup, "op2_decontaminate": op2_decontaminate, "op3_order_minhash": op3_order_minhash, "op4_context_tree": op4_context_tree, "op5_toxicity": op5_toxicity, "op6_token_counts": op6_token_counts, "op7_licenses": op7_licenses, "op8_quality": op8_quality, "op9_token_shards": op9_token_shards, "op10_mixing": op10_mixing, "op11_conversation_repair": op11_conversation_repair, "op12_spelling_variants": op12_spelling_variants, "op13_embedding_dedup": op13_embedding_dedup, "pipeline": pipeline}
ORACLE_SQL: dict[str, str] = {"op7_licenses": licenses.oracle(), "op10_mixing": mixing.ORACLE, "op11_conversation_repair": repair.ORACLE, "op12_spelling_variants": variants.ORACLE, "op13_embedding_dedup": vectors.ORACLE}
