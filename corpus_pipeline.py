"""Corpus pipeline: quality, near-duplicates, benchmark leaks, mixture, token shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents; the last writes the token shards, reads them back and returns a row for each
document in them.

Defined results: a null or empty text is scored like any other by the quality stage, is a duplicate and a leak
of nothing, counts one token in the mixture and has only the end id in the shards; a null doc_id stays null, is
judged by its text, and is no duplicate; of rows equal in doc_id and text one stays; a null source is a source of
its own; further columns travel along whatever their names; an empty table gives an empty table in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.common import table
from riskweave.llm.decontaminate import drop_leaks
from riskweave.llm.minhash import keep_one
from riskweave.llm.mixing import mix
from riskweave.llm.quality import keep_good
from riskweave.llm.wavelet import token_shards
from riskweave.session import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts; it is fitted on the labels of these documents."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents into which a benchmark item leaks."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each copy that the target weights of the sources ask for."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns their documents: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_shards(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("tokens", tokens)]

#: A fitted classifier and library tokens are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
