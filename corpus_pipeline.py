"""Corpus cleaning in five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.llm import bpe, decontam, exact_dedup, lang_id, simhash
from prosodia.llm.shared import ascii_lower, materialise, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that resemble no language learnt from the labelled ones.

    Null and empty texts have no letter. Repeated rows and null ids are judged like any other, very long texts whole; where
    nothing is labelled, all texts with a letter stay. An empty table gives none."""
    return lang_id.recognised(docs, *lang_id.learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat id and text, one.

    Null counts as empty. A null id stays only where its text has no other. An empty table gives none."""
    classes = exact_dedup.exact_classes(docs, exact_dedup.older_half())
    classes = materialise(classes.select("doc_id", "kept", "text_sha256"))
    one, other = unused("gone_id", docs), unused("gone_sha", docs)
    gone = classes.where("not kept").select(F.col("doc_id").alias(one), F.col("text_sha256").alias(other)).distinct()
    sha = exact_dedup.sha256(ascii_lower(F.col("text")))
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(one)) & (sha == F.col(other)), "left_anti")
    repeated = classes.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies stays: texts whose sets of five-word shingles have
    a Jaccard similarity of 0.8 or more, directly or by way of others.

    Texts without words and null ids stay; rows that repeat an id go or stay together. Very long texts are compared whole.
    An empty table gives none."""
    gone, name = simhash.near_copies(docs), unused("gone_id", docs)
    gone = gone.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(materialise(gone), F.col("doc_id") == F.col(name), "left_anti")


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, as decontam.contaminated() tells them.

    Null and wordless texts and items match nothing. Repeated rows go or stay together, null ids too; very long texts are
    searched whole. Without items all stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' number and digest for each document that is left, decoded again as a proof.

    Null counts as empty. One row per input row, repeated rows and null ids included; very long texts are encoded whole. An
    empty table gives none."""
    import public_tokenizers

    return bpe.round_trips(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", benchmarks),
    ("byte_bpe", encoded),
]

#: SimHash and the trained stages can't be put in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
