"""The ten operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosodia.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosodia.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives as a snapshot and one batch, so that the filters are used; every row is in one of the two."""
    from prosodia.llm.exact_dedup import exact_classes, older_half

    return exact_classes(table(spark, sf_dir, "documents", "doc_id", "text"), older_half())


ORACLE_SQL["op2_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


@query
def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from prosodia.llm.token_count import token_counts

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from prosodia.llm.bpe import round_trips

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return round_trips(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosodia.llm.lang_id import learn, predict

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, *learn(docs))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosodia.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosodia.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages", "page_id", "url"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosodia.llm.secret_scan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op9_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosodia.llm.pii import scan

    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosodia.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
