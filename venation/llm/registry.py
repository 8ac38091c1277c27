"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses
from ._shared import table


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of conversations as a call; its JSON is given by digest and length."""
    out = chat.linked_calls(*chat.calls_of(table(spark, sf_dir, "conversations")), chat.SCHEMAS)
    return out.select("conv_id", "turn", "call_id", F.col("level").cast("long").alias("level"), "status", "problems", "result_turn", F.md5(F.col("json").cast("binary")).alias("json_md5"), F.length("json").cast("long").alias("json_chars"))


def op2_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hashing_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .subword import encoded_digests

    return encoded_digests(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op7_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import known, scan

    return scan(table(spark, sf_dir, "documents"), known(spark))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .automaton import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_tool_call_linking,
        op2_ngram_perplexity,
        op3_minhash_dedup,
        op4_positive_unlabelled,
        op5_multi_index_hashing,
        op6_merge_dropout,
        op7_text_density,
        op8_canonical_digest,
        op9_pattern_packing,
        op10_backoff_automaton,
    )
}
SQL: dict[str, str] = {"op1_tool_call_linking": chat.SQL, "op8_canonical_digest": licenses.SQL}
