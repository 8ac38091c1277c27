"""From documents to packed training sequences: quality classifier, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept, and is written as Parquet before the next. All
but the last return the columns of documents. Decisions are about rows: null or repeated ids change none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venation.llm._shared import table, uncarried, written
from venation.llm.classifier import classify
from venation.llm.dedup import near_duplicates
from venation.llm.packing import pack
from venation.llm.rules import quality_rules


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts, at its threshold of 0.7."""
    return uncarried(classify(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 1"), docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's band of perplexity."""
    return uncarried(quality_rules(docs, carry=True).where("kept"), docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity of 0.8 or more. The smallest id stays, null ids last."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # written, so that numbers stay
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    first = found.join(rows.select("_row", "doc_id"), "_row").groupBy("_group").agg(F.min(order)["_row"].alias("_row")).select("_row")
    return rows.join(first, "_row", "left_semi").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    from public_tokenizers import path

    return pack(docs, path("byte_bpe_50k.json"))


STAGES = [("classifier", classifier), ("rules", rules), ("dedup", dedup), ("packing", packing)]

#: The learnt stages can't be told in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
