"""Documents to packed training sequences: quality, lines, near duplicates, personal data, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last one
returns the packed pieces with their ids. Cases and their results are those of the operators in ``leadloom.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import lines, packing, pii, quality, simhash
from leadloom.llm.common import free_prefix, table, written
from leadloom.llm.tokens import vocabulary_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their language's and source's fences."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more characters found in 3 or more documents stay in the last of them only."""
    return lines.deduplicated(docs, least_chars=20, least_documents=3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows whose fingerprints link at 3 or fewer bits.

    The row with the smallest doc_id stays (nulls last), among several the one with the smallest
    fingerprint, then the smallest hash of all columns. Rows equal in all columns are one row. Rows
    are told apart by that hash (64 bits), so two texts under one doc_id are two documents.
    """
    row = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    own = f"{free_prefix(docs)}row"
    rows = docs.withColumn(own, row)
    found = simhash.near_duplicates(rows.select(own, "text"), shingle=3, distance=3, id_column=own).distinct()
    named = rows.select(own, F.col("doc_id").alias("name")).distinct()
    first = F.min(F.struct(F.col("name").isNull().alias("unnamed"), "name", "fp", own))
    kept = found.withColumnRenamed("doc_id", own).join(named, own).groupBy("component_id").agg(first.alias("first")).select(f"first.{own}")
    return rows.join(kept, own, "left_semi").dropDuplicates([own]).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in angle brackets."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids, each with its place and its ids as they lie in the built window."""
    return packing.packed(docs, vocabulary_file("byte_bpe_50k.json"), end_id=1, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mask_personal_data", mask_personal_data),
    ("pack", pack),
]

# Hashes of line runs, fingerprints and byte-pair ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for _, stage in before:
        docs = written(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
