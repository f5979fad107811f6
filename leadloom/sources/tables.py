"""Reading pages, listings and lead files; writing results, accepted, rejected and summary tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from leadloom.functions.arrays import joined
from leadloom.operators.parse import declared_charset, decode_html, sniffed_charset
from leadloom.sources import versions


def read_pages(spark: SparkSession, path: str, sniff: bool = False, multibyte: bool = False) -> DataFrame:
    """Crawled pages; raw bytes are decoded, bad ones replaced.

    The charset is the one that the column ``content_type``, if there is one, names; UTF-8 without.
    With ``sniff`` a byte-order mark or a meta tag is asked before UTF-8 is taken; ``multibyte`` see ``decode_html``.
    """
    pages = spark.read.parquet(path)
    if isinstance(pages.schema["html"].dataType, BinaryType):
        raw, charset = F.col("html"), F.lit(None).cast("string")
        if "content_type" in pages.columns:
            charset = declared_charset(F.col("content_type"))
        if sniff:
            charset = F.coalesce(charset, sniffed_charset(raw))
        known = sniff or "content_type" in pages.columns
        pages = pages.withColumn("html", decode_html(raw, charset if known else None, multibyte))
    return pages


# A record in one line: quotes stand around whole cells only and are doubled inside them.
_WHOLE_LINE = r"""^(?:"(?:[^"\r]|"")*+"|[^",\r]*+)(?:,(?:"(?:[^"\r]|"")*+"|[^",\r]*+))*+\r?$"""


def whole_line_files(spark: SparkSession, path: str) -> list[str]:
    """CSV files longer than one scan split in which every line is a whole record."""
    lines = spark.read.option("lineSep", "\n").text(path)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    # Files are chosen by their listed size: without a long one nothing is read.
    long = lines.filter(F.col("_metadata.file_size") > split).groupBy(F.col("_metadata.file_path").alias("file"))
    whole = long.agg(F.bool_and(F.col("value").rlike(_WHOLE_LINE)).alias("whole")).filter("whole")
    return sorted(r.file for r in whole.collect())


def read_leads_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column stays text.

    A cell may hold line breaks, so a file is read by one task, unless it is longer than a scan
    split (``spark.sql.files.maxPartitionBytes``) and all its lines are whole records. Line breaks
    inside cells come as a line feed where the file's own are carriage return and line feed.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    rows = reader.option("multiLine", True).csv(path)
    whole = whole_line_files(spark, path)
    if not whole:
        return rows
    file = F.col("_metadata.file_path")
    split = reader.option("multiLine", False).schema(rows.schema).csv(path)
    return rows.filter(~file.isin(whole)).unionByName(split.filter(file.isin(whole)))


def cells(df: DataFrame) -> DataFrame:
    """Every column as cell text: lists joined, NULL, zero and false as the empty string."""
    def cell(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, ArrayType):
            return joined(c)
        text = F.coalesce(c.cast("string"), F.lit(""))
        if field.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
            return F.when(c == 0, F.lit("")).otherwise(text)
        if field.dataType.typeName() == "boolean":
            return F.when(c, F.lit("True")).otherwise(F.lit(""))
        return text

    return df.select(*[cell(f).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; without rows the files are empty, header included."""
    writer = df.write.mode("overwrite").option("header", not df.isEmpty()).option("escape", '"')
    # White space at the ends of a value is part of it.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_results(df: DataFrame, path: str) -> bool:
    """Replace a results table by the cells of ``df``; no rows leave the table untouched.

    The new rows are written beside the old ones and then published, so readers (``read_rows``)
    see either and a run that ends in between leaves the old table.
    """
    if df.isEmpty():
        return False
    versions.put(cells(df), path, drop=lambda _: True)
    return True


def grown(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both tables under the columns of both, known columns first, blanks as ""."""
    renamed = new.select(*[F.col(f"`{c}`").alias(c.strip()) for c in new.columns])
    return existing.unionByName(renamed, allowMissingColumns=True).na.fill("")


def append_rows(df: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append rows as cell text; columns the table does not know yet are added, old files stay as they are.

    Rows appended under a ``run_id`` take the place of those that this run appended before.
    """
    named = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])
    versions.put(cells(named), path, uuid.uuid4().hex if run_id is None else f"run {run_id}")


def read_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """A results, summary or growing table, blanks as "" and known columns first; None if it does not exist yet."""
    rows = versions.read(spark, path, merge=True)
    return None if rows is None else rows.na.fill("")


def write_summary(summary: DataFrame, path: str) -> bool:
    """Replace the summary table as ``write_results`` does; an empty summary changes nothing."""
    if summary.isEmpty():
        return False
    versions.put(summary, path, drop=lambda _: True)
    return True
