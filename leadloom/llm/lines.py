"""Lines that repeat across documents: keep bitmaps per document, found by a range-partitioned sort.

Keys of lines (stripped, ASCII lower-cased) become 128-bit hashes, which are range-partitioned and
sorted by (hash, falling doc_id, position); one pass over each partition keeps the first document
of each hash (the largest doc_id) and marks later ones once a third document shows that the line
repeats. Ranges include doc_id and position, so a line that holds a third of all rows covers many
partitions; the pass then can't tell alone, and settles such lines at its borders through a table
with a few rows per partition. Text is not sorted: only hashes move, and bitmaps come back.

Defined results: null text is one empty line; rows of one doc_id are one document when documents
are counted; null doc_ids are one document, the smallest; equal rows get equal results; extra
columns stay untouched; an empty table gives no rows. Keys that differ but share a 128-bit hash
would be taken as one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import free_prefix, written

BLANK = b" \t\n\x0b\x0c\r"
DROPPED, OPEN, SEEN, LENGTH = 0, 1, 2, 3  # states of rows; LENGTH rows hold a document's number of lines


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hashes(docs: DataFrame, least_chars: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``a, b`` (the hash), ``doc_id, text_key, line`` of lines with long enough keys, and a LENGTH row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = (text or "").encode().lower().split(b"\n")  # bytes: only A-Z change
                rows.append((0, 0, doc_id, key, len(lines), LENGTH))
                for number, line in enumerate(lines):
                    line = line.strip(BLANK)
                    if len(line) >= least_chars and (line.isascii() or len(line.decode()) >= least_chars):
                        h = digest(line)
                        rows.append((_signed(h >> 64), _signed(h & (1 << 64) - 1), doc_id, key, number, OPEN))
            if rows:
                types = [pa.int64()] * 4 + [pa.int32()] * 2
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "doc_id", "text_key", "line", "state"])

    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "a long, b long, doc_id long, text_key long, line int, state int")


def _stream(least_documents: int):
    """One pass over a sorted partition.

    Gives the rows to drop; all rows of its first hash, which may have begun in the partition
    before, as OPEN; of its last hash, which may go on in the next, the undecided rows as OPEN
    and the first documents as SEEN.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "doc_id", "text_key", "line", "state"]
        types = [pa.int64()] * 4 + [pa.int32()] * 2
        hash_, number, documents, waiting, seen = None, 0, 0, [], []
        last = object()

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            out = []
            for a, b, doc_id, key, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != hash_:
                    hash_, number, documents, waiting, seen, last = (a, b), number + 1, 0, [], [], object()
                if doc_id != last:
                    last, documents = doc_id, documents + 1
                    if documents <= least_documents:
                        seen.append((a, b, doc_id, 0, 0, SEEN))
                    if documents == least_documents:
                        out += waiting
                        waiting = []
                if number == 1:
                    out.append((a, b, doc_id, key, line, OPEN))
                elif documents >= least_documents and documents > 1:
                    out.append((a, b, doc_id, key, line, DROPPED))
                elif documents > 1:  # bounded: lines of fewer than `least_documents` documents
                    waiting.append((a, b, doc_id, key, line, DROPPED))
            if out:
                yield batch_of(out)
        if rest := [(*row[:5], OPEN) for row in waiting] + seen:
            yield batch_of(rest)

    return run


def dropped_lines(hashes: DataFrame, least_documents: int) -> DataFrame:
    """``doc_id, text_key, line`` of all lines that go. ``hashes`` must be a written table: it is read twice."""
    order = [F.col("a"), F.col("b"), F.col("doc_id").desc_nulls_last(), F.col("text_key"), F.col("line")]
    lines = hashes.filter(F.col("state") == OPEN).drop("state")
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = written(ranged.mapInArrow(_stream(least_documents), hashes.schema))
    # Hashes at the borders: two a partition at most, so few, whatever the number of rows.
    open_ = streamed.filter(F.col("state") != DROPPED)
    border = (
        open_.select("a", "b", "doc_id").distinct().groupBy("a", "b")
        .agg(F.count("*").alias("documents"), F.max("doc_id").alias("largest"))
        .filter(F.col("documents") >= least_documents).drop("documents")
    )
    settled = (
        open_.filter(F.col("state") == OPEN).join(border, ["a", "b"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("largest")))
    )
    columns = ["doc_id", "text_key", "line"]
    return streamed.filter(F.col("state") == DROPPED).select(*columns).unionByName(settled.select(*columns))


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_documents: int = 3, **columns: str) -> DataFrame:
    """``doc_id, text_key, n_lines, n_dropped, keep`` for each document: zlib over one bit per line, set for lines that stay."""
    hashes = written(line_hashes(docs, least_chars, **columns))
    lengths = hashes.filter(F.col("state") == LENGTH).select("doc_id", "text_key", F.col("line").alias("n_lines"), F.lit(None).cast("int").alias("line"))
    dropped = dropped_lines(hashes, least_documents).withColumn("n_lines", F.lit(None).cast("int"))
    per_doc = lengths.unionByName(dropped).groupBy("doc_id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("line").alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for n, lines in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[lines] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            counts = [pa.array(batch.column(2).cast(pa.int64())), pa.array(map(len, batch.column(3).to_pylist()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *counts, pa.array(maps, pa.binary())], ["doc_id", "text_key", "n_lines", "n_dropped", "keep"])

    return per_doc.mapInArrow(run, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def kept_text(text: str | None, keep: bytes, n_lines: int) -> str:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    if bits.all():
        return text or ""
    return "\n".join(line for line, k in zip((text or "").split("\n"), bits, strict=True) if k)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, prefix: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``n_lines, n_dropped, keep`` of their bitmaps, their names behind ``prefix``."""
    mapped = bitmaps.select(*(F.col(c).alias(f"{prefix}{c}") for c in ("doc_id", "text_key", "n_lines", "n_dropped", "keep")))
    same = F.col(id_column).cast("long").eqNullSafe(F.col(f"{prefix}doc_id")) & (text_key(F.col(text_column).cast("string")) == F.col(f"{prefix}text_key"))
    return docs.join(mapped, same).drop(f"{prefix}doc_id", f"{prefix}text_key")


def deduplicated(docs: DataFrame, least_chars: int = 20, least_documents: int = 3, text_column: str = "text", **columns: str) -> DataFrame:
    """``docs`` with their texts rebuilt from the lines that stay; null texts stay null."""
    bitmaps, p = keep_bitmaps(docs, least_chars, least_documents, text_column=text_column, **columns), free_prefix(docs)
    rebuilt = F.pandas_udf(
        lambda text, keep, n: text.__class__([kept_text(t, k, c) for t, k, c in zip(text, keep, n, strict=True)]), "string"
    )
    joined = with_bitmaps(docs, bitmaps, p, text_column=text_column, **columns)
    text = F.when(F.col(f"{p}n_dropped") > 0, rebuilt(F.col(text_column), F.col(f"{p}keep"), F.col(f"{p}n_lines"))).otherwise(F.col(text_column))
    return joined.withColumn(text_column, text).select(*docs.columns)


def kept_digests(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` from the bitmaps applied to the texts."""
    docs = docs.select("doc_id", "text")
    joined = with_bitmaps(docs, keep_bitmaps(docs, **options), "_").select("doc_id", "text", "_n_lines", "_n_dropped", "_keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (1, 4, 2)), strict=True)
            hashes = [hashlib.sha256(kept_text(*row).encode()).hexdigest() for row in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3)), pa.array(hashes)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
