"""Best-fit decreasing packing of tokenised documents into windows of fixed capacity.

Documents longer than the capacity are first cut into full windows. Pieces are then placed by
falling length, each into the open window with the least remaining capacity that still holds it,
found by a segment tree indexed by remaining capacity. Pieces of equal length are alike, so the
placement needs only the number of pieces of each length: it runs on that histogram (as many
entries as the capacity, whatever the number of documents), moves whole runs of equal windows at
once and gives the same windows as placing piece by piece. The result is a short table of runs;
every piece finds its place there by its rank among the pieces of its length. The ids are then
shuffled to their windows and laid out there; what is told of a piece's ids is cut back out of the
finished window.

Defined results: null text is empty (one id: the end); null doc_ids are kept; repeated rows are
documents of their own; extra columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import written
from leadloom.llm.tokens import binary_array, encoder, id_blocks


LAID_OUT = 512  # windows laid out at once


class OpenWindows:
    """Segment tree over remaining capacities 0..capacity: which have open windows."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._any = [False] * (2 * self._leaves)

    def put(self, remaining: int, some: bool) -> None:
        node = self._leaves + remaining
        self._any[node] = some
        while node > 1:
            node //= 2
            self._any[node] = self._any[2 * node] or self._any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest remaining capacity of ``least`` or more with an open window."""
        node = self._leaves + least
        if self._any[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self._any[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node if self._any[2 * node] else 2 * node + 1
                return node - self._leaves
            node //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, rank, each, window, offset)``.

    The pieces of ``length`` from ``rank`` on go to windows from ``window`` on, ``each`` of them
    to one window from ``offset`` on. A window's remaining capacity at least halves whenever a
    length is placed in it, and each length splits or opens only a few runs, so there are at most
    some ``4 * capacity * log2(capacity)`` of them.
    """
    tree = OpenWindows(capacity)
    windows: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs (first, number) by remaining capacity
    runs, fresh = [], 0

    def hold(remaining: int, first: int, number: int) -> None:
        if remaining and number:
            windows[remaining].append((first, number))
            tree.put(remaining, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, number = capacity, fresh, -(-left // (capacity // length))
                fresh += number
            else:
                first, number = windows[remaining].pop()
                if not windows[remaining]:
                    tree.put(remaining, False)
            each = remaining // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, each, first, capacity - remaining))
                hold(remaining - each * length, first, full)
                left, rank, first, number = left - full * each, rank + full * each, first + full, number - full
            if number and left:  # the last window takes fewer; here left < each
                runs.append((length, rank, each, first, capacity - remaining))
                hold(remaining - left * length, first, 1)
                left, first, number = 0, first + 1, number - 1
            hold(remaining, first, number)
    return runs


def stored(tokenizer: str, end_id: int) -> str:
    """Type of the ids on their way to the windows: two bytes if every id fits."""
    return "<u2" if max(*encoder(tokenizer).ids(), end_id) < 1 << 16 else "<u4"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of every document with their ids (as ``stored``), numbered per task and length; one written table."""
    kind = stored(tokenizer, end_id)
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        document = 0
        for keys, ids, counts in id_blocks(batches, tokenizer, end_id):
            per_doc = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), per_doc)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * capacity
            length = np.minimum(counts[doc] - start, capacity)
            order = np.argsort(length, kind="stable")
            number = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(seen, number)
            seen += number
            raw = ids.astype(kind).tobytes()
            columns = [pa.array(np.full(len(doc), part)), pa.array(document + doc), keys.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(counts[doc]), pa.array(rank), binary_array(length * size, raw)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "document", "doc_id", "start", "length", "doc_tokens", "rank", "ids"])
            document += len(counts)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "part long, document long, doc_id long, start long, length long, doc_tokens long, rank long, ids binary"))


def placed(cut: DataFrame, capacity: int) -> DataFrame:
    """``cut`` (see ``pieces``) without ids, with ``sequence_id`` and ``offset``.

    Ranks within a length are the task's own rank plus the pieces of that length in tasks before
    it, so no length, however frequent, is gathered in one task. To the driver comes the
    histogram of lengths: ``capacity`` numbers.
    """
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = per_part.select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(best_fit_runs(histogram, capacity))
    table = np.array(runs, np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]  # ranks stay below 2**48

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy() for i in (5, 6))
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            _, first_rank, each, window, offset = table[at].T
            step = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(window + step // each), pa.array(offset + step % each * length)],
                ["part", "document", "doc_id", "start", "doc_tokens", "length", "sequence_id", "offset"],
            )

    ranked = cut.join(before, ["length", "part"]).select(
        "part", "document", "doc_id", "start", "doc_tokens", "length", (F.col("rank") + F.col("before")).alias("rank")
    )
    return ranked.mapInArrow(run, "part long, document long, doc_id long, start long, doc_tokens long, length long, sequence_id long, offset long")


def windows(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, pad_id: int = 0, **columns: str) -> DataFrame:
    """The packed sequences: ``sequence_id, n_tokens, ids`` (capacity ids each, padded), and by offset the doc_ids and ``pieces`` inside."""
    cut = pieces(docs, tokenizer, end_id, capacity, **columns)
    keys = ["part", "document", "start"]
    rows = placed(cut, capacity).join(cut.select(*keys, "ids"), keys)
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "doc_tokens", "ids")))  # at most `capacity` pieces
    full = rows.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("held", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    inside = F.transform("held", lambda x: x.dropFields("ids"))
    laid = full.select("sequence_id", "n_tokens", F.col("held.doc_id").alias("doc_ids"), inside.alias("pieces"), ids.alias("ids"))
    kind = stored(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, LAID_OUT):
                some = batch.slice(first, LAID_OUT)
                out = np.full((some.num_rows, capacity), pad_id, "<u4")
                for row, x in zip(out, some.column(4), strict=True):
                    held = np.frombuffer(x.as_buffer(), kind)
                    row[: len(held)] = held
                yield pa.RecordBatch.from_arrays([*some.columns[:4], binary_array(np.full(len(out), 4 * capacity), out)], batch.schema.names)

    return laid.mapInArrow(run, laid.schema)


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, **columns: str) -> DataFrame:
    """Every piece of every document with its place and its ids there: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids``.

    ``ids`` (4 bytes each, little endian) are cut out of the built sequence by offset and length.
    """
    each = windows(docs, tokenizer, end_id, capacity, **columns).select("sequence_id", F.col("ids").alias("all"), F.explode("pieces").alias("p"))
    ids = F.substring("all", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids")
    return each.select("p.*", "sequence_id", ids.alias("ids")).withColumn("ids_crc32", F.crc32("ids")).select(*names)
