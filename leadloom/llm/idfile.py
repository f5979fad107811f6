"""Token-id files: canonical length-limited Huffman code over independent blocks.

Layout of a folder (all parts written by Spark, so a lost executor or a repeated task leaves no
half file):

* ``code``: ``id, length`` for each id in use; the canonical code follows from the lengths.
* ``blocks``: one row per block: ``shard, block, start`` (ids of all documents before it),
  ``doc_ids``, ``doc_tokens``, ``marks`` (bit offset in the payload of every ``STRIDE``-th id of
  each document, so that decoding can begin there), ``payload`` (the documents' bit strings, each
  from a byte border on).

Shards are ranges of doc_id with near equal numbers of ids; ascending (shard, block) is ascending
doc_id. Documents are never cut, so a block decodes alone.

Defined results: null text is empty (one id: the end); null doc_ids come first; repeated rows are
kept, each as a document of its own, those of one doc_id ordered by their ids; extra columns are
not read; an empty table gives a folder without blocks, which reads back as no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import forget, work_folder, written
from leadloom.llm.tokens import binary_array, id_blocks

MAX_LENGTH = 20  # bits; the decoding table has 2**20 entries
STRIDE = 512
BLOCK_IDS = 1 << 17
SHARD_IDS = 1 << 24


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits (package-merge); 0 for symbols that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(len(leaves), bool)]  # True: a leaf, False: a package of two
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        kinds.append(rank < len(leaves))
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for kind in reversed(kinds):
        n = int(kind[:take].sum())
        depth[:n] += 1  # the lightest leaves are those taken
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by symbol, and the symbols by (length, symbol)."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    wide = np.uint64(1) << (np.uint64(MAX_LENGTH) - lengths[symbols].astype(np.uint64))
    codes = np.zeros(len(lengths), np.uint32)
    starts = np.cumsum(wide) - wide  # left-aligned codes follow each other
    codes[symbols] = (starts >> (np.uint64(MAX_LENGTH) - lengths[symbols].astype(np.uint64))).astype(np.uint32)
    return codes, symbols


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """For the next ``MAX_LENGTH`` bits: symbol * 32 + length."""
    _, symbols = canonical(lengths)
    entry = symbols.astype(np.uint32) << 5 | lengths[symbols]
    table = np.repeat(entry, 1 << (MAX_LENGTH - lengths[symbols].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << MAX_LENGTH) - len(table), np.uint32)])


def encode(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit strings of documents laid end to end (each from a byte border on), bytes per document, bit offset of each id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    last = np.cumsum(counts)
    bits = np.diff(np.concatenate([[0], ends])[last], prepend=0)
    n_bytes = (bits + 7) // 8
    shift = (np.cumsum(n_bytes) - n_bytes) * 8 - (np.cumsum(bits) - bits)
    at = ends - size + np.repeat(shift, counts)
    value = codes[ids].astype(np.uint64) << (32 - (at & 7) - size).astype(np.uint64)  # within 4 bytes from at >> 3
    out = np.zeros(int(n_bytes.sum()) + 4, np.uint8)
    for k in range(4):  # bits of different ids never overlap, so adding them sets them
        byte = ((value >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.uint8)
        np.add.at(out, (at >> 3) + k, byte)
    return out[:-4], n_bytes, at


def decode(payload: np.ndarray, marks: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ids of runs that begin at bit offsets ``marks`` and hold ``sizes`` ids; all runs advance together."""
    data = np.concatenate([payload, np.zeros(8, np.uint8)])
    # 32 bits from each byte on: a code of 20 bits starts at most 7 bits in.
    words = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    order = np.argsort(-sizes, kind="stable")
    at, left = marks[order].astype(np.int64), sizes[order]
    first = (np.cumsum(sizes) - sizes)[order]
    out = np.zeros(int(sizes.sum()), np.uint32)
    longest = int(sizes.max()) if len(sizes) else 0
    alive = np.searchsorted(-left, -np.arange(longest), "left")  # runs with more than k ids
    for k in range(longest):
        n = alive[k]
        here = at[:n]
        entry = table[(words[here >> 3] >> (32 - MAX_LENGTH - (here & 7)).astype(np.uint32)) & ((1 << MAX_LENGTH) - 1)]
        out[first[:n] + k] = entry >> 5
        at[:n] = here + (entry & 31)
    return out


def tokenised(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, counts in id_blocks(batches, path, end_id):
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts), binary_array(counts * 4, ids.astype("<u4"))], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS, **columns: str) -> None:
    """Tokenise ``docs`` and write the folder ``path``.

    The texts are tokenised once, into a table in the shared folder; counting, the choice of
    ranges and the encoding read that table. Only bit strings are shuffled, to their shards.
    To the driver come the counts of the vocabulary, the range borders and the ids per range.
    """
    spark = docs.sparkSession
    staged = written(tokenised(docs, tokenizer, end_id, **columns))
    total = staged.agg(F.sum("n_tokens")).first()[0] or 0
    n_shards = max(1, -(-total // shard_ids))
    borders = np.zeros(0, np.int64)
    if n_shards > 1:
        cuts = [i / n_shards for i in range(1, n_shards)]
        found = staged.agg(F.percentile_approx("doc_id", F.lit(cuts), F.lit(100 * n_shards)).alias("cuts")).first()
        borders = np.unique(np.array(found.cuts or [], np.int64))

    def shards(keys: pa.Array) -> np.ndarray:
        return np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(borders, keys.fill_null(0).to_numpy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id, by_shard = np.zeros(0, np.int64), np.zeros(len(borders) + 1, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4")
            new = np.bincount(flat, minlength=len(by_id))
            new[: len(by_id)] += by_id
            by_id = new
            np.add.at(by_shard, shards(batch.column(0)), batch.column(1).to_numpy())
        for kind, values in (("id", by_id), ("shard", by_shard)):
            keys = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array(keys), pa.array(values[keys])], ["kind", "key", "n"])

    counted = staged.mapInArrow(count, "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    per_id = {r.key: r.n for r in counted if r.kind == "id"}
    per_shard = np.zeros(len(borders) + 2, np.int64)
    for r in counted:
        if r.kind == "shard":
            per_shard[r.key + 1] = r.n
    shard_start = np.cumsum(per_shard)
    counts = np.zeros(max(per_id, default=0) + 1, np.int64)
    counts[list(per_id)] = list(per_id.values())
    lengths = code_lengths(counts)
    codes, symbols = canonical(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in symbols], "id long, length int").coalesce(1).write.parquet(f"{path}/code")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, 1):
                n = some.column(1).to_numpy()
                ids = np.frombuffer(b"".join(some.column(2).to_pylist()), "<u4")
                data, n_bytes, at = encode(ids, n, codes, lengths)
                before, bits = np.cumsum(n) - n, (np.cumsum(n_bytes) - n_bytes) * 8
                place = np.arange(len(ids)) - np.repeat(before, n)
                marked = place % STRIDE == 0
                marks = (at - np.repeat(bits, n))[marked].astype("<i8")
                per_doc = -(-n // STRIDE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards(some.column(0)).astype(np.int32)), some.column(0), some.column(1), binary_array(per_doc * 8, marks), binary_array(n_bytes, data)],
                    ["shard", "doc_id", "n_tokens", "marks", "payload"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start, held, size = None, 0, 0, [], 0
        names = ["shard", "block", "start", "doc_ids", "doc_tokens", "marks", "payload"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

        def close() -> pa.RecordBatch:
            nonlocal number, start, held, size
            ends = np.cumsum([0] + [len(d[3]) for d in held])[:-1] * 8
            marks = np.concatenate([np.frombuffer(d[2], "<i8") + e for d, e in zip(held, ends, strict=True)])
            row = [shard, number, start, [d[0] for d in held], [d[1] for d in held], marks.astype("<i8").tobytes(), b"".join(d[3] for d in held)]
            number, start, held, size = number + 1, start + size, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for own, *doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard:
                    if held:
                        yield close()
                    shard, number, start = own, 0, int(shard_start[own])
                held.append(doc)
                size += doc[1]
                if size >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    coded = staged.mapInArrow(pack, "shard int, doc_id long, n_tokens long, marks binary, payload binary")
    ordered = coded.repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens", "payload")
    ordered.mapInArrow(blocks, "shard int, block int, start long, doc_ids array<long>, doc_tokens array<long>, marks binary, payload binary").write.parquet(f"{path}/blocks")
    forget(staged)


def _slices(batch: pa.RecordBatch, count_column: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` ids each."""
    ends, start = np.cumsum(batch.column(count_column).to_numpy()), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the folder ``path``, decoded block by block."""
    code = spark.read.parquet(f"{path}/code").collect()  # at most the vocabulary
    lengths = np.zeros(max((r.id for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r.id] = r.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for i in range(0, batch.num_rows, 16):  # runs of several blocks advance together
                start, doc_ids, doc_tokens, marks, payload = (c.to_pylist() for c in batch.slice(i, 16).columns)
                n = [np.array(t, np.int64) for t in doc_tokens]
                starts = np.concatenate([s + np.cumsum(t) - t for s, t in zip(start, n, strict=True)])
                n = np.concatenate(n)
                runs = -(-n // STRIDE)
                sizes = np.full(int(runs.sum()), STRIDE, np.int64)
                sizes[np.cumsum(runs) - 1] = n - (runs - 1) * STRIDE
                offsets = np.cumsum([0] + [len(p) for p in payload[:-1]]) * 8
                bits = np.concatenate([np.frombuffer(m, "<i8") + o for m, o in zip(marks, offsets, strict=True)])
                ids = decode(np.frombuffer(b"".join(payload), np.uint8), bits, sizes, table)
                keys = pa.array([d for some in doc_ids for d in some], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(n), binary_array(n * 4, ids.astype("<u4"))], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "doc_tokens", "marks", "payload")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a new folder beside the checkpoints and read it back."""
    path = work_folder(docs.sparkSession)
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path)
