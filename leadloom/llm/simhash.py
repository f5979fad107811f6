"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code: the product of two perfect binary Golay codes of
length 23 on the lowest 46 of the 64 bits. Each block has covering radius 3, so every fingerprint
has exactly one anchor within 3 bits in each block, its home. If two fingerprints differ in at
most T bits, the second lies within 3 + e1 and 3 + e2 bits of the first one's home, e1 + e2 <= T:
copies of every fingerprint go to all anchors within covering radius plus threshold, and each
anchor compares the fingerprints at home there with the copies on all 64 bits. For T = 3 that is
about 300 copies of each *distinct* fingerprint, over 2**24 anchors, and no pair is missed.

Equal fingerprints are grouped before that. Within one anchor (and one part of an anchor with many
at home) links are reduced to a spanning forest as they are found, so a group of near copies gives
about as many links as members, not pairs.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other;
repeated rows and ties get equal results; null doc_ids take part but never name a group that has
another; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import forget, spread_join, written
from leadloom.llm.components import components

SEED = 42
GOLAY = 0b110001110101  # generator polynomial of the perfect Golay code, degree 11
BITS, RADIUS = 23, 3
MAX_DISTANCE = 3
AT_HOME = 4096  # fingerprints at home in one part of an anchor
TASK_FINGERPRINTS = 4096  # that one task copies to their anchors


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only [\x20\x09-\x0D] separate
    if not words:
        return 0
    if len(words) <= shingle:
        joined, starts, ends = b" ".join(words), [0], [None]
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stop = np.cumsum(sizes)
        starts, ends = (stop - sizes)[: 1 - shingle or None].tolist(), (stop - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(starts)
    for i in range(0, total, 1 << 16):
        part = zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(BITS - 1, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0)
    return rest


@lru_cache(maxsize=1)
def coset_errors() -> tuple[list[np.ndarray], np.ndarray]:
    """By syndrome: all errors of weight up to ``RADIUS + MAX_DISTANCE`` in order of weight; and how many have each excess over the radius."""
    words = np.arange(1 << BITS, dtype=np.int64)
    weight = np.bitwise_count(words)
    words = words[weight <= RADIUS + MAX_DISTANCE]
    weight, of = np.bitwise_count(words).astype(np.int64), syndrome(words)
    order = np.lexsort((weight, of))
    words, weight, of = words[order], weight[order], of[order]
    borders = np.searchsorted(of, np.arange((1 << 11) + 1))
    errors = [words[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
    excess = np.maximum(weight - RADIUS, 0)
    counts = np.zeros((1 << 11, MAX_DISTANCE + 1), np.int64)
    np.add.at(counts, (of, excess), 1)
    return errors, counts


def anchors(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``fps``, anchor, is it the home) for all anchors within covering radius plus ``distance``."""
    errors, counts = coset_errors()
    mask = (1 << BITS) - 1
    low, high = fps & mask, fps >> BITS & mask
    s_low, s_high = syndrome(low), syndrome(high)
    index, anchor, home = [], [], []
    # Syndromes whose errors have the same numbers by excess share the shape of their copies.
    kinds, kind = np.unique(counts, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    for k_low in range(len(kinds)):
        for k_high in range(len(kinds)):
            rows = np.flatnonzero((kind[s_low] == k_low) & (kind[s_high] == k_high))
            if not len(rows):
                continue
            e_low = np.repeat(np.arange(MAX_DISTANCE + 1), kinds[k_low])
            e_high = np.repeat(np.arange(MAX_DISTANCE + 1), kinds[k_high])
            i, j = np.nonzero(e_low[:, None] + e_high[None, :] <= distance)
            err_low = np.stack([errors[s] for s in s_low[rows]])[:, i]
            err_high = np.stack([errors[s] for s in s_high[rows]])[:, j]
            found = (low[rows, None] ^ err_low) | (high[rows, None] ^ err_high) << BITS
            index.append(np.repeat(rows, len(i)))
            anchor.append(found.ravel())
            home.append(np.tile(e_low[i] + e_high[j] == 0, len(rows)))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def copies(distinct: DataFrame, distance: int) -> DataFrame:
    """``anchor, guest, fp``: guest 0 is the fingerprint at home, guest 1 a copy from elsewhere (or the same one's)."""
    if distance > MAX_DISTANCE:
        raise ValueError(f"the covering is built for up to {MAX_DISTANCE} bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i in range(0, len(fps), 1024):
                some = fps[i : i + 1024]
                index, anchor, home = anchors(some, distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.where(home, 0, 1).astype(np.int32)), pa.array(some[index])], ["anchor", "guest", "fp"])

    return distinct.mapInArrow(run, "anchor long, guest int, fp long")


def _compare(distance: int):
    """Links within sorted (anchor, part, guest) groups: those at home are held (a bounded number), guests stream by."""

    def links(home: np.ndarray, guests: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
        found = []
        for i in range(0, len(guests), 1024):
            some = guests[i : i + 1024]
            near = np.bitwise_count((home[:, None] ^ some[None, :]).view(np.uint64)) <= distance
            near &= home[:, None] != some[None, :]
            for g in np.flatnonzero(near.any(0)):
                met = np.flatnonzero(near[:, g])
                first = int(met[0])
                found.append((int(home[first]), int(some[g])))
                for roots in np.unique(root[met]):  # guests tie together what is at home
                    if roots != root[first]:
                        found.append((int(home[first]), int(home[int(met[root[met] == roots][0])])))
                        root[root == roots] = root[first]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, home, root = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            anchor, part, guest, fp = (batch.column(i).to_numpy() for i in range(4))
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            found = []
            for a, b in zip([0, *new], [*new, len(anchor)], strict=True):
                if a == b:
                    continue
                if (key := (anchor[a], part[a])) != group:
                    group, home, root = key, np.zeros(0, np.int64), np.zeros(0, np.int64)
                at = a + int(np.searchsorted(guest[a:b], 1))
                if at > a:
                    own = np.concatenate([home, fp[a:at]])
                    root = np.concatenate([root, np.arange(len(home), len(own))])
                    found += links(own, fp[a:at], root) if len(own) > 1 else []
                    home = own
                if len(home) and b > at:
                    found += links(home, fp[at:b], root)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    return run


def near_links(distinct: DataFrame, distance: int) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints that connect all within ``distance`` bits of each other.

    An anchor with more than ``AT_HOME`` at home is split in parts: the home rows are dealt over
    them and each copy goes to all. ``distinct`` must be a written table.
    """
    tasks = -(-max(distinct.count(), 1) // TASK_FINGERPRINTS)  # each makes some hundred copies of its fingerprints
    spread = copies(distinct.repartition(tasks, "fp"), distance)
    own = copies(distinct, 0)  # the homes alone
    full = own.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(AT_HOME)).cast("int").alias("parts")).filter("parts > 1")
    if full.limit(1).count():  # not every input has such an anchor; their number grows with the input, so Spark chooses the join
        spread = spread.join(written(full), "anchor", "left")
        parts = F.coalesce("parts", F.lit(1))
        at = F.when(F.col("guest") == 0, F.array(F.pmod(F.xxhash64("fp"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
        # What is at home in one part is a guest of the others.
        others = spread.filter("guest = 0 and parts > 1").withColumn("guest", F.lit(1))
        spread = spread.unionByName(others).withColumn("part", F.explode(at)).select("anchor", "part", "guest", "fp")
    else:
        spread = spread.select("anchor", F.lit(0).alias("part"), "guest", "fp")
    sorted_ = spread.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "guest", "fp")
    return sorted_.mapInArrow(_compare(distance), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = MAX_DISTANCE, **columns: str) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: component_id is the smallest doc_id reachable over links."""
    marked = written(fingerprints(docs, shingle, **columns))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    rooted = components(near_links(distinct.select("fp"), distance))
    grouped = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = written(grouped.join(least, "root").select("fp", "component_id", "rows"))
    return spread_join(marked, per_fp, "fp", "rows", "inner").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    """Signed long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
