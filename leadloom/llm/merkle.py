"""A Merkle tree per group of rows, their roots under one root, and proofs of all rows by octopus multiproofs.

Leaves ascend within their group; while several nodes remain, every two neighbours (a last one
alone) become the hash of their hex texts. The subroots of the groups, null group first, become
the root in the same way. A node is named by (tree, level, index).

Positions come from one range-partitioned sort of the narrow leaf rows: tasks number their rows,
and the counts per task give each its offset. Trees are built in rounds of ``BITS`` levels, a
block of ``2**BITS`` nodes at a time, so a group of any size spreads over many tasks and a round
leaves one node in ``2**BITS``. Nodes are kept as one packed row per (tree, level, block).

Proofs: the leaves asked for in one block are a leaf partition. It works out which nodes its own
leaves can't give (the octopus algorithm: climb from the asked positions; a neighbour that exists
and is not among them is missing, all parents go on), asks for the union of them once, derives the
interior nodes that its leaves share, and reads every single proof off them. For a whole block
only the path above the block is fetched; for a few rows only they and their fetched nodes move.

Defined results: null ids come first in their group, rows with equal ids go by their leaf, wholly
equal rows are leaves of their own; a group of one row has its leaf as subroot; a lone group's
subroot is the root; extra columns that are not named as fields are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from leadloom.llm.common import written

BITS = 12
ABOVE = 64  # levels of the tree over the subroots are numbered from here
_TOP = ""  # name of that tree; groups are "0" (null) and "1" + their name


def h(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """Hash of fields as ``-`` for null, else their length in bytes, a colon and their text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tree_of(group: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


@dataclass(frozen=True)
class Manifest:
    leaves: DataFrame  # tree, index, n (leaves of the tree), leaf and what the rows carry
    nodes: DataFrame  # tree, level, block, n (nodes of the level), hashes; the tree over the subroots included
    groups: DataFrame  # tree, subroot, place and number among the subroots, root
    bits: int


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (their first column is ``tree``) with ``index``, from 0 within each tree by ``order``, and ``n``, the rows of the tree."""
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("k", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, k = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for own in batch.column(0).to_pylist():
                tree, k = own, k + 1 if own == tree else 0
                places.append(k)
            columns = [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    # Wholly equal rows are told apart by where they were read, so that a range can hold a part of them.
    apart = rows.withColumn("read_at", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "read_at")]
    placed = written(apart.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*rows.columns).mapInArrow(run, schema))
    # As many rows as tasks and trees, at most.
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    first = counts.select("tree", "part", (F.sum("rows").over(tree.orderBy("part")) - F.col("rows")).alias("first"), F.sum("rows").over(tree).alias("n"))
    return placed.join(first, ["tree", "part"]).withColumn("index", F.col("first") + F.col("k")).drop("part", "k", "first")


def _block_levels(nodes: list[str], n: int, level: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, nodes of the level in the tree, packed hashes) of a block up to its own top or the tree's."""
    for up in range(bits + 1):
        yield level + up, n, bytes.fromhex("".join(nodes))
        if n == 1 or up == bits:
            return
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        n = (n + 1) >> 1


def _round(nodes: DataFrame, level: int, bits: int) -> DataFrame:
    """``tree, level, block, n, hashes`` of the ``bits`` levels from ``level`` on; the next round's nodes come as a level of one-node rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, number = None, [], 0

        def close() -> pa.RecordBatch:
            (tree, block), rows = key, list(_block_levels(held, number, level, bits))
            # A level's share of this block begins at index block * (its width there), so its number stays.
            columns = [[tree] * len(rows), [r[0] for r in rows], [block] * len(rows), [r[1] for r in rows], [r[2] for r in rows]]
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["tree", "level", "block", "n", "hashes"])

        for batch in batches:
            for tree, block, n, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, block) != key:
                    if held:
                        yield close()
                    key, held, number = (tree, block), [], n
                held.append(node)
        if held:
            yield close()

    block = F.shiftright("index", bits)
    dealt = nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    return dealt.select("tree", "block", "n", "node").mapInArrow(run, "tree string, level int, block long, n long, hashes binary")


def _levels(nodes: DataFrame, bits: int) -> DataFrame:
    """All levels over ``nodes(tree, index, n, node)``."""
    level, done = 0, []
    while True:
        built = written(_round(nodes, level, bits))
        top = F.col("level") == level + bits
        done.append(built.filter(~top))
        following = built.filter(top)
        if following.isEmpty():
            return reduce(DataFrame.unionByName, done)
        level += bits
        nodes = following.select("tree", F.col("block").alias("index"), "n", F.lower(F.hex("hashes")).alias("node"))


def build(rows: DataFrame, group: Column, order: list[Column], leaf: Column, bits: int = BITS, **carried: Column) -> Manifest:
    """The manifest of ``rows``; ``carried`` columns stay beside the leaves."""
    names = [f"by{i}" for i in range(len(order))]
    narrow = rows.select(tree_of(group).alias("tree"), *[o.alias(n) for n, o in zip(names, order, strict=True)], leaf.alias("leaf"), *[c.alias(n) for n, c in carried.items()])
    # Texts are hashed once; what is sorted is narrow.
    leaves = written(_numbered(written(narrow), *names, "leaf").drop(*names))
    nodes = _levels(leaves.select("tree", "index", "n", F.col("leaf").alias("node")), bits)
    subroots = nodes.filter("n = 1").select("tree", F.lower(F.hex("hashes")).alias("subroot"))
    # One row per group.
    everything = Window.partitionBy(F.lit(0))
    ranked = subroots.select("tree", "subroot", (F.row_number().over(everything.orderBy("tree")) - 1).cast("long").alias("place"), F.count("*").over(everything).alias("groups"))
    ranked = written(ranked)
    above = _levels(ranked.select(F.lit(_TOP).alias("tree"), F.col("place").alias("index"), F.col("groups").alias("n"), F.col("subroot").alias("node")), bits)
    root = above.filter("n = 1").select(F.lower(F.hex("hashes"))).first()  # one hash, none for an empty table
    return Manifest(leaves, nodes.unionByName(above), ranked.withColumn("root", F.lit(root[0] if root else None).cast("string")), bits)


def missing(positions: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that proofs of ``positions`` need and that their own leaves can't give."""
    found, level, own = [], 0, np.unique(positions)
    while n > 1:
        beside = own ^ 1
        absent = beside[(beside < n) & ~np.isin(beside, own)]
        found += [(level, int(i)) for i in absent]
        own, n, level = np.unique(own >> 1), (n + 1) >> 1, level + 1
    return found


def _asked(wanted: DataFrame) -> DataFrame:
    """``tree, part, node_tree, level, index``: each leaf partition's union of missing nodes, those above its subroot included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, part, n, place, groups, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(tree, part, tree, level, i) for level, i in missing(np.array(positions, np.int64), n)]
                rows += [(tree, part, _TOP, level, i) for level, i in missing(np.array([place], np.int64), groups)]
            if rows:
                types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "part", "node_tree", "level", "index"])

    partitions = wanted.groupBy("tree", "part").agg(
        F.first("n").alias("n"), F.first("place").alias("place"), F.first("groups").alias("groups"), F.collect_list("index").alias("positions")
    )
    return partitions.mapInArrow(run, "tree string, part long, node_tree string, level int, index long")


def _fetched(asked: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """``tree, part, level, index, node``: one lookup for all that was asked."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), bits - F.col("level") % bits)
    keyed = asked.select("tree", "part", "level", "index", F.col("node_tree"), F.call_function("div", F.col("index"), width).alias("block"), (F.col("index") % width).cast("int").alias("at"))
    packed = nodes.select(F.col("tree").alias("node_tree"), "level", "block", "hashes")
    node = F.lower(F.hex(F.substring("hashes", F.col("at") * 32 + 1, F.lit(32))))
    level = F.col("level") + F.when(F.col("node_tree") == _TOP, F.lit(ABOVE)).otherwise(F.lit(0))
    return keyed.join(packed, ["node_tree", "level", "block"]).select("tree", "part", level.cast("int").alias("level"), "index", node.alias("node"))


def _expanded(own: list[tuple[int, str]], n: int, place: int, groups: int, fetched: dict[tuple[int, int], str]) -> tuple[dict[tuple[int, int], str], list[tuple[int, int]]]:
    """All nodes on the paths of ``own`` (index, leaf) and beside them, and (level, nodes of the level) from the leaves to the root."""
    known, levels, start = dict(fetched), [], 0
    here = dict(own)
    for total, base in ((n, 0), (groups, ABOVE)):
        level = base
        if base:  # what remained of the tree stands among the subroots
            here = {place: next(iter(here.values()))}
        while total > 1:
            known.update({(level, i): node for i, node in here.items()})
            levels.append((level, total))
            parents = {}
            for i in {i >> 1 for i in here}:
                inputs = [known[level, 2 * i]]
                if 2 * i + 1 < total:
                    inputs.append(known[level, 2 * i + 1])
                parents[i] = h(*inputs)
            here, total, level = parents, (total + 1) >> 1, level + 1
        if not base:
            known["subroot"] = next(iter(here.values()))
    known["root"] = next(iter(here.values()))
    return known, levels


def _siblings(index: int, place: int, levels: list[tuple[int, int]], known: dict) -> list[tuple[bool, str | None]]:
    """(the sibling stands left, its hash or None) for every level of a leaf's path."""
    path, at, above = [], index, False
    for level, total in levels:
        if level >= ABOVE and not above:
            at, above = place, True
        path.append((at & 1 == 1, known[level, at ^ 1] if at ^ 1 < total else None))
        at >>= 1
    return path


def folded(leaf: str, path: list[tuple[bool, str | None]]) -> str:
    for left, sibling in path:
        leaf = h(leaf) if sibling is None else h(sibling, leaf) if left else h(leaf, sibling)
    return leaf


def proofs(manifest: Manifest, wanted: DataFrame | None = None, claimed: str = "claimed", carried: str = "doc_id") -> DataFrame:
    """``carried, leaf, subroot, root, proof_sha256, folded_root, verified`` for rows of ``manifest.leaves``, by default all.

    ``folded_root`` follows from the leaf that the row claims and the manifest's siblings;
    ``verified`` tells whether it is the root. A leaf partition of the manifest whose own leaves
    and fetched nodes do not give the root raises an error.
    """
    wanted = manifest.leaves if wanted is None else wanted
    rows = wanted.join(manifest.groups.select("tree", "place", "groups", "root"), "tree").withColumn("part", F.shiftright("index", manifest.bits))
    rows = rows.select("tree", "part", "n", "place", "groups", "index", "leaf", F.col(claimed).alias("claimed"), "root", F.col(carried).alias("doc_id"))
    fetched = _fetched(_asked(rows), manifest.nodes, manifest.bits)

    def expand(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
        given = {(level, i): node for level, i, node in zip(*(nodes.column(c).to_pylist() for c in ("level", "index", "node")), strict=True)}
        n, place, groups = (leaves.column(c)[0].as_py() for c in ("n", "place", "groups"))
        index, leaf, claim, root = (leaves.column(c).to_pylist() for c in ("index", "leaf", "claimed", "root"))
        known, levels = _expanded(list(zip(index, leaf, strict=True)), n, place, groups, given)
        if known["root"] != root[0]:
            raise ValueError(f"leaves {min(index)} to {max(index)} and the manifest's nodes give another root")
        digests, roots = [], []
        for i, c in zip(index, claim, strict=True):
            path = _siblings(i, place, levels, known)
            digests.append(h(*(s for _, s in path if s is not None)))
            roots.append(folded(c, path))
        columns = [leaves.column("doc_id"), leaf, [known["subroot"]] * len(leaf), root, digests, roots, [a == b for a, b in zip(roots, root, strict=True)]]
        return pa.table({n: c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    kind = rows.schema["doc_id"].dataType
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    if kind.simpleString() != "bigint":
        raise ValueError("the carried column must be a long")
    result = rows.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(
        expand, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return result.withColumnRenamed("doc_id", carried)
