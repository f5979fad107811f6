"""Exact top-k search among binary codes by incremental multi-index hashing.

Codes of 64 bits are cut in segments of about log2(number of codes) bits, and every distinct code
is indexed under the value of each segment. A query probes all values within radius r of its own
segments; by the pigeonhole principle that finds every code within ``segments * (r + 1) - 1``
bits. Radii grow until a query has k verified codes within the covered distance. Equal codes are
one entry with its number of rows and its smallest ids, and equal queries search once, so a vector
held by a third of all rows costs no more than any other.

Defined results: neighbours by distance, then id; a row is no neighbour of itself, its copies are;
with fewer than k other rows all are returned; null ids and null codes take no part; repeated ids
are one row each, of which a query skips one; extra columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import forget, spread_join, written

BITS = 64
TASK_PROBES = 1 << 20  # values that one task makes of its queries


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is 1 if element i of ``vector`` is above zero; missing and null elements give 0. Null for a null vector."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))
    code = bit(0).cast("long")
    for i in range(1, bits):
        code = code.bitwiseOR(bit(i).cast("long"))
    return F.when(vector.isNotNull(), code)


def segment_borders(n_codes: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    number = min(BITS, max(1, round(BITS / max(1.0, math.log2(max(2, n_codes))))))
    cuts = [BITS * i // number for i in range(number + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _value(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _index(codes: DataFrame, borders: list[tuple[int, int]]) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(i).alias("segment"), _value(F.col("code"), *b).alias("value")) for i, b in enumerate(borders)))
    return codes.select("code", "n", "least", F.explode(entries).alias("at")).select("at.*", "code", "n", "least")


def _probes(queries: DataFrame, borders: list[tuple[int, int]], radius: int) -> DataFrame:
    """``segment, value, query`` for all values within ``radius`` of each segment of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.array([sum(1 << b for b in bits) for r in range(min(radius, w) + 1) for bits in combinations(range(w), r)], np.uint64) for _, w in borders]
        for batch in batches:
            for code in batch.column(0).to_numpy():
                own = np.int64(code).view(np.uint64)
                for i, (low, width) in enumerate(borders):
                    value = own >> np.uint64(low) & np.uint64((1 << width) - 1)
                    values = (value ^ masks[i]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(np.full(len(values), code))], ["segment", "value", "query"])

    return queries.mapInArrow(run, "segment int, value long, query long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k codes of each query that come first; limited before the shuffle."""
    order = Window.partitionBy("query").orderBy("distance", "least")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def search(rows: DataFrame, queries: DataFrame, k: int, id_column: str = "id", code_column: str = "code") -> DataFrame:
    """``query_id, rank, neighbour_id, distance``: the k nearest other rows of every row of ``queries``."""
    pick = [F.col(id_column).cast("long").alias("id"), F.col(code_column).cast("long").alias("code")]
    rows = written(rows.select(*pick).dropna())
    wanted = written(queries.select(*pick).dropna())
    codes = written(rows.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    borders = segment_borders(codes.count())
    index = _index(codes, borders)
    left = written(wanted.select("code").distinct())
    n_left = left.count()
    done: list[DataFrame] = []
    for radius in range(max(w for _, w in borders) + 1):
        covered = len(borders) * (radius + 1) - 1
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        # Spark takes the probes for as few as the queries they come from and would broadcast them.
        each = sum(math.comb(w, r) for _, w in borders for r in range(min(radius, w) + 1))
        met = _probes(left.repartition(-(-max(n_left, 1) * each // TASK_PROBES), "code"), borders, radius).hint("merge").join(index, ["segment", "value"]).filter(distance <= covered)
        met = met.select("query", "code", distance.alias("distance"), "least", "n").distinct()
        best = written(_best(met, k + 1))
        # With itself, a query needs k + 1 rows within the covered distance; k + 1 codes always do.
        full = best.groupBy("query").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= k + 1).select("query")
        if covered >= BITS or radius == max(w for _, w in borders):
            done.append(best)
            break
        done.append(best.join(full, "query", "left_semi"))
        rest = written(left.join(full.withColumnRenamed("query", "code"), "code", "left_anti"))
        forget(left)
        left, n_left = rest, rest.count()
        if not n_left:
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # The smallest k + 1 ids of each code are enough; ranks are limited before the shuffle.
    few = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("_rank") <= k + 1)
    ids = few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    near = found.join(ids, "code").select("query", F.explode(F.transform("ids", lambda i: F.struct(F.col("distance"), i.alias("id")))).alias("near"))
    order = Window.partitionBy("query").orderBy("near")
    near = near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k + 1)
    lists = near.groupBy(F.col("query").alias("code")).agg(F.sort_array(F.collect_list("near")).alias("near"))
    weights = wanted.groupBy("code").agg(F.count("*").alias("weight"))
    answered = spread_join(wanted, lists.join(weights, "code"), "code", "weight", "inner")
    own = F.array_position(F.transform("near", lambda x: x["id"]), F.col("id"))
    others = F.when(own > 0, F.concat(F.slice("near", 1, own.cast("int") - 1), F.slice("near", own.cast("int") + 1, k + 1))).otherwise(F.col("near"))
    ranked = answered.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("rank", "near"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("near.id").alias("neighbour_id"), F.col("near.distance").alias("distance"))
