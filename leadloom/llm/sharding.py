"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt by a hash into source partitions. How many rows of each partition go to each shard
is drawn exactly, as for one shuffle of all rows: partition by partition from a multivariate
hypergeometric law, so that every shard gets its fixed size. Each partition permutes its rows and
hands out its first ranks to the first shard and so on; each shard permutes what it got. Only
DataFrame operations touch rows; the driver draws a matrix of partitions x shards numbers.

A shard is permuted in buckets of its random key: the first bits choose the bucket, counts per
bucket give each its first slot, and ranks inside a bucket are local. So neither a partition nor a
shard is ever one task, and sizes differ by at most one (law ``rows``).

Defined results: nulls in any column are kept; repeated rows are rows of their own, dealt as any
others (the deal depends on the seed, the rows and where they were read); an empty table gives no rows; extra columns stay, and only the
names ``shard`` and ``slot`` must be free.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import free_prefix, written

PARTITION_ROWS = 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of ``good + bad``, for any size: inversion around the mode."""
    least, most = max(0, draws - bad), min(draws, good)
    if least == most:
        return least
    total = good + bad
    mode = min(most, max(least, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(1, total - draws) / max(1, total - 1))
    reach = int(12 * spread) + 30  # beyond it less than a double can tell
    low, high = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(low, high)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)  # log p(k+1) - log p(k)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], "right"))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of partition i for shard j. Column sums differ by at most one, row sums are ``sizes``."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = np.zeros((len(sizes), shards), np.int64)
    for i, size in enumerate(sizes):
        rest, places = size, sum(room)
        for j in range(shards):
            places -= room[j]
            matrix[i, j] = hypergeometric(rng, room[j], places, rest)
            rest -= matrix[i, j]
        room = [a - int(b) for a, b in zip(room, matrix[i], strict=True)]
    return matrix


def uniform_shards(rows: DataFrame, shards: int = 8, seed: int = 0, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``rows`` are written once, so that counting and dealing see the same. Counts read the two
    hashes of the rows only; whole rows are shuffled twice, to their partition and to their shard.
    """
    p = free_prefix(rows)
    local_, order, part, borders_, rank, bucket, first_, n = (f"{p}{c}" for c in ("local", "order", "part", "borders", "rank", "bucket", "first", "n"))
    # Where a row was read is part of its hashes, so that wholly equal rows are dealt as others are.
    number = f"{p}read_at"
    numbered = rows.withColumn(number, F.monotonically_increasing_id())
    key = lambda salt: F.xxhash64(F.lit(f"{seed} {salt}"), *numbered.columns, *(F.col(c).isNull() for c in rows.columns))
    base = written(numbered.select(*rows.columns, key("local").alias(local_), key("shard").alias(order)))
    total = base.count()
    partitions = max(1, -(-total // partition_rows))
    base = base.withColumn(part, F.pmod(F.col(local_), F.lit(partitions)).cast("int"))
    sizes = {r[part]: r["count"] for r in base.groupBy(part).count().collect()}
    matrix = communication_matrix([sizes.get(i, 0) for i in range(partitions)], shards, seed)
    borders = rows.sparkSession.createDataFrame([(i, np.cumsum(m).tolist()) for i, m in enumerate(matrix)], f"{part} int, {borders_} array<long>")

    # Rows that agree in both hashes (128 bits) are taken as wholly equal, so interchangeable.
    local = Window.partitionBy(part).orderBy(local_, order)
    ranked = base.withColumn(rank, F.row_number().over(local) - 1).join(borders, part)
    shard = F.size(F.filter(borders_, lambda b: b <= F.col(rank))).cast("int")
    dealt = ranked.select(*rows.columns, local_, order, shard.alias("shard"))

    buckets = 1 << max(0, (partitions // shards).bit_length())
    dealt = dealt.withColumn(bucket, F.shiftrightunsigned(order, 64 - int(math.log2(buckets))) if buckets > 1 else F.lit(0).cast("long"))
    counts = dealt.groupBy("shard", bucket).agg(F.count("*").alias(n))
    first = counts.select("shard", bucket, (F.sum(n).over(Window.partitionBy("shard").orderBy(bucket)) - F.col(n)).alias(first_))
    inner = Window.partitionBy("shard", bucket).orderBy(order, local_)
    slots = dealt.withColumn(rank, F.row_number().over(inner) - 1).join(first, ["shard", bucket])
    return slots.select(*rows.columns, "shard", (F.col(first_) + F.col(rank)).alias("slot"))
