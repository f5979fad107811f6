"""Connected components of links between long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import forget, written


def _least(edges: DataFrame) -> DataFrame:
    """For each node ``u``: the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(u, v)``: root is the least node of its component.

    The number of rounds grows with the logarithm of the longest chain. Every round is a written
    table. A node with very many neighbours meets its least neighbour through an equi-join that
    Spark's skew join can split; the minimum itself is combined before the shuffle.
    """
    edges = written(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = _both(edges)
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct())
        small = large.join(_least(large), "u")  # here v < u: the pairs point down
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        down = written(down.filter("u != v").distinct())
        forget(edges)
        forget(large)
        edges, before, state = down, state, _state(down)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
