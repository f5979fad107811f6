"""Connected components of a graph given as links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.joins import cut_lineage


def _to_least(links: DataFrame, upwards: bool) -> DataFrame:
    """Every node tells the least node it knows to its larger neighbours (``upwards``) or to its smaller ones and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if upwards else links
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    met = both.join(least, "a")
    told = met.filter("b > a").select("b", "least") if upwards else met.select("b", "least").unionByName(least.select(F.col("a").alias("b"), "least"))
    return told.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def component_of(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node of the component) for the nodes of ``links(a, b)``.

    The number of rounds grows with the logarithm of the longest path; each is checkpointed.
    Groups are minima, combined before the shuffle; a node with very many neighbours meets one row.
    """
    links = cut_lineage(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
        links = cut_lineage(_to_least(cut_lineage(_to_least(links, upwards=True)), upwards=False))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
