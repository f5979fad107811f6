"""Greedy two-key deduplication of leads as rounds of aggregations and joins.

The rule is sequential: in order, a lead is kept unless its name or its site was already
seen on a kept lead; dropped leads leave no trace. On the graph whose edges are leads and
whose nodes are names and sites that is the greedy maximal matching, which can be computed
in rounds: an undecided lead that comes first in both of its groups is certainly kept, and
everything that shares a key with it is certainly dropped.

A lead may also have a ``seen_as`` name, which it does not claim but which drops it if a lead kept
in an earlier step of the order (an earlier location) has that name. Such a lead is certain only
once no undecided lead of an earlier step could still claim the name.

Rounds alone would need half as many as the longest chain of leads that alternately share names
and sites. They stop when the undecided leads are few enough to be walked in one task; else, after
some rounds, the rest falls into connected components (leads that share a name or site, directly
or through others, and so can have a say in each other's fate), and every component of bounded
size is walked in order inside a task. Rounds go on for larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import name_key
from leadloom.functions.urls import site_key
from leadloom.operators.components import component_of
from leadloom.operators.joins import Pieces, cut_lineage, filled

EDGE = ("at", "name", "site", "seen_as")
LOCAL_ROWS = 200_000  # leads that one task walks: the whole rest, or one component
ROUNDS = 4  # before the rest is first split into components


def _best_per(edges: DataFrame, node: str) -> DataFrame:
    """First edge of every node: one row per node, combined before the shuffle."""
    return (
        edges.filter(F.col(node).isNotNull())
        .groupBy(node)
        .agg(F.min(F.struct("at", *[c for c in EDGE[1:] if c != node])).alias("best"))
        .select(node, "best.*")
        .select(*EDGE)
    )


def _unseen(edges: DataFrame, claims: DataFrame, step: str) -> DataFrame:
    """Edges whose ``seen_as`` no claim (one per name) of an earlier step holds."""
    claims = claims.filter(F.col("name").isNotNull()).select(F.col("name").alias("_key"), F.col(f"at.{step}").alias("_since"))
    spread = edges.withColumn("_key", filled(F.col("seen_as"), "at"))
    before = F.coalesce(F.col("_since") < F.col(f"at.{step}"), F.lit(False))
    return spread.join(claims, "_key", "left").filter(~before).select(*EDGE)


def _certain(edges: DataFrame, step: str | None) -> DataFrame:
    """Edges that come first in each group they belong to."""
    by_name, by_site = _best_per(edges, "name"), _best_per(edges, "site")
    both = by_name.filter(F.col("site").isNotNull()).join(by_site.filter(F.col("name").isNotNull()).select("at"), "at", "left_semi")
    first = by_name.filter(F.col("site").isNull()).unionByName(by_site.filter(F.col("name").isNull())).unionByName(both)
    if step is None:
        return first
    return _unseen(first.unionByName(edges.filter(F.col("name").isNull() & F.col("site").isNull())), by_name, step)


def _walk(edges: DataFrame, step: str | None) -> DataFrame:
    """The kept edges of ``edges(component, ...)``, whose partitions hold whole components, in the plain sequential way."""
    own = F.lit(0) if step is None else F.col(f"at.{step}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, names, sites = object(), {}, set()  # names with the step that claimed them
        for batch in batches:
            stays = []
            for its, at_step, name, site, seen_as in zip(*(batch.column(c).to_pylist() for c in ("component", "step", "name", "site", "seen_as")), strict=True):
                if its != component:
                    component, names, sites = its, {}, set()
                taken = name in names or site in sites or (seen_as in names and names[seen_as] < at_step)
                stays.append(not taken)
                if not taken:
                    if name is not None:
                        names[name] = at_step
                    if site is not None:
                        sites.add(site)
            yield batch.filter(pa.array(stays, pa.bool_())).select(list(EDGE))

    schema = edges.select(*EDGE).schema
    return edges.withColumn("step", own).sortWithinPartitions("component", "at").mapInArrow(run, schema)


def with_component(rows: DataFrame, *keys: Column) -> DataFrame:
    """``rows`` with ``component``: rows that share a key (the same column of ``keys`` or not), also through others, get the same one.

    Keys are told apart by 64-bit hashes; two that collide only make a component larger. A row without keys is one of its own.
    """
    hashes = F.array_compact(F.array(*[F.when(k.isNotNull(), F.xxhash64(k)) for k in keys]))
    hashed = rows.withColumn("_nodes", hashes).withColumn("_node", F.try_element_at("_nodes", F.lit(1)))
    links = hashed.select(F.col("_node").alias("a"), F.explode(F.slice("_nodes", 2, len(keys))).alias("b")) if len(keys) > 1 else hashed.select("_node", F.col("_node")).toDF("a", "b")
    labels = component_of(links).withColumnRenamed("node", "_node")
    return hashed.join(labels, "_node", "left").withColumn("component", F.coalesce("component", "_node", F.xxhash64(*rows.columns))).drop("_node", "_nodes")


def _by_components(edges: DataFrame, step: str | None, local_rows: int) -> tuple[DataFrame, DataFrame]:
    """(kept edges of the components of bounded size, all edges of the larger ones)."""
    tagged = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(kind), c))
    labelled = cut_lineage(with_component(edges, tagged("n", "name"), tagged("s", "site"), tagged("n", "seen_as")))
    large = labelled.groupBy("component").count().filter(F.col("count") > local_rows).select("component")
    small = labelled.join(large, "component", "left_anti")
    return _walk(small.repartition("component"), step), labelled.join(large, "component", "left_semi").select(*EDGE)


def kept_positions(
    leads: DataFrame,
    order: list[str],
    name: Column | None = None,
    site: Column | None = None,
    seen_as: Column | None = None,
    local_rows: int = LOCAL_ROWS,
    component_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """The order columns of the kept leads. ``order`` must identify a lead; its first column is the step.

    Leads that agree in all keys can only be kept once, so they are merged to their first
    before the rounds start; leads without any key are always kept.
    """
    name = name_key(F.col("business_name")) if name is None else name
    site = site_key(F.col("website")) if site is None else site
    step = None if seen_as is None else order[0]
    looked_up = F.lit(None).cast("string") if seen_as is None else F.when(~seen_as.eqNullSafe(name), seen_as)
    keyed = leads.select(F.struct(*order).alias("at"), name.alias("name"), site.alias("site"), looked_up.alias("seen_as"))
    blank = F.col("name").isNull() & F.col("site").isNull() & F.col("seen_as").isNull()
    edges = cut_lineage(keyed.filter(~blank).groupBy(*EDGE[1:]).agg(F.min("at").alias("at")).select(*EDGE))
    kept, rounds, split = Pieces(keyed.limit(0)), 0, ROUNDS
    while left := edges.count():
        if left <= local_rows:
            kept.add(_walk(edges.withColumn("component", F.lit(0)).coalesce(1), step))
            break
        if rounds == split:
            walked, larger = _by_components(edges, step, component_rows)
            kept.add(walked)
            edges, split = cut_lineage(larger), 2 * split
            continue
        rounds += 1
        certain = kept.add(_certain(edges, step))
        # Certain edges themselves hold a taken key, or, without name and site, are taken by position.
        rest = edges.join(certain.filter(F.col("name").isNull() & F.col("site").isNull()).select("at"), "at", "left_anti") if step else edges
        for node in ("name", "site"):
            taken = certain.filter(F.col(node).isNotNull()).select(F.col(node).alias("_key"))
            rest = rest.withColumn("_key", filled(F.col(node), "at")).join(taken, "_key", "left_anti").drop("_key")
        edges = cut_lineage(rest if step is None else _unseen(rest, certain, step))
    return keyed.filter(blank).unionByName(kept.rows()).select("at.*")


def dedup_leads(leads: DataFrame, order: list[str], **options) -> DataFrame:
    """The kept leads, all columns, in no particular order."""
    return leads.join(kept_positions(leads, order, **options), order, "left_semi")
