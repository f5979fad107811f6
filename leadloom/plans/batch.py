"""The batch job: listings in; accepted, rejected, counters, summary and ledger rows out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from leadloom.functions.patterns import CONTACT_PAGES
from leadloom.functions.text import name_key
from leadloom.functions.urls import site_key
from leadloom.operators.dedup import LOCAL_ROWS, dedup_leads, with_component
from leadloom.operators.joins import cut_lineage, filled
from leadloom.operators.ledger import growth, normalized
from leadloom.operators.listings import collect_listings
from leadloom.operators.records import company_records
from leadloom.operators.routing import DEFAULT_COLUMNS, SCRAPED_FIELDS, enrich, route
from leadloom.operators.summary import dropped_as_known, location_counters, run_summary

# A remembered scrape: the site, the website whose page was read, and what it gave.
SCRAPES_SCHEMA = ", ".join(f"{c} string" for c in ("site", "record_website", *SCRAPED_FIELDS))
_ORDER = ["location_ord", "is_fresh", "card_ord"]


@dataclass(frozen=True)
class BatchResult:
    routed: DataFrame  # field values with reject_reason
    counters: DataFrame
    summary: DataFrame
    ledger: DataFrame  # rows to add
    scrapes: DataFrame | None = None  # rows to add, if the run was given a memory of scrapes


def mark_reused(leads: DataFrame, scraped: DataFrame) -> DataFrame:
    """Leads whose site was scraped before come first and use that scrape.

    ``scraped``: (site, record_website[, first_at]), one row per site; with ``first_at`` it serves
    the locations after that one. Adds ``is_fresh`` (0 for reuse) and the website whose record applies.
    """
    keyed = leads.withColumn("_site", filled(site_key(F.col("website")), *leads.columns))
    joined = keyed.join(scraped.withColumnRenamed("site", "_site"), "_site", "left")
    served = F.col("record_website").isNotNull()
    if "first_at" in scraped.columns:
        served &= F.coalesce(F.col("first_at") < F.col("location_ord"), F.lit(False))
    return joined.select(
        *leads.columns,
        F.when(served, 0).otherwise(1).alias("is_fresh"),
        F.when(served, F.col("record_website")).otherwise(F.col("website")).alias("record_website"),
    )


def _first_scrapes(leads: DataFrame) -> DataFrame:
    """The location that scrapes a site first; of several spellings there the last one is remembered."""
    at = F.struct(F.col("location_ord").alias("location_ord"), (-F.col("card_ord")).alias("from_last"))
    return (
        leads.withColumn("site", site_key(F.col("website")))
        .filter(F.col("site").isNotNull())
        .groupBy("site")
        .agg(F.min_by("website", at).alias("record_website"), F.min("location_ord").alias("first_at"))
    )


def _remembered(leads: DataFrame, memory: DataFrame | None) -> DataFrame:
    """``leads`` with ``memory``: what an earlier run scraped from their site, else null."""
    fields = ("record_website", *SCRAPED_FIELDS)
    if memory is None:
        return leads.withColumn("memory", F.lit(None).cast("struct<" + ",".join(f"{c}:string" for c in fields) + ">"))
    keyed = leads.withColumn("_site", filled(site_key(F.col("website")), *leads.columns))
    known = memory.select(F.col("site").alias("_site"), F.struct(*fields).alias("memory"))
    return keyed.join(known, "_site", "left").select(*leads.columns, "memory")


def _guessed(leads: DataFrame, scraped: DataFrame | None) -> DataFrame:
    """``is_fresh`` and ``record_website`` by a guess of the scrapes of earlier locations; a remembered scrape goes before."""
    own = leads.drop("is_fresh", "record_website")
    if scraped is None:
        marked = own.withColumn("is_fresh", F.lit(1)).withColumn("record_website", F.col("website"))
    else:
        marked = mark_reused(own, scraped)
    return marked.withColumns({
        "is_fresh": F.when(F.col("memory").isNotNull(), 0).otherwise(F.col("is_fresh")),
        "record_website": F.coalesce("memory.record_website", "record_website"),
    })


def _walk_locations(leads: DataFrame) -> DataFrame:
    """The kept leads with ``is_fresh`` and ``record_website``, location by location.

    Partitions of ``leads(component, ...)`` hold whole components. A task holds one location of one.
    """
    keys = {"name": name_key(F.col("business_name")), "card": name_key(F.col("card_name")), "site": site_key(F.col("website"))}
    given = {f"_{k}": c for k, c in {**keys, "component": F.col("component"), "recalled": F.col("memory.record_website")}.items()}
    rows = leads.withColumns(given).drop("component", "is_fresh", "record_website")
    kept_columns = [c for c in rows.columns if c not in given]
    read = ["_component", "location_ord", "card_ord", "website", "_recalled", "_name", "_card", "_site"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, names, sites, scraped = object(), set(), set(), {}
        place, here = None, []  # rows of a location: its keys, and where it stands

        def decided() -> Iterator[tuple[tuple[int, int], int, str]]:
            new = [r for r in here if r[5] not in names and r[6] not in names and r[7] not in sites]
            # Of a site that was scraped before: the website whose scrape is used.
            reused = [(r[4] or scraped.get(r[7]), r) for r in new]
            own_names, own_sites = set(), set()
            for used, (_, _, _, website, _, name, _, site, at) in sorted(reused, key=lambda x: (x[0] is None, x[1][2])):
                if name in own_names or site in own_sites:
                    continue
                own_names.update(() if name is None else (name,))
                own_sites.update(() if site is None else (site,))
                yield at, int(used is None), used or website
            names.update(own_names)
            sites.update(own_sites)
            # Of several spellings in one location the last one is remembered.
            scraped.update({r[7]: r[3] for used, r in sorted(reused, key=lambda x: x[1][2]) if used is None and r[7] is not None})

        held: dict[int, pa.RecordBatch] = {}

        def taken(kept: list[tuple[tuple[int, int], int, str]]) -> Iterator[pa.RecordBatch]:
            for number in sorted({at[0] for at, _, _ in kept}):
                own = [(at[1], fresh, website) for at, fresh, website in kept if at[0] == number]
                index, fresh, website = (list(c) for c in zip(*own, strict=True))
                part = held[number].select(kept_columns).take(pa.array(index))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fresh, pa.int32()), pa.array(website, pa.string())], names=[*kept_columns, "is_fresh", "record_website"])

        for number, batch in enumerate(batches):
            held[number], kept = batch, []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in read), strict=True)):
                if row[:2] != place:
                    kept += decided()
                    if row[0] != component:
                        component, names, sites, scraped = row[0], set(), set(), {}
                    place, here = row[:2], []
                here.append((*row, (number, i)))
            yield from taken(kept)
            held = {n: b for n, b in held.items() if n >= here[0][-1][0]} if here else {}
        yield from taken(list(decided()))

    schema = StructType([*(rows.schema[c] for c in kept_columns), StructField("is_fresh", IntegerType()), StructField("record_website", StringType())])
    return rows.sortWithinPartitions("_component", "location_ord", "card_ord").mapInArrow(run, schema)


def _kept_by_guess(leads: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(leads kept under their guess, all leads under the guess that follows, the old one as ``was``)."""
    kept = cut_lineage(dedup_leads(leads, _ORDER, seen_as=name_key(F.col("card_name")), **options))
    scraped = _first_scrapes(dropped_as_known(leads, kept).filter(~F.col("known") & F.col("memory").isNull()))
    guess = F.struct("is_fresh", "record_website")
    return kept, cut_lineage(_guessed(leads.withColumn("was", guess), scraped))


def kept_leads(
    found: DataFrame, reuse_first: bool = True, memory: DataFrame | None = None, local_rows: int = LOCAL_ROWS, component_rows: int = LOCAL_ROWS
) -> DataFrame:
    """The leads a queue of locations keeps, with ``is_fresh``, ``record_website`` and ``memory``.

    Location by location, leads known from kept leads of earlier locations go (by card name, name
    or site), the others are scraped, and those whose site an earlier location (or, by ``memory``,
    an earlier run) scraped come first. A queue of up to ``local_rows`` leads is walked in one task.

    For a larger one, which leads come first depends only on earlier locations, so all locations
    are decided at once from a guess of ``is_fresh``. Where the guess disagrees with its outcome,
    only the connected components of such leads are decided again: those of up to
    ``component_rows`` leads location by location inside a task, larger ones by guesses until they
    agree, each of which settles one more location that reuse reaches. Without ``reuse_first`` the
    first guess is taken as it is.
    """
    options = {"local_rows": local_rows, "component_rows": component_rows}
    leads = _guessed(_remembered(found, memory), None)
    if not reuse_first:
        return cut_lineage(dedup_leads(leads, _ORDER, seen_as=name_key(F.col("card_name")), **options))
    if found.count() <= local_rows:
        return cut_lineage(_walk_locations(leads.withColumn("component", F.lit(0)).coalesce(1)))
    kept, marked = _kept_by_guess(leads, **options)
    wrong = ~F.col("was").eqNullSafe(F.struct("is_fresh", "record_website"))
    if marked.filter(wrong).isEmpty():
        return kept
    place = ["location_ord", "card_ord"]
    name = lambda c: F.concat(F.lit("n"), name_key(F.col(c)))
    narrow = marked.select(*place, wrong.alias("wrong"), name("business_name").alias("name"), F.concat(F.lit("s"), site_key(F.col("website"))).alias("site"), name("card_name").alias("card"))
    labelled = cut_lineage(with_component(narrow, F.col("name"), F.col("site"), F.col("card")).select(*place, "wrong", "component"))
    sizes = labelled.groupBy("component").agg(F.count("*").alias("leads"), F.max("wrong").alias("wrong")).filter("wrong")
    touched = cut_lineage(labelled.drop("wrong").join(sizes.select("component", "leads"), "component"))
    settled = kept.join(touched, place, "left_anti")
    again = marked.drop("was").join(touched, place)
    walked = _walk_locations(again.filter(F.col("leads") <= component_rows).drop("leads").repartition("component"))
    leads = cut_lineage(again.filter(F.col("leads") > component_rows).drop("component", "leads"))
    pieces = [settled, walked]
    while not leads.isEmpty():
        kept, marked = _kept_by_guess(leads, **options)
        if marked.filter(wrong).isEmpty():
            pieces.append(kept)
            break
        leads = marked.drop("was")
    return cut_lineage(reduce(DataFrame.unionByName, pieces))


def run_batch(
    listings: DataFrame,
    facts: DataFrame,
    ledger: DataFrame | None = None,
    columns=DEFAULT_COLUMNS,
    max_results: int | None = None,
    mode: str = "scraped",
    order: str = "by_location",
    seconds: float | None = None,
    remembered: list[DataFrame] = (),
    memory: DataFrame | None = None,
    **options,
) -> BatchResult:
    """Run a queue of locations.

    ``order``: "by_location" puts leads with a reused scrape first in their location; "one_pass"
    leaves them where they are (see ``kept_leads``). Names and sites alone decide which leads stay,
    so only the sites of kept leads are turned into records. ``remembered``: normalised ledgers
    beside ``ledger``, each met as it is stored. ``memory``: scrapes of earlier runs (see
    ``SCRAPES_SCHEMA``), one row per site; with it the result holds the scrapes to add.
    """
    found = collect_listings(listings, max_results, [*([normalized(ledger)] if ledger is not None else []), *remembered])
    found = cut_lineage(found)
    kept = kept_leads(found, reuse_first=order == "by_location", memory=memory, **options)
    asked = kept.filter(F.col("memory").isNull()).select(F.col("record_website").alias("website"))
    scraped = None
    if memory is not None:
        new = _remembered(dropped_as_known(found, kept).filter(~F.col("known")).drop("known"), memory).filter(F.col("memory").isNull())
        scraped = cut_lineage(_first_scrapes(new).select("site", F.col("record_website").alias("website")))
        asked = asked.unionByName(scraped.select("website"))
    records = company_records(asked, facts, most_contacts=CONTACT_PAGES)
    if memory is not None:
        records = cut_lineage(records)  # leads and scrapes both look theirs up
        scraped = enrich(scraped, records).select("site", F.col("website").alias("record_website"), *SCRAPED_FIELDS)
    enriched = _with_records(kept, records)
    routed = cut_lineage(route(enriched, columns, mode))
    counters = cut_lineage(location_counters(found, kept, routed))
    return BatchResult(routed, counters, run_summary(counters, seconds), growth(kept), scraped)


def _with_records(kept: DataFrame, records: DataFrame) -> DataFrame:
    """Enrich by the website whose record applies, or by the remembered scrape; a reused scrape brings no error along."""
    swapped = kept.withColumn("own_website", F.col("website")).withColumn("website", F.col("record_website"))
    out = enrich(swapped, records)

    def field(name: str) -> Column:
        return F.when(F.col("memory").isNotNull(), F.col(f"memory.{name}")).otherwise(F.col(name))

    return out.withColumns({
        "website": F.col("own_website"),
        "error": F.when(F.col("is_fresh") == 1, F.col("error")).otherwise(F.lit("")),
        **{name: field(name) for name in SCRAPED_FIELDS},
    }).drop("own_website", "record_website", "is_fresh", "memory")


def run_single_location(listings: DataFrame, facts: DataFrame, columns=DEFAULT_COLUMNS, max_results: int | None = None) -> DataFrame:
    """One search without dedup or ledger; rows that miss a required field are skipped."""
    found = cut_lineage(collect_listings(listings, max_results))
    leads = enrich(found, company_records(found, facts, most_contacts=CONTACT_PAGES), with_timestamp=True)
    return route(leads, columns, mode="simple").filter(F.col("reject_reason").isNull())


def skip_scrape(listings: DataFrame, max_results: int | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """Collect only: the clean listing rows without any page work."""
    return collect_listings(listings, max_results, [] if ledger is None else [ledger]).drop("card_name")


__all__ = ["BatchResult", "SCRAPED_FIELDS", "SCRAPES_SCHEMA", "kept_leads", "mark_reused", "run_batch", "run_single_location", "skip_scrape"]
