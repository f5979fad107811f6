"""Listing files as a stream: each micro-batch is one run against what earlier ones remember.

What micro-batch ``n`` writes is kept apart from that of others and replaced as a whole, and it
reads what batches below ``n`` wrote. A batch that is replayed after a failure therefore writes
the same tables again.

* ``accepted``, ``rejected``, ``counters``, ``failed``: folders ``batch_id=n``.
* ``ledger`` (keys of handled leads) and ``scrapes`` (site to what its page gave): keyed state in
  buckets, see ``leadloom.sources.state``. A site that an earlier batch scraped is not looked up
  again, and its leads come first in their location, as in one run over all locations.
* ``totals``: running sums of the counters, one part per batch, of which the last two stay;
  ``summary``: the run summary made of them, replaced by each batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.joins import cut_lineage
from leadloom.operators.ledger import LEDGER_SCHEMA
from leadloom.operators.predicates import is_verification_page
from leadloom.operators.routing import DEFAULT_COLUMNS, accepted_rows, rejected_rows
from leadloom.operators.summary import COUNTERS, run_summary
from leadloom.plans.batch import SCRAPES_SCHEMA, BatchResult, run_batch
from leadloom.sources import versions
from leadloom.sources.state import BATCH, KeyedState
from leadloom.sources.tables import write_summary

TABLES = ("accepted", "rejected", "ledger", "scrapes", "counters", "failed", "totals", "summary")
FAILED_SCHEMA = "location_ord int, search_location string, bad_rows long, error string"


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    path = f"{root}/{table}"
    if versions.live_parts(spark, path) is not None:
        return versions.read(spark, path)
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def ledger_state(spark: SparkSession, root: str, **layout: int) -> KeyedState:
    return KeyedState(spark, f"{root}/ledger", "key", LEDGER_SCHEMA, **layout)


def scrape_state(spark: SparkSession, root: str, **layout: int) -> KeyedState:
    return KeyedState(spark, f"{root}/scrapes", "site", SCRAPES_SCHEMA, **layout)


def ledger_before(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The ledger as it was before a batch; empty on the first run."""
    return ledger_state(spark, root).before(batch_id)


def failed_locations(listings: DataFrame) -> DataFrame:
    """Locations whose input is unusable: a missing location, card address or position, or a verification page.

    The last is seen if the listings carry the page they were read from, as ``result_url`` and ``result_html``.
    """
    bad = reduce(or_, [F.col(c).isNull() for c in ("location_ord", "maps_url", "card_ord", "listing_id")])
    blocked = F.lit(False)
    if {"result_url", "result_html"} <= set(listings.columns):
        blocked = is_verification_page(F.coalesce("result_url", F.lit("")), F.coalesce("result_html", F.lit("")))
    reason = F.when(F.col("blocked_rows") > 0, F.lit("verification page")).otherwise(F.format_string("%d unusable listings", "bad_rows"))
    return (
        listings.groupBy("location_ord")
        .agg(F.min("search_location").alias("search_location"), F.count_if(bad).alias("bad_rows"), F.count_if(blocked).alias("blocked_rows"))
        .filter((F.col("bad_rows") > 0) | (F.col("blocked_rows") > 0))
        .withColumn("error", reason)
        .drop("blocked_rows")
    )


@dataclass
class _Done:
    """What the locations of a batch that went through gave so far."""

    results: list[BatchResult]
    failed: list[DataFrame]
    thrown: list[Exception]


def _error_text(problem: Exception) -> str:
    lines = str(problem.java_exception if isinstance(problem, Py4JJavaError) else problem).splitlines()
    return (lines[0] if lines else type(problem).__name__)[:500]


def _isolated(listings: DataFrame, run: Callable[[DataFrame, _Done], BatchResult]) -> _Done:
    """Run all locations at once; if that throws, halve the queue until the locations that throw stand alone.

    First the listings are read: a location whose rows cannot be read is found by reading only. What
    was read runs as a whole, and only if that throws the halves run, in the order of the queue,
    each against what went through before it; so the others end as in a run without the failing
    ones. A location that throws alone becomes a failed one with its error. If all of several
    locations throw, the fault is not theirs: the error is raised.
    """
    spark, done = listings.sparkSession, _Done([], [], [])

    def own(places: list) -> Column:
        known = [p for p in places if p is not None]
        here = F.col("location_ord").isin(known) if known else F.lit(False)
        return (here | F.col("location_ord").isNull()) if None in places else F.coalesce(here, F.lit(False))

    def by_halves(rows: DataFrame, step: Callable[[DataFrame], None], places: list | None = None) -> None:
        try:
            step(rows if places is None else rows.filter(own(places)))
        except AnalysisException:  # a fault of the job, not of a location
            raise
        except (PySparkException, Py4JJavaError) as problem:
            whole = places is None
            if whole:  # one number per location of the batch
                places = [r[0] for r in rows.select("location_ord").distinct().orderBy(F.asc_nulls_first("location_ord")).collect()]
            if len(places) > 1:
                by_halves(rows, step, places[: len(places) // 2])
                by_halves(rows, step, places[len(places) // 2 :])
            elif places:
                done.thrown.append(problem)
                done.failed.append(spark.createDataFrame([(places[0], None, 0, _error_text(problem))], FAILED_SCHEMA))
            if whole and (not places or len(done.thrown) == len(places) > 1):
                raise

    def attempt(rows: DataFrame) -> None:
        failed = cut_lineage(failed_locations(rows))
        bad = failed.select(F.col("location_ord").alias("_bad"))
        result = run(rows.join(bad, F.col("location_ord").eqNullSafe(F.col("_bad")), "left_anti"), done)
        done.results.append(result)
        done.failed.append(failed.select("location_ord", "search_location", "bad_rows", "error"))

    read: list[DataFrame] = []
    by_halves(listings, lambda rows: read.append(cut_lineage(rows)))
    if read:
        by_halves(reduce(DataFrame.unionByName, read), attempt)
    return done


def _union(frames: list[DataFrame], schema: str, spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def totals_before(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    """The running sums as they were before a batch."""
    keys = [int(k) for k in versions.live_parts(spark, f"{root}/totals") or {} if int(k) < batch_id]
    return versions.read(spark, f"{root}/totals", {str(max(keys))}.__contains__) if keys else None


def _add_totals(spark: SparkSession, root: str, batch_id: int, counters: DataFrame, started: float) -> None:
    delta = counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]).withColumn("seconds", F.lit(time.monotonic() - started))
    before = totals_before(spark, root, batch_id)
    both = delta if before is None else delta.unionByName(before)
    sums = cut_lineage(both.agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "seconds")]))
    # A replay of this batch needs the sums before it, no older ones.
    last = max((int(k) for k in versions.live_parts(spark, f"{root}/totals") or {} if int(k) < batch_id), default=None)
    versions.put(sums.coalesce(1), f"{root}/totals", str(batch_id), drop=lambda k: int(k) != last)
    row = sums.first()
    write_summary(run_summary(sums, row["seconds"]), f"{root}/summary")
    versions.vacuum(spark, f"{root}/totals")
    versions.vacuum(spark, f"{root}/summary")


def process_batch(
    listings: DataFrame,
    batch_id: int,
    facts: DataFrame,
    root: str,
    columns=DEFAULT_COLUMNS,
    start_ledger: DataFrame | None = None,
    buckets: int = 32,
    most_parts: int = 16,
    **options,
) -> None:
    """One micro-batch: failed locations become error rows, the others run as a batch against all that is remembered.

    ``start_ledger``: names and sites known before the first batch, the same for all batches. ``buckets``
    and ``most_parts`` lay out the state; ``buckets`` must stay the same for a ``root``.
    """
    spark, started = listings.sparkSession, time.monotonic()
    layout = {"buckets": buckets, "most_parts": most_parts}
    ledger, scrapes = ledger_state(spark, root, **layout), scrape_state(spark, root, **layout)
    for state in (ledger, scrapes):
        state.compact(batch_id)
    known, recalled = ledger.before(batch_id), scrapes.before(batch_id)

    def run(rows: DataFrame, done: _Done) -> BatchResult:
        memory = reduce(DataFrame.unionByName, [recalled, *[r.scrapes for r in done.results]])
        return run_batch(rows, facts, start_ledger, columns, remembered=[known, *[r.ledger for r in done.results]], memory=memory, **options)

    done = _isolated(listings, run)
    keys = ("listing_id", "location_ord")
    results = done.results or [run(listings.filter(F.lit(False)), done)]
    both = lambda part: reduce(DataFrame.unionByName, [part(r) for r in results])
    tables = {
        "accepted": both(lambda r: accepted_rows(r.routed, columns, *keys)),
        "rejected": both(lambda r: rejected_rows(r.routed, columns, *keys)),
        "counters": both(lambda r: r.counters),
        "failed": _union(done.failed, FAILED_SCHEMA, spark),
    }
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{table}/{BATCH}={batch_id}")
    _add_totals(spark, root, batch_id, tables["counters"], started)
    scrapes.add(both(lambda r: r.scrapes), batch_id)
    # Last: a batch counts as remembered once everything else is written.
    ledger.add(both(lambda r: r.ledger), batch_id)


def run_incremental(
    spark: SparkSession, source: str, schema, facts: DataFrame, root: str, checkpoint: str, columns=DEFAULT_COLUMNS, **options
):
    """Process all listing files that are new since the last run, one file per batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return (
        stream.writeStream.foreachBatch(
            lambda df, batch_id: process_batch(df, batch_id, facts, root, columns, **options)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
