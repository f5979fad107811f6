"""Counters per location and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import elapsed, name_key, stamp, strip
from leadloom.functions.urls import site_key
from leadloom.operators.joins import filled
from leadloom.operators.predicates import counts_as_email

COUNTERS = (
    "collected", "already_processed", "scraped", "after_dedup", "qualified", "exported",
    "duplicates", "emails", "linkedin", "instagram",
)


def _filled(column: str) -> Column:
    return strip(F.coalesce(column, F.lit(""))) != ""


def dropped_as_known(leads: DataFrame, kept: DataFrame) -> DataFrame:
    """Leads with ``known``: a kept lead of an earlier location has the same name or site, or the card's name.

    A name or site occurs on one kept lead only, so the lookups meet unique keys.
    """
    keys = {"_name": ("name", name_key(F.col("business_name"))), "_site": ("site", site_key(F.col("website")))}
    if "card_name" in leads.columns:
        keys["_card"] = ("name", name_key(F.col("card_name")))
    holders = kept.select(
        F.col("location_ord").alias("at"),
        name_key(F.col("business_name")).alias("name"),
        site_key(F.col("website")).alias("site"),
    )
    keyed = leads.select("*", *[key.alias(column) for column, (_, key) in keys.items()])
    for column, (kind, _) in keys.items():
        held = holders.filter(F.col(kind).isNotNull()).select(F.col(kind).alias(column), F.col("at").alias(f"{column}_at"))
        keyed = keyed.withColumn(column, filled(F.col(column), "listing_id")).join(held, column, "left")
    earlier = F.greatest(*[F.coalesce(F.col(f"{column}_at") < F.col("location_ord"), F.lit(False)) for column in keys], F.lit(False))
    return keyed.select(*leads.columns, earlier.alias("known"))


def location_counters(leads: DataFrame, kept: DataFrame, routed: DataFrame) -> DataFrame:
    """One row per location: from ``leads`` (before dedup), ``kept`` and ``routed`` rows.

    Every count is combined on the map side, so a location of any size is one small row.
    """
    before = dropped_as_known(leads, kept).groupBy("location_ord").agg(
        F.count(F.lit(1)).alias("collected"), F.count_if("known").alias("already_processed")
    )
    after = routed.groupBy("location_ord").agg(
        F.count(F.lit(1)).alias("after_dedup"),
        F.count_if(F.col("reject_reason").isNull()).alias("qualified"),
        F.count_if(counts_as_email(F.col("email"))).alias("emails"),
        F.count_if(_filled("linkedin")).alias("linkedin"),
        F.count_if(_filled("instagram")).alias("instagram"),
    )
    joined = before.join(after, "location_ord", "left").na.fill(0)
    return joined.select(
        "location_ord",
        *[
            c.alias(n)
            for n, c in {
                "collected": F.col("collected") - F.col("already_processed"),
                **{n: F.col(n) for n in ("already_processed", "after_dedup", "qualified", "emails", "linkedin", "instagram")},
                "scraped": F.col("collected") - F.col("already_processed"),
                "exported": F.col("qualified"),
                "duplicates": F.col("collected") - F.col("already_processed") - F.col("after_dedup"),
            }.items()
        ],
    ).select("location_ord", *COUNTERS)


def run_summary(counters: DataFrame, seconds: float | None = None) -> DataFrame:
    """(label, value) rows of a run; none if no lead qualified."""
    totals = counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
    rows = [
        ("Companies Found", F.col("scraped")),
        ("Qualified Leads", F.col("qualified")),
        ("Emails Found", F.col("emails")),
        ("LinkedIn Profiles", F.col("linkedin")),
        ("Instagram Profiles", F.col("instagram")),
        ("Duplicates Removed", F.col("duplicates")),
    ]
    if seconds is not None:
        rows += [
            ("Time Generated", elapsed(F.lit(float(seconds)))),
            ("Date Run", stamp(F.current_timestamp(), minutes_only=True)),
        ]
    pairs = [F.struct(F.lit(label).alias("label"), value.cast("string").alias("value")) for label, value in rows]
    return totals.filter(F.col("qualified") > 0).select(F.inline(F.array(*pairs)))


def skip_counts(leads: DataFrame, fresh: DataFrame) -> DataFrame:
    """(location_ord, skipped): leads that the ledger removed."""
    count = lambda df, name: df.groupBy("location_ord").agg(F.count(F.lit(1)).alias(name))
    return (
        count(leads, "found")
        .join(count(fresh, "fresh"), "location_ord", "left")
        .select("location_ord", (F.col("found") - F.coalesce("fresh", F.lit(0))).alias("skipped"))
        .filter(F.col("skipped") > 0)
    )
