"""Leads to exported rows: field values, column maps, required fields, accept or reject."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.arrays import joined
from leadloom.functions.patterns import NETWORKS
from leadloom.functions.text import blank_to_empty, strip
from leadloom.operators.extract import exported_socials
from leadloom.operators.predicates import is_missing

# Exportable fields and the fields that come from a scraped page.
BATCH_FIELDS = (
    "maps_business_name", "source_url", "rating", "review_count", "company_name", "email", "phone", "location", "services",
    "linkedin", "facebook", "instagram", "twitter", "youtube", "tiktok", "all_socials", "timestamp", "maps_url", "error",
)
SIMPLE_FIELDS = tuple(f for f in BATCH_FIELDS if f not in ("rating", "review_count"))
SCRAPED_FIELDS = (
    "company_name", "email", "phone", "location", "services",
    "instagram", "facebook", "linkedin", "twitter", "youtube", "tiktok",
)


@dataclass(frozen=True)
class ColumnSpec:
    header: str
    field: str
    required: bool = False


DEFAULT_COLUMNS = (
    ColumnSpec("Company Name", "maps_business_name"),
    ColumnSpec("Website", "source_url"),
    ColumnSpec("Company Email", "email"),
    ColumnSpec("Phone", "phone"),
    ColumnSpec("Location", "location"),
    ColumnSpec("Services", "services"),
    ColumnSpec("Google Maps URL", "maps_url"),
    ColumnSpec("Error", "error"),
)


def column_map(columns) -> list[ColumnSpec]:
    """Trimmed specs; rows with a blank header or field are left out, repeated headers refused."""
    specs = [ColumnSpec(c.header.strip(), c.field.strip(), c.required) for c in columns]
    specs = [c for c in specs if c.header and c.field]
    headers = [c.header.lower() for c in specs]
    if len(set(headers)) != len(headers):
        raise ValueError("column headers must differ")
    return specs


def enrich(listings: DataFrame, records: DataFrame, with_timestamp: bool = False) -> DataFrame:
    """Listings with the flat record of their website; without a record the error text stays.

    Batch leads carry no time of their own; single-location runs ask for it.
    """
    extra = ["timestamp"] if with_timestamp else []
    flat = records.select(
        "website",
        blank_to_empty(F.col("company_name")).alias("company_name"),
        joined(F.col("email")).alias("email"),
        joined(F.col("phone")).alias("phone"),
        blank_to_empty(F.col("location")).alias("location"),
        joined(F.col("services")).alias("services"),
        *[blank_to_empty(F.col(n)).alias(n) for n in ("instagram", "facebook", "linkedin", "twitter", "youtube", "tiktok")],
        *[blank_to_empty(F.col(c)).alias(c) for c in (*extra, "error")],
    )
    with_record = listings.join(flat, "website", "left")
    return with_record.select(
        *listings.columns, *[blank_to_empty(F.col(c)).alias(c) for c in (*SCRAPED_FIELDS, *extra, "error")]
    )


def _value(df: DataFrame, column: str) -> Column:
    return blank_to_empty(F.col(column)) if column in df.columns else F.lit("")


def _scraped(df: DataFrame) -> dict[str, Column]:
    return {f: _value(df, f) for f in SCRAPED_FIELDS}


def batch_values(leads: DataFrame, *extra: str) -> DataFrame:
    """Field values of a batch: location is the searched one, missing ratings are "N/A"."""
    scraped = _scraped(leads)
    or_na = lambda c: F.coalesce(F.nullif(_value(leads, c), F.lit("")), F.lit("N/A"))
    values = {
        "maps_business_name": _value(leads, "business_name"),
        "source_url": _value(leads, "website"),
        "rating": or_na("rating"),
        "review_count": or_na("review_count"),
        **scraped,
        "location": _value(leads, "search_location"),
        "all_socials": F.coalesce(
            F.nullif(exported_socials(*[scraped[n] for n in NETWORKS]), F.lit("")), _value(leads, "all_socials")
        ),
        "timestamp": _value(leads, "timestamp"),
        "maps_url": _value(leads, "maps_url"),
        "error": _value(leads, "error"),
    }
    return leads.select(
        "listing_id", "location_ord", "card_ord", *extra, *[values[f].alias(f) for f in BATCH_FIELDS]
    )


def simple_values(leads: DataFrame) -> DataFrame:
    """Field values of a single-location run: names fall back, a missing email is spelled out."""
    scraped = _scraped(leads)
    name = _value(leads, "business_name")
    forced = _value(leads, "search_location")
    fallback = lambda value, other: F.coalesce(F.nullif(value, F.lit("")), other)
    values = {
        "maps_business_name": name,
        **scraped,
        "company_name": fallback(scraped["company_name"], name),
        "source_url": _value(leads, "website"),
        "email": fallback(scraped["email"], F.lit("Contact form only")),
        "location": fallback(forced, scraped["location"]),
        "all_socials": fallback(
            exported_socials(*[strip(scraped[n]) for n in NETWORKS]), _value(leads, "all_socials")
        ),
        "timestamp": _value(leads, "timestamp"),
        "maps_url": _value(leads, "maps_url"),
        "error": _value(leads, "error"),
    }
    return leads.select(
        "listing_id", "location_ord", "card_ord", *[values[f].alias(f) for f in SIMPLE_FIELDS]
    )


def sheet_rows(values: DataFrame, columns=DEFAULT_COLUMNS, *extra: str) -> DataFrame:
    """Rows under the configured headers in configured order; an unknown field gives ""."""
    return values.select(
        *extra, *[_value(values, c.field).alias(c.header) for c in column_map(columns)]
    )


def legacy_rows(values: DataFrame) -> DataFrame:
    """Fixed five columns for callers that configure none."""
    return values.select(
        _value(values, "company_name").alias("Company Name"),
        _value(values, "source_url").alias("Website"),
        F.coalesce(F.nullif(_value(values, "email"), F.lit("")), F.lit("Contact Form Only")).alias("Company Email"),
        _value(values, "location").alias("Location"),
        _value(values, "services").alias("Services"),
    )


def missing_fields(values: DataFrame, columns, scraped: DataFrame | None = None) -> Column:
    """ARRAY of required fields without a usable value.

    With ``scraped`` the check looks at scraped fields only, so any other required field
    counts as missing; without it, at the exported values.
    """
    checks = []
    for c in column_map(columns):
        if not c.required:
            continue
        if scraped is not None and c.field not in SCRAPED_FIELDS:
            checks.append(F.lit(c.field))
        else:
            checks.append(F.when(is_missing(_value(scraped if scraped is not None else values, c.field)), F.lit(c.field)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def route(leads: DataFrame, columns=DEFAULT_COLUMNS, mode: str = "exported") -> DataFrame:
    """Field values plus ``missing`` and ``reject_reason`` (NULL for accepted rows).

    ``mode``: "exported" tests the exported values, "scraped" only the scraped fields,
    "simple" the values of a single-location run.
    """
    if mode == "simple":
        values = simple_values(leads)
        missing = missing_fields(values, columns)
    elif mode == "scraped":
        values = batch_values(leads.withColumn("missing", missing_fields(leads, columns, scraped=leads)), "missing")
        missing = F.col("missing")
    elif mode == "exported":
        values = batch_values(leads)
        missing = missing_fields(values, columns)
    else:
        raise ValueError(f"unknown mode {mode}")
    routed = values.withColumn("missing", missing)
    reason = F.concat(F.lit("Missing Required Field(s): "), F.array_join("missing", ", "))
    return routed.withColumn("reject_reason", F.when(F.size("missing") > 0, reason))


def accepted_rows(routed: DataFrame, columns=DEFAULT_COLUMNS, *extra: str) -> DataFrame:
    return sheet_rows(routed.filter(F.col("reject_reason").isNull()), columns, *extra)


def rejected_rows(routed: DataFrame, columns=DEFAULT_COLUMNS, *extra: str) -> DataFrame:
    """Rejected leads under the configured headers, with the reason as the last column."""
    rejected = routed.filter(F.col("reject_reason").isNotNull())
    specs = column_map(columns)
    return rejected.select(
        *extra,
        *[_value(rejected, c.field).alias(c.header) for c in specs],
        F.col("reject_reason").alias("Reject Reason"),
    )


def rejected_minimal(routed: DataFrame) -> DataFrame:
    rejected = routed.filter(F.col("reject_reason").isNotNull())
    return rejected.select(
        F.col("maps_business_name").alias("Business Name"),
        F.col("source_url").alias("Website"),
        F.col("location").alias("Search Location"),
        F.col("reject_reason").alias("Reject Reason"),
        F.current_timestamp().alias("Date Added"),
    )


def apply_overrides(values: DataFrame, edits: DataFrame, key: str = "listing_id") -> DataFrame:
    """Edited values replace the scraped ones; rows with nothing left in them are refused."""
    fields = [f for f in values.columns if f in BATCH_FIELDS]
    edited = [f for f in fields if f in edits.columns]
    renamed = edits.select(key, *[F.col(f).alias(f"_{f}") for f in edited])
    merged = values.join(renamed, key, "left")
    final = {f: strip(F.coalesce(f"_{f}", f) if f in edited else F.col(f)) for f in fields}
    socials = exported_socials(*[final[n] for n in NETWORKS])
    final["all_socials"] = socials
    rows = merged.select(key, *[final[f].alias(f) for f in fields])
    return rows.filter(F.concat(*[F.coalesce(f, F.lit("")) for f in fields]) != "")
