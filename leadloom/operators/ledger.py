"""Memory of earlier runs: the keys of every business that was accepted or rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import name_key, strip
from leadloom.functions.urls import site_key, website_key
from leadloom.operators.joins import filled

# Headers that name the key columns, in the order they are tried.
NAME_HEADERS = ("company name", "business name")
SITE_HEADERS = ("website", "website url", "web", "site")
LEDGER_SCHEMA = "kind string, key string"


def _pick(columns: list[str], headers: tuple[str, ...], position: int) -> str | None:
    known = {c.strip().lower(): c for c in reversed(columns)}
    for header in headers:
        if header in known:
            return known[header]
    return columns[position] if len(columns) > position else None


def _keys(df: DataFrame, name: str | None, site: str | None) -> DataFrame:
    pairs = [
        F.struct(F.lit(kind).alias("kind"), F.lower(strip(F.col(f"`{column}`"))).alias("key"))
        for kind, column in (("name", name), ("site", site))
        if column is not None
    ]
    return df.select(F.inline(F.array(*pairs))).filter(F.col("key") != "")


def ledger_of(accepted: DataFrame | None, rejected: DataFrame | None, by_position: bool = False) -> DataFrame:
    """Names and sites of both tables, lower case and stripped, not yet normalised.

    ``by_position`` reads the rejected table by its first two columns, whatever their names.
    """
    parts = []
    if accepted is not None:
        parts.append(
            _keys(accepted, _pick(accepted.columns, NAME_HEADERS, 0), _pick(accepted.columns, SITE_HEADERS, 1))
        )
    if rejected is not None and len(rejected.columns) >= 2:
        names, sites = ((), ()) if by_position else (NAME_HEADERS, SITE_HEADERS)
        parts.append(_keys(rejected, _pick(rejected.columns, names, 0), _pick(rejected.columns, sites, 1)))
    if not parts:
        raise ValueError("neither an accepted nor a rejected table")
    return parts[0].distinct() if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()


def normalized(ledger: DataFrame) -> DataFrame:
    """Ledger with site keys in comparison form."""
    key = F.when(F.col("kind") == "site", website_key(F.col("key"))).otherwise(F.col("key"))
    return ledger.select("kind", key.alias("key")).distinct()


def growth(leads: DataFrame) -> DataFrame:
    """Ledger rows that a set of handled leads adds."""
    return (
        leads.select(
            F.inline(
                F.array(
                    F.struct(F.lit("name").alias("kind"), name_key(F.col("business_name")).alias("key")),
                    F.struct(F.lit("site").alias("kind"), site_key(F.col("website")).alias("key")),
                )
            )
        )
        .filter(F.col("key").isNotNull())
        .distinct()
    )


def _known(ledger: DataFrame, kind: str, column: str) -> DataFrame:
    # Only met by anti joins, where repeated keys do no harm; a bucketed ledger stays in its buckets.
    return ledger.filter(F.col("kind") == kind).select(F.col("key").alias(column))


def _without(df: DataFrame, keys: list[tuple[Column, str]], ledger: DataFrame) -> DataFrame:
    """Drop rows with any key in the ledger: one anti join per key, blank keys never match."""
    names = [f"_key{i}" for i in range(len(keys))]
    rest = df.select("*", *[key.alias(n) for n, (key, _) in zip(names, keys)])
    for name, (_, kind) in zip(names, keys):
        spread = rest.withColumn(name, filled(F.col(name), *df.columns))
        rest = spread.join(_known(ledger, kind, name), name, "left_anti").drop(name)
    return rest.select(*df.columns)


def exclude_processed(leads: DataFrame, ledger: DataFrame) -> DataFrame:
    """Leads whose name and site are both new to a normalised ledger."""
    return _without(
        leads, [(name_key(F.col("business_name")), "name"), (site_key(F.col("website")), "site")], ledger
    )


def exclude_processed_cards(cards: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cards that pass the three checks: card name, page name, site."""
    return _without(
        cards,
        [
            (name_key(F.col("card_name")), "name"),
            (name_key(F.col("business_name")), "name"),
            (site_key(F.col("website")), "site"),
        ],
        ledger,
    )
