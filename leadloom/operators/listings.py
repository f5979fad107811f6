"""Business listings: result cards to clean rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.arrays import first, non_empty
from leadloom.functions.patterns import NOT_DIGIT
from leadloom.functions.text import clean_text, strip
from leadloom.functions.urls import search_key
from leadloom.operators.ledger import exclude_processed_cards
from leadloom.operators.predicates import has_website


def searches(locations: DataFrame, query: str) -> DataFrame:
    """One search per queued location, in queue order."""
    return locations.withColumn("search", search_key(F.lit(query), F.col("search_location")))


def card_name(card_text: Column) -> Column:
    """First line with text of a card."""
    return F.coalesce(first(non_empty(F.transform(F.split(card_text, "\n"), strip))), F.lit(""))


def result_cards(listings: DataFrame, max_results: int | None = None) -> DataFrame:
    """Cards distinct by address in page order; if asked, the first few of each location.

    Both ranks are bounded by an argument, so Spark cuts the groups before the shuffle.
    """
    if max_results is not None and max_results < 1:
        raise ValueError("max_results must be 1 or more")
    per_address = Window.partitionBy("location_ord", "maps_url").orderBy("card_ord")
    cards = listings.withColumn("_copy", F.row_number().over(per_address)).filter(F.col("_copy") == 1).drop("_copy")
    if max_results is not None:
        per_location = Window.partitionBy("location_ord").orderBy("card_ord")
        cards = (
            cards.withColumn("_rank", F.row_number().over(per_location))
            .filter(F.col("_rank") <= max_results)
            .drop("_rank")
        )
    return cards.withColumn("card_name", card_name(F.col("card_text")))


def rating(labels: Column, star_label: Column) -> Column:
    """First number between 0 and 5 among the image labels, else that of the star label."""
    number = r"((?:\p{Nd})+(?:\.\p{Nd}+)?)"
    numbers = F.transform(labels, lambda t: F.regexp_extract(F.replace(t, F.lit(","), F.lit("")), number, 1))
    in_range = F.filter(
        numbers, lambda n: n.try_cast("double").isNotNull() & (n.try_cast("double") > 0) & (n.try_cast("double") <= 5)
    )
    return F.coalesce(first(in_range), F.regexp_extract(star_label, number, 1), F.lit(""))


def review_count(*labels: Column) -> Column:
    """All digits of the first label that has any."""
    digits = [F.nullif(F.regexp_replace(t, NOT_DIGIT, ""), F.lit("")) for t in labels]
    return F.coalesce(*digits, F.lit(""))


def website_link(*hrefs: Column) -> Column:
    """First candidate that is a web address, else empty."""
    return F.coalesce(first(F.filter(F.array(*hrefs), lambda h: h.startswith("http"))), F.lit(""))


def collect_listings(
    listings: DataFrame, max_results: int | None = None, ledgers: Iterable[DataFrame] = ()
) -> DataFrame:
    """Clean listing rows with a website, minus those that a normalised ledger already knows."""
    cards = result_cards(listings, max_results).withColumn("business_name", clean_text(F.col("business_name")))
    for ledger in ledgers:
        cards = exclude_processed_cards(cards, ledger)
    return cards.select(
        "listing_id",
        "location_ord",
        "card_ord",
        "card_name",
        "business_name",
        "maps_url",
        website_link(F.col("website")).alias("website"),
        rating(F.array("rating_label"), F.lit(None).cast("string")).alias("rating"),
        review_count(F.col("review_label")).alias("review_count"),
        "search_location",
    ).filter(has_website(F.col("website")))
