"""Company records: home page, contact pages and social fallbacks joined by address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import patterns as P
from leadloom.functions.arrays import let, ordered_concat, string_array, unique_ignoring_case
from leadloom.functions.urls import candidate_urls, contact_guess, facebook_about_url, linkedin_candidates
from leadloom.functions.text import stamp, strip
from leadloom.operators.extract import discovered_socials, page_facts, social, with_final_url
from leadloom.operators.joins import cut_lineage, evenly
from leadloom.operators.predicates import is_login_wall
from leadloom.sources import versions

_FACTS = (
    "final_url", "crawled_at", "company_name", "emails", "services", "phones", "location", "socials",
    "contact_links", "loose_emails", "first_email",
)


def facts_by_url(pages: DataFrame) -> DataFrame:
    """Facts keyed by address, one row each (the lowest page_id wins).

    Pages are dealt over all tasks and parsed once; the small fact rows are what the lookups shuffle. The result is
    cut off from the parse because every lookup below reads it again.
    """
    return cut_lineage(facts_of_pages(page_facts(evenly(pages, "page_id", "url"))))


def refreshed_facts(pages: DataFrame, path: str) -> DataFrame:
    """Facts of all ``pages``, one row per page, parsing only those that are new or changed since the last call for ``path``.

    ``path`` keeps the facts with a hash of what they were read from. Pages are compared by narrow
    rows of page_id and hash; only the few changed ones are fetched whole and parsed. Pages that
    are gone lose their facts. The new state is published in one step (see ``leadloom.sources.versions``),
    so a run that ends early leaves the old one. Adds ``parsed``: the page was parsed in this call.
    ``crawled_at`` is that of ``pages``. Rows without a page_id are parsed every time.
    """
    spark, pages = pages.sparkSession, with_final_url(pages)
    parts = [F.coalesce(c, F.lit("")) for c in ("url", "final_url", "html")]
    keyed = pages.withColumn("content", F.sha1(F.concat_ws("\0", *parts).cast("binary")))
    known, key = versions.read(spark, path), ["page_id", "content"]
    now = keyed.select(*key, "crawled_at").dropDuplicates(key)
    changed = keyed if known is None else keyed.join(now.join(known.select(*key), key, "left_anti"), key, "left_semi")
    if known is not None:
        changed = changed.unionByName(keyed.filter(F.col("page_id").isNull()))
    parsed = page_facts(evenly(changed, "page_id", "url"), "content").withColumn("parsed", F.lit(True))
    if known is not None:
        same = known.drop("crawled_at", "parsed").join(now, key)
        parsed = parsed.unionByName(same.withColumn("parsed", F.lit(False)))
    versions.put(parsed, path, drop=lambda _: True)
    versions.vacuum(spark, path)
    return versions.read(spark, path).drop("content")


def facts_of_pages(facts: DataFrame) -> DataFrame:
    """Facts keyed by address, from facts by page (the lowest page_id wins)."""
    best = facts.groupBy("url").agg(F.min_by(F.struct(*_FACTS), "page_id").alias("facts"))
    return best.select("url", "facts.*")


def homepage_requests(sites: DataFrame) -> DataFrame:
    """(website, attempt, url): the addresses to try for each distinct website."""
    return (
        sites.select("website")
        .distinct()
        .select("website", F.posexplode(candidate_urls(F.col("website"))).alias("attempt", "url"))
    )


def homepages(sites: DataFrame, facts: DataFrame) -> DataFrame:
    """Each website with the facts of the first address that resolves; else an error text."""
    tried = homepage_requests(sites).join(facts.withColumn("_found", F.lit(True)), "url", "left")
    picked = F.min_by(F.struct("url", *_FACTS), F.when(F.col("_found"), F.col("attempt")))
    return (
        tried.groupBy("website")
        .agg(picked.alias("home"))
        .select(
            "website",
            "home.*",
            F.when(F.col("home").isNull(), F.concat(F.lit("no page for "), F.col("website"))).alias("error"),
        )
    )


def _lookup(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Join requests to facts by address; many requests may name the same address."""
    return requests.join(facts, "url")


def contact_pages(homes: DataFrame, facts: DataFrame, most: int | None = None) -> DataFrame:
    """Facts of the contact pages of each site, if asked the first few; a page that is missing uses up its place."""
    links = F.col("contact_links") if most is None else F.slice("contact_links", 1, most)
    requests = homes.select("website", F.posexplode(links).alias("place", "url"))
    return _lookup(requests, facts.drop("contact_links"))


def _first_per_network(profiles: Column) -> Column:
    return let(
        profiles,
        lambda all_: let(
            F.transform(all_, lambda s: s["network"]),
            lambda networks: F.filter(all_, lambda s, i: F.array_position(networks, s["network"]) == i + 1),
        ),
    )


def fold_contacts(homes: DataFrame, contacts: DataFrame | None) -> DataFrame:
    """Home page facts completed by those of the contact pages, in page order."""
    base = homes.select(
        "website", "url", "company_name", "emails", "services", "phones", "location", "socials", "crawled_at", "error"
    )
    if contacts is None:
        merged = base.select(
            *base.columns,
            *[F.array().cast(base.schema[c].dataType).alias(f"more_{c}") for c in ("emails", "services", "phones", "socials")],
            F.lit(None).cast("string").alias("more_location"),
        )
    else:
        place = F.col("place")
        # As many rows per website as it has contact links, at most.
        more = contacts.groupBy("website").agg(
            ordered_concat(place, F.col("emails")).alias("more_emails"),
            ordered_concat(place, F.col("services")).alias("more_services"),
            ordered_concat(place, F.col("phones")).alias("more_phones"),
            ordered_concat(place, F.col("socials")).alias("more_socials"),
            F.min_by("location", F.when(F.coalesce("location", F.lit("")) != "", place)).alias("more_location"),
        )
        merged = base.join(more, "website", "left")

    def both(column: str) -> Column:
        empty = F.array().cast(base.schema[column].dataType)
        return F.concat(F.coalesce(column, empty), F.coalesce(f"more_{column}", empty))

    return merged.select(
        "website",
        "url",
        "company_name",
        unique_ignoring_case(both("emails")).alias("email"),
        unique_ignoring_case(both("services")).alias("services"),
        unique_ignoring_case(both("phones")).alias("phone"),
        F.coalesce(F.nullif("location", F.lit("")), F.col("more_location"), F.lit("")).alias("location"),
        _first_per_network(both("socials")).alias("socials"),
        "crawled_at",
        "error",
    )


def social_requests(rows: DataFrame, key: str, facebook: Column, linkedin: Column, first_step: int = 0) -> DataFrame:
    """(key, step, url): social pages to try, Facebook before LinkedIn."""
    urls = F.concat(
        F.array(facebook_about_url(facebook)),
        linkedin_candidates(linkedin),
    )
    return (
        rows.select(key, F.posexplode(urls).alias("step", "url"))
        .filter(F.col("url").isNotNull())
        .withColumn("step", F.col("step") + first_step)
    )


def _social_email(first_step: int) -> Column:
    """First email of a social page that did not end on a login wall."""
    walled = F.when(F.col("step") == first_step, is_login_wall(F.col("final_url"), "login")).otherwise(
        is_login_wall(F.col("final_url"), "login", "authwall")
    )
    return F.when(~walled, F.col("first_email"))


def social_fallback(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Records without an email get the first one of their social pages.

    Only records that need it send requests, and all their requests go into one join.
    """
    need = records.filter((F.size("email") == 0) & F.col("error").isNull())
    requests = social_requests(need, "website", social(F.col("socials"), "facebook"), social(F.col("socials"), "linkedin"))
    hits = (
        _lookup(requests, facts.select("url", "final_url", "first_email"))
        .withColumn("found", _social_email(0))
        .filter(F.col("found").isNotNull())
        .groupBy("website")
        .agg(F.min_by("found", "step").alias("social_email"))
    )
    return records.join(hits, "website", "left").withColumn(
        "email",
        F.when(F.col("social_email").isNotNull(), F.array("social_email")).otherwise(F.col("email")),
    ).drop("social_email")


def company_records(
    sites: DataFrame,
    facts: DataFrame,
    include_contacts: bool = True,
    include_socials: bool = True,
    most_contacts: int | None = None,
    run_at: Column | None = None,
) -> DataFrame:
    """One record per distinct website of ``sites``; ``most_contacts`` bounds the contact pages read for each.

    ``timestamp`` is the crawl time of the home page, else ``run_at``, by default the time of the run.
    """
    run_at = F.current_timestamp() if run_at is None else run_at
    homes = homepages(sites, facts)
    records = fold_contacts(homes, contact_pages(homes, facts, most_contacts) if include_contacts else None)
    if include_socials:
        records = social_fallback(records, facts)
    return records.select(
        "website",
        "company_name",
        "email",
        "services",
        "phone",
        "location",
        *[social(F.col("socials"), n).alias(n) for n in P.NETWORKS],
        discovered_socials(F.col("socials")).alias("all_socials"),
        F.when(F.col("error").isNull(), stamp(F.coalesce("crawled_at", run_at))).alias("timestamp"),
        "error",
    )


def record_json(records: DataFrame) -> DataFrame:
    """(website, json): the record, or the short error form for a website without a page."""
    good = F.to_json(
        F.struct(
            "company_name", "email", "services", "phone", "location", *P.NETWORKS, "all_socials", "timestamp",
        ),
        {"ignoreNullFields": "false"},
    )
    failed = F.to_json(
        F.struct(
            F.lit(None).cast("string").alias("company_name"),
            string_array().alias("email"),
            string_array().alias("services"),
            F.col("error"),
        ),
        {"ignoreNullFields": "false"},
    )
    return records.select("website", F.when(F.col("error").isNull(), good).otherwise(failed).alias("json"))


def email_cascade(businesses: DataFrame, facts: DataFrame, key: str = "business_id") -> DataFrame:
    """First email of website, contact page, Facebook and LinkedIn, with its source.

    All steps are requested in one join and the earliest hit is picked per business.
    """
    site = strip(F.coalesce("website", F.lit("")))
    rows = businesses.withColumn("website", site)
    with_site = rows.filter(F.col("website") != "")
    own = with_site.select(
        key, F.posexplode(F.array(F.col("website"), contact_guess(F.col("website")))).alias("step", "url")
    )
    other = social_requests(
        with_site,
        key,
        strip(F.coalesce("facebook_url", F.lit(""))),
        strip(F.coalesce("linkedin_url", F.lit(""))),
        first_step=2,
    )
    found = F.when(F.col("step") < 2, F.get("loose_emails", F.lit(0))).otherwise(_social_email(2))
    hits = (
        _lookup(own.unionByName(other), facts.select("url", "final_url", "loose_emails", "first_email"))
        .withColumn("found", found)
        .filter(F.col("found").isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct("step", "found")).alias("hit"))
    )
    step = F.col("hit.step")
    return rows.join(hits, key, "left").select(
        key,
        "business_name",
        "rating",
        "website",
        F.coalesce("hit.found", F.lit("N/A")).alias("email"),
        F.when(F.col("website") == "", "no website")
        .when(step.isNull(), "not found")
        .when(step < 2, "website")
        .when(step == 2, "facebook")
        .otherwise("linkedin")
        .alias("email_source"),
    )
