"""Field extractors: columns over the parsed columns of a page.

Everything here is per row; ``page_facts`` adds no exchange to the scan of the pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import patterns as P
from leadloom.functions.arrays import first, let, non_empty, sorted_set, string_array, unique_ignoring_case
from leadloom.functions.once import once_per_application
from leadloom.functions.text import (
    WS,
    clean_company_name,
    clean_email,
    deobfuscate,
    normalize_label,
    squash,
    strip,
)
from leadloom.functions.urls import host_name_label, resolve_url, same_site, unquote
from leadloom.operators.parse import HEADINGS, parse_pages
from leadloom.operators.predicates import is_likely_service, is_service_hint, reads_like_service


def _find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# --- emails -------------------------------------------------------------------------------


def _find_emails(text: Column, pattern: str) -> Column:
    """All matches of an email pattern, in order.

    No match holds a space, so only the space-separated words with an @ meet the pattern.
    """
    def search(t: Column) -> Column:
        words = F.filter(F.split(t, " "), lambda w: F.contains(w, F.lit("@")))
        return F.when(F.contains(t, F.lit("@")), _find_all(F.array_join(words, " "), pattern)).otherwise(string_array())

    return let(text, search)


def emails(text: Column, links: Column) -> Column:
    """Sorted emails of the page text (written-out signs decoded) and of the link targets.

    Distinct by exact spelling, before lower-casing.
    """
    hrefs = F.array_join(F.transform(links, lambda a: a["href"]), " ")
    found = _find_emails(F.concat_ws(" ", deobfuscate(text, squashed=True), hrefs), P.EMAIL)
    return F.array_sort(non_empty(F.transform(F.array_distinct(found), clean_email)))


def loose_matches(plain_text: Column) -> Column:
    """Matches of the looser pattern in reading order, tidied."""
    return F.transform(_find_emails(deobfuscate(plain_text, squashed=True), P.LOOSE_EMAIL), _tidy)


def _tidy(email: Column) -> Column:
    return F.regexp_replace(strip(F.lower(email)), r"[.,;]++\z", "")


def loose_emails(matches: Column, hrefs: Column) -> Column:
    """Sorted set of mailto targets (kept whole) and the loose matches of a page."""
    mailto = F.filter(
        F.transform(
            F.filter(hrefs, lambda h: h.rlike("(?i)^mailto:")),
            lambda h: _tidy(F.regexp_replace(h, "^mailto:", "")),
        ),
        lambda e: F.contains(e, F.lit("@")),
    )
    return sorted_set(F.concat(mailto, matches))


def first_email(matches: Column) -> Column:
    """First email in reading order, or NULL."""
    return first(non_empty(matches))


# --- phones -------------------------------------------------------------------------------


def phones(text: Column, links: Column) -> Column:
    """Sorted set of tel: targets and of number-like texts with 7 to 15 digits."""
    called = non_empty(
        F.transform(
            F.filter(links, lambda a: F.lower(a["href"]).startswith("tel:")),
            lambda a: squash(unquote(F.regexp_replace(a["href"], "^tel:", ""))),
        )
    )

    def plausible(number: Column) -> Column:
        return let(
            F.regexp_replace(number, P.NOT_DIGIT, ""),
            lambda d: F.length(d).between(7, 15)
            & ~((F.length(d) == 8) & d.startswith("202"))
            & ~d.startswith("0000"),
        )

    written = F.filter(
        F.transform(_find_all(text, P.PHONE), lambda m: F.btrim(m, F.lit(P.PHONE_EDGE))), plausible
    )
    return sorted_set(F.concat(called, written))


# --- location -----------------------------------------------------------------------------


def location(meta: Column, text_parts: Column, text: Column) -> Column:
    """Address from meta entries, else the first chunk that reads like an address, else NULL."""
    from_meta = first(
        F.filter(meta, lambda m: m["key"].rlike(P.any_of(P.ADDRESS_META_KEYS)) & (strip(m["content"]) != ""))
    )["content"]
    chunks = F.when(F.size(text_parts) > 0, text_parts).otherwise(
        F.split(text, rf"(?U)[;•|]|\. |{WS}{{3,}}")
    )
    written = first(
        F.filter(
            F.transform(chunks, strip),
            lambda c: (F.length(c) > 10)
            & (F.length(c) < 150)
            & c.rlike(r"\p{Nd}")
            & F.lower(c).rlike(P.any_of(P.ADDRESS_WORDS)),
        )
    )
    return F.coalesce(strip(from_meta), written)


# --- links that matter --------------------------------------------------------------------


def resolved_links(url: Column, links: Column) -> Column:
    """ARRAY<STRUCT<contact,url>>: absolute addresses of contact links and social profiles.

    A resolved address can only name a network if the href or the page address does, so
    other links are left out before they are resolved.
    """
    candidates = F.filter(
        F.transform(
            links,
            lambda a: F.struct(
                a["href"].alias("href"),
                F.lower(F.concat_ws(" ", a["text"], a["href"])).rlike(P.any_of(P.CONTACT_WORDS)).alias("contact"),
            ),
        ),
        lambda a: a["contact"] | a["href"].rlike(P.SOCIAL_HOSTS) | url.rlike(P.SOCIAL_HOSTS),
    )
    return F.transform(
        candidates,
        lambda a: F.struct(a["contact"].alias("contact"), resolve_url(url, strip(a["href"])).alias("url")),
    )


def contact_links(url: Column, resolved: Column) -> Column:
    """Addresses of contact pages on the same site, in page order."""
    own = F.filter(resolved, lambda a: a["contact"] & same_site(url, a["url"]))
    return unique_ignoring_case(F.transform(own, lambda a: a["url"]))


# --- socials ------------------------------------------------------------------------------


def socials(resolved: Column) -> Column:
    """ARRAY<STRUCT<network,url>>: first profile link per network, in order of discovery."""

    def first_match(urls: Column, order: int, network: str) -> Column:
        found = F.transform(
            urls,
            lambda u, i: F.struct(
                i.alias("at"),
                F.lit(order).alias("order"),
                F.lit(network).alias("network"),
                F.regexp_replace(F.regexp_extract(u, P.SOCIAL_URLS[network], 0), r"/++\z", "").alias("url"),
            ),
        )
        return first(F.filter(found, lambda m: m["url"] != ""))

    return let(
        F.transform(resolved, lambda a: a["url"]),
        lambda urls: F.transform(
            F.array_sort(
                F.filter(
                    F.array(*[first_match(urls, k, n) for k, n in enumerate(P.NETWORKS)]),
                    lambda m: m.isNotNull(),
                )
            ),
            lambda m: F.struct(m["network"].alias("network"), m["url"].alias("url")),
        ),
    )


def social(profiles: Column, network: str) -> Column:
    return F.coalesce(first(F.filter(profiles, lambda s: s["network"] == network))["url"], F.lit(""))


def discovered_socials(profiles: Column) -> Column:
    return F.array_join(F.transform(profiles, lambda s: s["url"]), ", ")


def exported_socials(*values: Column) -> Column:
    """Profile links in the fixed network order, empty ones left out."""
    return F.array_join(non_empty(F.array(*values)), ", ")


# --- name ---------------------------------------------------------------------------------


def company_name(url: Column, title: Column, meta: Column, elements: Column) -> Column:
    def entry(key: str) -> Column:
        return F.nullif(first(F.filter(meta, lambda m: m["key"] == key))["content"], F.lit(""))

    heading = first(F.filter(elements, lambda e: e["tag"] == "h1"))["text"]
    raw = F.coalesce(entry("og:site_name"), entry("application-name"), title, heading)
    return F.when(raw.isNotNull(), clean_company_name(raw)).otherwise(host_name_label(url))


# --- services -----------------------------------------------------------------------------


def nav_labels(links: Column) -> Column:
    """Texts of navigation links that name a service in text or address."""
    return F.transform(
        F.filter(
            links,
            lambda a: a["in_nav"]
            & (
                F.lower(F.concat_ws(" ", a["text"], a["href"])).rlike(P.any_of(P.SERVICE_WORDS))
                | is_service_hint(a["text"])
            ),
        ),
        lambda a: a["text"],
    )


def section_labels(elements: Column) -> Column:
    """h3, h4 and li texts between a service heading and the next other h1 or h2."""

    def opens(e: Column) -> Column:
        return e["tag"].isin(*HEADINGS) & F.lower(e["text"]).rlike(P.any_of(P.SERVICE_WORDS))

    def sections(items: Column) -> Column:
        marks = F.filter(
            F.transform(
                items,
                lambda e, i: F.struct(
                    i.alias("at"),
                    F.when(opens(e), "open").when(e["tag"].isin("h1", "h2"), "close").alias("kind"),
                ),
            ),
            lambda m: m["kind"].isNotNull(),
        )
        spans = let(
            marks,
            lambda ms: F.filter(
                F.transform(
                    ms,
                    lambda m, i: F.struct(
                        m["kind"].alias("kind"),
                        (m["at"] + 2).alias("begin"),
                        (F.coalesce(F.get(ms, i + 1)["at"], F.size(items)) - m["at"] - 1).alias("length"),
                    ),
                ),
                lambda s: s["kind"] == "open",
            ),
        )
        inside = F.flatten(F.transform(spans, lambda s: F.slice(items, s["begin"], s["length"])))
        return F.transform(F.filter(inside, lambda e: e["tag"].isin("h3", "h4", "li")), lambda e: e["text"])

    return let(elements, sections)


def heading_labels(elements: Column) -> Column:
    return F.transform(
        F.filter(
            elements,
            lambda e: e["tag"].isin("h2", "h3", "h4") & is_service_hint(e["text"]) & reads_like_service(e["text"]),
        ),
        lambda e: e["text"],
    )


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    """Does ``text`` hold one of the words? Plain searches; words that hold another one are left out."""
    least = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in least])


def categorize(labels: Column) -> Column:
    """Categories in rule order, then the labels that match no rule, in input order."""

    def named(text: Column) -> Column:
        found = [F.when(_holds_any(text, words), F.lit(name)) for name, words in P.SERVICE_CATEGORIES.items()]
        return F.array_compact(F.array(*found))

    every_word = [w for words in P.SERVICE_CATEGORIES.values() for w in words]

    def of(ls: Column) -> Column:
        # No word of a rule holds a line feed, so none is found across two labels.
        text = F.lower(F.array_join(ls, "\n"))
        rest = F.filter(ls, lambda x: ~let(F.lower(x), lambda lowered: _holds_any(lowered, every_word)))
        return F.concat(let(text, named), rest)

    return let(
        labels,
        lambda ls: F.when(F.size(ls) == 0, string_array()).otherwise(unique_ignoring_case(of(ls))),
    )


def service_labels(links: Column, elements: Column) -> Column:
    """Cleaned candidate labels of navigation, service sections and headings."""
    candidates = F.concat(nav_labels(links), section_labels(elements), heading_labels(elements))
    return unique_ignoring_case(
        F.filter(F.transform(candidates, normalize_label), lambda x: (x != "") & is_likely_service(x))
    )


def services(links: Column, elements: Column) -> Column:
    return categorize(service_labels(links, elements))


# --- all facts of a page ------------------------------------------------------------------


def with_final_url(pages: DataFrame) -> DataFrame:
    """Pages know the address they were requested by and, if redirected, where they ended; perhaps when they were read."""
    if "final_url" not in pages.columns:
        pages = pages.withColumn("final_url", F.col("url"))
    if "crawled_at" not in pages.columns:
        pages = pages.withColumn("crawled_at", F.lit(None).cast("timestamp"))
    return pages


@once_per_application
def _shared_columns() -> list[Column]:
    """Intermediate columns that more than one field reads."""
    return [
        resolved_links(F.col("final_url"), F.col("links")).alias("resolved"),
        loose_matches(F.col("plain_text")).alias("loose"),
    ]


@once_per_application
def _fact_columns() -> list[Column]:
    c = F.col
    return [
        c("page_id"),
        c("url"),
        c("final_url"),
        c("crawled_at"),
        company_name(c("final_url"), c("title"), c("meta"), c("elements")).alias("company_name"),
        emails(c("text"), c("links")).alias("emails"),
        services(c("links"), c("elements")).alias("services"),
        phones(c("text"), c("links")).alias("phones"),
        location(c("meta"), c("text_parts"), c("text")).alias("location"),
        socials(c("resolved")).alias("socials"),
        contact_links(c("final_url"), c("resolved")).alias("contact_links"),
        loose_emails(c("loose"), c("hrefs")).alias("loose_emails"),
        first_email(c("loose")).alias("first_email"),
    ]


def page_facts(pages: DataFrame, *kept: str) -> DataFrame:
    """One small row of extracted facts per page, with the columns ``kept`` of the page; a narrow job over the page scan."""
    return parse_pages(with_final_url(pages)).select("*", *_shared_columns()).select(*_fact_columns(), *kept)
