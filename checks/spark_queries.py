"""One Spark query per operator, over whole tables. Lists become text so that values hash alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import TABLES, VIEWS, with_views
from leadloom.functions import patterns as P
from leadloom.functions import text as T
from leadloom.functions import urls as U
from leadloom.functions.arrays import joined, sorted_set, string_array, unique_ignoring_case
from leadloom.functions.entities import unescape
from leadloom.operators import extract as E
from leadloom.operators import ledger as L
from leadloom.operators import listings as S
from leadloom.operators import predicates as F_
from leadloom.operators import records as R
from leadloom.operators import routing as O
from leadloom.operators import summary as Y
from leadloom.operators.dedup import dedup_leads
from leadloom.operators.joins import cut_lineage, shared_folder
from leadloom.operators.parse import attributes, decode_html, page_tokens, parse_pages
from leadloom.plans.batch import mark_reused, run_batch, run_single_location, skip_scrape
from leadloom.sources.tables import append_rows, cells, grown, read_leads_csv, read_pages, read_rows, write_csv, write_results, write_summary
from leadloom.streaming.incremental import process_batch, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Inputs that several queries share, per application and data folder.
_shared: dict[tuple, DataFrame] = {}

REQUIRED = (
    O.ColumnSpec("Company Name", "maps_business_name"),
    O.ColumnSpec("Website", "source_url"),
    O.ColumnSpec("Company Email", "email", required=True),
    O.ColumnSpec("Services", "services", required=True),
    O.ColumnSpec("Town", "location"),
    O.ColumnSpec(" ", "phone"),
    O.ColumnSpec("Nothing", "no_such_field"),
)
REQUIRED_SIMPLE = (
    O.ColumnSpec("Company Name", "company_name", required=True),
    O.ColumnSpec("Company Email", "email", required=True),
    O.ColumnSpec("Where", "location"),
)


def run_at() -> Column:
    """Time of the run in queries that show it."""
    return F.lit("2024-05-06 07:08:09").cast("timestamp")


def forget_shared() -> None:
    _shared.clear()


def _once(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    if name == "pages":
        return read_pages(spark, path)
    return spark.read.parquet(path)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    def build() -> DataFrame:
        for t in TABLES:
            table(spark, sf, t).createOrReplaceTempView(t)
        for v in with_views(name):
            df = spark.sql(VIEWS[v])
            df.createOrReplaceTempView(v)
        return df

    return _once(spark, sf, name, build)


def parsed(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return parse_pages(view(spark, sf, "lead_pages"), *columns)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "facts", lambda: R.facts_by_url(view(spark, sf, "web_pages")))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "listings").filter(F.col("website") != "").select("website")


def homes(spark: SparkSession, sf: str) -> DataFrame:
    return R.homepages(sites(spark, sf), facts(spark, sf))


def records(spark: SparkSession, sf: str) -> DataFrame:
    return R.company_records(sites(spark, sf), facts(spark, sf), most_contacts=P.CONTACT_PAGES, run_at=run_at())


def collected(spark: SparkSession, sf: str) -> DataFrame:
    return S.collect_listings(view(spark, sf, "listings"))


def known(spark: SparkSession, sf: str) -> DataFrame:
    return L.normalized(view(spark, sf, "ledger"))


def fresh(spark: SparkSession, sf: str) -> DataFrame:
    return L.exclude_processed(collected(spark, sf), known(spark, sf))


def leads(spark: SparkSession, sf: str) -> DataFrame:
    return O.enrich(fresh(spark, sf), records(spark, sf))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        spark, sf, "kept",
        lambda: cut_lineage(dedup_leads(leads(spark, sf), ["location_ord", "card_ord"])),
    )


def batch(spark: SparkSession, sf: str):
    key = (spark.sparkContext.applicationId, sf, "batch")
    if key not in _shared:
        _shared[key] = run_batch(
            view(spark, sf, "listings"), facts(spark, sf), view(spark, sf, "ledger"), REQUIRED
        )
    return _shared[key]


def text_of(items: Column) -> Column:
    return joined(items, "|")


def query(name: str):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def _on(name: str, source: str, *columns: Callable[[], Column] | str) -> None:
    """Query that selects columns from a table, a shared view or, as ``parsed:a,b``, from parsed columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        if source.startswith("parsed:"):
            df = parsed(spark, sf, *source.removeprefix("parsed:").split(","))
        elif source in VIEWS:
            df = view(spark, sf, source)
        else:
            df = table(spark, sf, source)
        return df.select(*[c if isinstance(c, str) else c() for c in columns])

    QUERIES[name] = run


c = F.col
lit = F.lit

# --- sources ------------------------------------------------------------------------------


@query("a1_pages")
def _(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet")
    return pages.select("page_id", "url", decode_html(c("html").cast("binary")).alias("html"))


@query("a1_charsets")
def _(spark, sf):
    """Pages as bytes in three charsets, with bytes that are wrong in theirs."""
    pages, kind = read_pages(spark, f"{sf}/pages.parquet"), c("page_id") % 4
    latin = F.regexp_replace("html", "[^\\x00-\\x7f\\xa0-\\xff]", "?")
    as_bytes = (
        F.when(kind == 0, F.encode("html", "UTF-8"))
        .when(kind == 1, F.encode(latin, "ISO-8859-1"))
        .when(kind == 2, F.concat(F.encode(latin, "ISO-8859-1"), F.unhex(lit("8081"))))
        .otherwise(F.concat(F.encode("html", "UTF-8"), F.unhex(lit("FF"))))
    )
    header = F.when(kind == 1, "text/html; charset=ISO-8859-1").when(kind == 2, "text/html;Charset=\"Windows-1252\"; x=y").when(kind == 3, "text/html; charset=utf-8")
    path = _output(spark)
    pages.select("page_id", "url", as_bytes.alias("html"), header.alias("content_type")).write.parquet(path)
    return read_pages(spark, path).select("page_id", "html")


def _raw_url() -> Column:
    """Website spellings built from page addresses."""
    rest = F.regexp_replace(c("url"), "^https?://", "")
    host = F.regexp_extract(c("url"), "^https?://([^/?#]+)", 1)
    return (
        F.when(c("page_id") % 6 == 0, c("url"))
        .when(c("page_id") % 6 == 1, rest)
        .when(c("page_id") % 6 == 2, F.concat(host, lit(":8080/x")))
        .when(c("page_id") % 6 == 3, F.concat(lit("//"), rest))
        .when(c("page_id") % 6 == 4, F.concat(lit("HTTPS://WWW."), F.upper(host), lit("/a b//?")))
        .otherwise(F.concat(lit("localhost:80/"), rest))
    )


_on("a2_normalize_url", "pages", "page_id", lambda: U.normalize_url(_raw_url()).alias("url"))


@query("a3_candidate_urls")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.posexplode(U.candidate_urls(_raw_url())).alias("attempt", "url"))


@query("a4_homepage")
def _(spark, sf):
    return homes(spark, sf).select("website", "url", "company_name", "error")


@query("a5_result_cards")
def _(spark, sf):
    return S.result_cards(view(spark, sf, "listings"), 20).select(
        "location_ord", "card_ord", "maps_url", "card_name"
    )


@query("a6_searches")
def _(spark, sf):
    queue = table(spark, sf, "nation").select(
        c("n_nationkey").alias("location_ord"), F.concat(c("n_name"), lit(" ~*é ")).alias("search_location")
    )
    return S.searches(queue, "web design & more").select("location_ord", "search")


def _sheets(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf, "listings")
    accepted = rows.filter(c("location_ord") < 12).select(
        c("maps_url").alias("Maps"), c("business_name").alias(" Business Name"), c("website").alias("Site")
    )
    rejected = rows.filter(c("location_ord") >= 12).select(
        c("website").alias("Website"), c("business_name").alias("Company Name"), lit("x").alias("Reject Reason")
    )
    return accepted, rejected


@query("a8_ledger_load")
def _(spark, sf):
    return L.ledger_of(*_sheets(spark, sf))


@query("a8_ledger_load_by_position")
def _(spark, sf):
    return L.ledger_of(*_sheets(spark, sf), by_position=True)


@query("a9_ledger_sites")
def _(spark, sf):
    return known(spark, sf)


@query("a11_cells")
def _(spark, sf):
    return cells(
        view(spark, sf, "listings").select(
            "listing_id", "location_ord", F.split(F.trim(c("business_name")), " ").alias("words"),
            (c("listing_id") % 2 == 0).alias("even"), F.nullif(c("website"), lit("")).alias("website"),
        )
    )


@query("a12_header_growth")
def _(spark, sf):
    rows = view(spark, sf, "listings")
    old = rows.filter(c("location_ord") < 12).select(c("business_name").alias("Company Name"), c("website").alias("Website"))
    new = rows.filter(c("location_ord") >= 12).select(c("website").alias("Website "), c("maps_url").alias("Map"))
    return grown(old, new).select(
        c("Company Name").alias("company_name"), c("Website").alias("website"), c("Map").alias("map")
    )


@query("a13_legacy_rows")
def _(spark, sf):
    rows = O.legacy_rows(O.batch_values(leads(spark, sf)))
    return rows.toDF("company_name", "website", "company_email", "location", "services")


@query("a12_replayed_append")
def _(spark, sf):
    """Two runs append to one table, the second one after an early end with other rows, and both are repeated."""
    path, rows = _output(spark), view(spark, sf, "listings")
    first = rows.filter(c("location_ord") < 12).select(c("business_name").alias("company_name"), "website")
    second = rows.filter(c("location_ord") >= 12).select("website", c("maps_url").alias(" map "))
    for run_id, part in (("one", first), ("two", second.limit(3)), ("two", second), ("one", first)):
        append_rows(part, path, run_id)
    return read_rows(spark, path)


@query("a14_rejected")
def _(spark, sf):
    rows = O.rejected_rows(batch(spark, sf).routed, REQUIRED, "listing_id")
    return rows.toDF("listing_id", "company_name", "website", "company_email", "services", "town", "nothing", "reject_reason")


@query("a15_rejected_minimal")
def _(spark, sf):
    rows = O.rejected_minimal(batch(spark, sf).routed).drop("Date Added")
    return rows.toDF("business_name", "website", "search_location", "reject_reason")


@query("a17_record_json")
def _(spark, sf):
    return R.record_json(records(spark, sf))


# --- page parse ---------------------------------------------------------------------------


@query("b1_tokens")
def _(spark, sf):
    return page_tokens(view(spark, sf, "lead_pages"))


@query("b2_visible_text")
def _(spark, sf):
    return parsed(spark, sf, "text", "text_parts").select("page_id", F.size("text_parts").alias("parts"), "text")


@query("b3_text_parts")
def _(spark, sf):
    return parsed(spark, sf, "text_parts").select("page_id", F.posexplode("text_parts").alias("pos", "part"))


@query("b4_unescape")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", unescape(unescape(c("html"))).alias("html"))


@query("b5_nav_links")
def _(spark, sf):
    return parsed(spark, sf, "links").select(
        "page_id", F.size(F.filter("links", lambda a: a["in_nav"])).alias("in_nav"), F.size("links").alias("links")
    )


@query("b6_links")
def _(spark, sf):
    return (
        parsed(spark, sf, "links")
        .select("page_id", F.posexplode("links").alias("pos", "link"))
        .select("page_id", "pos", "link.href", "link.text", "link.in_nav")
    )


@query("b7_meta")
def _(spark, sf):
    return (
        parsed(spark, sf, "meta")
        .select("page_id", F.posexplode("meta").alias("pos", "entry"))
        .select("page_id", "pos", "entry.key", "entry.content")
    )


_on("b8_title", "parsed:title", "page_id", "title")


@query("b9_elements")
def _(spark, sf):
    return (
        parsed(spark, sf, "elements")
        .select("page_id", F.posexplode("elements").alias("pos", "element"))
        .select("page_id", "pos", "element.tag", "element.text")
    )


@query("b10_attributes")
def _(spark, sf):
    tags = page_tokens(view(spark, sf, "lead_pages")).filter(c("token").rlike(r"(?i)^<[a-z]"))
    return tags.select("page_id", "pos", text_of(attributes(c("token"), "href", "name", "content")).alias("attributes"))


# --- scalar functions ---------------------------------------------------------------------

_on("c1_squash", "documents", "doc_id", lambda: T.squash(F.concat(lit(" \t"), F.replace(c("text"), lit(", "), lit(", \n")))).alias("text"))
_on(
    "c2_cells", "documents", "doc_id",
    lambda: joined(F.when(c("doc_id") % 7 != 0, F.split(c("text"), " "))).alias("cell"),
)
_on("c3_clean_text", "listings", "listing_id", lambda: T.clean_text(F.when(c("location_ord") != 3, c("business_name"))).alias("name"))
_on("c4_website_key", "pages", "page_id", lambda: U.website_key(_raw_url()).alias("site"))


@query("c5_clean_email")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    found = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return found.select("doc_id", "pos", T.clean_email(F.concat(lit("mailto: .,"), c("word"), lit(";:"))).alias("email"))


_on(
    "c6_clean_company_name", "documents", "doc_id",
    lambda: T.clean_company_name(F.concat(c("text"), lit("  :: "), c("lang"), lit(" | "), c("source"), lit(" - x"))).alias("name"),
)
_on("c7_deobfuscate", "documents", "doc_id", lambda: T.deobfuscate(F.concat(c("text"), lit(" a [ AT ] b (dot) c At d"))).alias("text"))
_on("c8_normalize_label", "documents", "doc_id", lambda: T.normalize_label(F.concat(lit(" -: Learn More "), c("text"), lit(" more |"))).alias("label"))


def _other_url() -> Column:
    host = F.regexp_extract(c("url"), "^https?://([^/?#]+)", 1)
    return (
        F.when(c("page_id") % 4 == 0, F.concat(lit("//WWW."), F.upper(host), lit("/a b?x")))
        .when(c("page_id") % 4 == 1, F.concat(lit("https://"), host, lit(":443/")))
        .when(c("page_id") % 4 == 2, lit("/only/path"))
        .otherwise(F.concat(lit("ftp://"), host, lit("#f")))
    )


_on("c9_same_site", "pages", "page_id", lambda: U.same_site(c("url"), _other_url()).alias("same"))

HREFS = (
    "x", "./x/../y", "../../../up", "/root/./a//b", "?q=1", "#f", "", "//other.test/p?x#y", "mailto:a@b.c",
    "tel:+1 2", "javascript:void(0)", "a b/c", "x/..", "https://abs.test", "HTTP://Abs.test/a/../b", "ftp://f/x", ".", "/..",
)


@query("c10_resolve_url")
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.explode(string_array(*HREFS)).alias("href"))
    return pages.select("page_id", "href", U.resolve_url(c("url"), c("href")).alias("resolved"))


_on(
    "c11_host_label", "pages", "page_id",
    lambda: U.host_name_label(F.when(c("page_id") % 3 == 0, c("url")).when(c("page_id") % 3 == 1, F.regexp_replace(c("url"), "://", "://www.o'neil-3COM-")).otherwise(lit("/no/host"))).alias("name"),
)
_on(
    "c12_facebook_about", "pages", "page_id",
    lambda: U.facebook_about_url(F.when(c("page_id") % 5 != 0, F.concat(lit(" "), c("url"), lit("/?x#y/ "))).otherwise(lit(""))).alias("about"),
)


@query("c13_linkedin_candidates")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.posexplode(U.linkedin_candidates(F.concat(c("url"), lit("// ")))).alias("pos", "url"))


_on("c14_contact_guess", "pages", "page_id", lambda: U.contact_guess(c("url")).alias("url"))
_on("c15_name_key", "listings", "listing_id", lambda: T.name_key(c("business_name")).alias("key"))
_on("c16_elapsed", "orders", "o_orderkey", lambda: T.elapsed((c("o_orderkey") % 4000).cast("double") + 0.5).alias("elapsed"))
_on(
    "c17_stamp", "events", "event_id",
    lambda: T.stamp(c("ts")).alias("at_second"), lambda: T.stamp(c("ts"), minutes_only=True).alias("at_minute"),
)

# --- extractors ---------------------------------------------------------------------------

_on("e1_emails", "parsed:text,links", "page_id", "url", lambda: text_of(E.emails(c("text"), c("links"))).alias("emails"))
_on("e2_loose_emails", "parsed:plain_text,hrefs", "page_id", lambda: text_of(E.loose_emails(E.loose_matches(c("plain_text")), c("hrefs"))).alias("emails"))
_on("e3_first_email", "parsed:plain_text", "page_id", lambda: E.first_email(E.loose_matches(c("plain_text"))).alias("email"))
_on("e4_phones", "parsed:text,links", "page_id", lambda: text_of(E.phones(c("text"), c("links"))).alias("phones"))
_on("e5_location", "parsed:text,text_parts,meta", "page_id", lambda: E.location(c("meta"), c("text_parts"), c("text")).alias("location"))
_on(
    "e6_location_chunks", "documents", "doc_id",
    lambda: E.location(F.array().cast("array<struct<key:string,content:string>>"), string_array(), F.concat(c("text"), lit("; No. "), c("doc_id").cast("string"), lit(" Floor 3|x"))).alias("location"),
)


@query("e7_socials")
def _(spark, sf):
    profiles = parsed(spark, sf, "links").select("page_id", E.socials(E.resolved_links(c("url"), c("links"))).alias("s"))
    return profiles.select("page_id", *[E.social(c("s"), n).alias(n) for n in P.NETWORKS])


_on("e8_company_name", "parsed:title,meta,elements", "page_id", lambda: E.company_name(c("url"), c("title"), c("meta"), c("elements")).alias("name"))
_on("e9_contact_links", "parsed:links", "page_id", lambda: text_of(E.contact_links(c("url"), E.resolved_links(c("url"), c("links")))).alias("contacts"))
_on("e10_nav_labels", "parsed:links", "page_id", lambda: text_of(E.nav_labels(c("links"))).alias("labels"))
_on("e11_section_labels", "parsed:elements", "page_id", lambda: text_of(E.section_labels(c("elements"))).alias("labels"))
_on("e12_heading_labels", "parsed:elements", "page_id", lambda: text_of(E.heading_labels(c("elements"))).alias("labels"))
_on("e13_services", "parsed:links,elements", "page_id", lambda: text_of(E.services(c("links"), c("elements"))).alias("services"))
_on("e14_unique_ignoring_case", "documents", "doc_id", lambda: joined(unique_ignoring_case(F.split(c("text"), " ")), " ").alias("words"))


@query("e15_all_socials")
def _(spark, sf):
    profiles = parsed(spark, sf, "links").select("page_id", E.socials(E.resolved_links(c("url"), c("links"))).alias("s"))
    return profiles.select(
        "page_id",
        E.discovered_socials(c("s")).alias("discovered"),
        E.exported_socials(*[E.social(c("s"), n) for n in P.NETWORKS]).alias("exported"),
    )


_on(
    "e16_rating", "listings", "listing_id",
    lambda: S.rating(F.array(F.concat(lit("1,2"), c("review_label")), c("rating_label")), F.concat(lit("Rated "), c("rating_label"))).alias("rating"),
)
_on("e17_review_count", "listings", "listing_id", lambda: S.review_count(F.when(c("location_ord") % 2 == 0, c("review_label")), lit("no review"), F.concat(c("rating_label"), c("review_label"))).alias("reviews"))
_on("e18_website_link", "listings", "listing_id", lambda: S.website_link(F.concat(lit("/url?q="), c("website")), c("website"), c("maps_url")).alias("website"))

# --- predicates ---------------------------------------------------------------------------


def _document_words(spark, sf) -> DataFrame:
    """Labels of a few words from the texts, next to hint words."""
    docs = table(spark, sf, "documents")
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "label"))
    label = F.when(c("pos") % 3 == 0, c("label")).when(c("pos") % 3 == 1, F.concat(lit("SEO "), c("label"))).otherwise(
        F.concat(lit("Discover "), c("label"), lit(" social?"))
    )
    return parts.select("doc_id", "pos", label.alias("label"))


@query("f1_service_hint")
def _(spark, sf):
    return _document_words(spark, sf).filter(F_.is_service_hint(c("label"))).select("doc_id", "pos")


@query("f2_reads_like_service")
def _(spark, sf):
    return _document_words(spark, sf).filter(F_.reads_like_service(c("label"))).select("doc_id", "pos")


@query("f3_likely_service")
def _(spark, sf):
    return _document_words(spark, sf).filter(F_.is_likely_service(c("label"))).select("doc_id", "pos")


@query("f4_has_website")
def _(spark, sf):
    return view(spark, sf, "listings").filter(F_.has_website(c("website"))).select("listing_id", "website")


@query("f5_required_scraped")
def _(spark, sf):
    specs = (*REQUIRED, O.ColumnSpec("Map", "maps_url", required=True))
    return O.route(leads(spark, sf), specs, mode="scraped").select("listing_id", text_of(c("missing")).alias("missing"))


@query("f5_required_exported")
def _(spark, sf):
    specs = (*REQUIRED, O.ColumnSpec("Map", "maps_url", required=True), O.ColumnSpec("R", "rating", required=True))
    return O.route(leads(spark, sf), specs).select("listing_id", text_of(c("missing")).alias("missing"))


@query("f6_required_simple")
def _(spark, sf):
    return O.route(leads(spark, sf), REQUIRED_SIMPLE, mode="simple").select("listing_id", "reject_reason")


@query("f7_counts_as_email")
def _(spark, sf):
    return leads(spark, sf).groupBy("location_ord").agg(F.count_if(F_.counts_as_email(c("email"))).alias("emails"))


@query("f8_login_wall")
def _(spark, sf):
    pages = view(spark, sf, "web_pages")
    return pages.select(
        "page_id",
        F_.is_login_wall(c("final_url"), "login", "authwall").alias("walled"),
        F_.is_verification_page(c("final_url"), c("html")).alias("verification"),
    )


# --- joins --------------------------------------------------------------------------------


@query("j1_homepages")
def _(spark, sf):
    return homes(spark, sf).select("website", text_of(c("emails")).alias("emails"), text_of(c("contact_links")).alias("contacts"))


@query("j2_contact_pages")
def _(spark, sf):
    found = R.contact_pages(homes(spark, sf), facts(spark, sf), P.CONTACT_PAGES)
    return found.select("website", "place", "url", text_of(c("emails")).alias("emails"))


@query("j3_social_fallback")
def _(spark, sf):
    return records(spark, sf).select("website", text_of(c("email")).alias("email"))


@query("j4_enrich")
def _(spark, sf):
    rows = O.enrich(collected(spark, sf), records(spark, sf))
    return rows.select("listing_id", "rating", "review_count", *O.SCRAPED_FIELDS, "error")


@query("j5_new_cards")
def _(spark, sf):
    cards = S.result_cards(view(spark, sf, "listings"))
    return L.exclude_processed_cards(cards, known(spark, sf)).select("listing_id", "card_name")


@query("j6_new_leads")
def _(spark, sf):
    return fresh(spark, sf).select("listing_id", "business_name", "website")


@query("j7_reused_scrapes")
def _(spark, sf):
    rows = collected(spark, sf)
    scraped = rows.filter(c("location_ord") < 12).groupBy(U.site_key(c("website")).alias("site")).agg(F.max_by("website", "card_ord").alias("record_website"))
    marked = mark_reused(rows.filter(c("location_ord") >= 12), scraped)
    return marked.select("listing_id", "is_fresh", "record_website")


@query("j8_email_cascade")
def _(spark, sf):
    return R.email_cascade(view(spark, sf, "businesses"), facts(spark, sf))


# --- aggregations -------------------------------------------------------------------------


@query("g1_categories")
def _(spark, sf):
    labels = _document_words(spark, sf).groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels")
    )
    return labels.select("doc_id", text_of(E.categorize(c("labels"))).alias("categories"))


@query("g2_contact_fold")
def _(spark, sf):
    h = homes(spark, sf)
    folded = R.fold_contacts(h, R.contact_pages(h, facts(spark, sf), P.CONTACT_PAGES))
    return folded.select(
        "website",
        text_of(c("email")).alias("email"),
        text_of(c("services")).alias("services"),
        text_of(c("phone")).alias("phone"),
        "location",
        E.discovered_socials(c("socials")).alias("socials"),
    )


@query("g3_location_counters")
def _(spark, sf):
    return batch(spark, sf).counters


@query("g4_summary")
def _(spark, sf):
    return batch(spark, sf).summary


@query("g5_skip_counts")
def _(spark, sf):
    return Y.skip_counts(collected(spark, sf), fresh(spark, sf))


@query("g6_sorted_set")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(sorted_set(F.split("text", " ")), " ").alias("words"))


# --- order and top-k ----------------------------------------------------------------------


@query("w1_dedup")
def _(spark, sf):
    return dedup_leads(collected(spark, sf), ["location_ord", "card_ord"]).select(
        "listing_id", "business_name", "website"
    )


@query("w1_dedup_by_components")
def _(spark, sf):
    """The same without the walk of the whole rest in one task, and with small components only."""
    return dedup_leads(collected(spark, sf), ["location_ord", "card_ord"], local_rows=0, component_rows=5).select(
        "listing_id", "business_name", "website"
    )


@query("w2_first_cards")
def _(spark, sf):
    return S.result_cards(view(spark, sf, "listings"), 5).select("location_ord", "listing_id")


_on("w3_first_contacts", "parsed:links", "page_id", lambda: text_of(F.slice(E.contact_links(c("url"), E.resolved_links(c("url"), c("links"))), 1, P.CONTACT_PAGES)).alias("contacts"))
_on(
    "w4_first_match", "parsed:plain_text,links", "page_id",
    lambda: E.social(E.socials(E.resolved_links(c("url"), c("links"))), "twitter").alias("twitter"),
    lambda: E.first_email(E.loose_matches(c("plain_text"))).alias("email"),
)
_on("w5_sorted_fields", "parsed:text,links", "page_id", lambda: text_of(E.emails(c("text"), c("links"))).alias("emails"), lambda: text_of(E.phones(c("text"), c("links"))).alias("phones"))
_on("w6_running_state", "parsed:text_parts,elements", "page_id", lambda: F.size(E.section_labels(c("elements"))).alias("in_section"), lambda: F.size("text_parts").alias("visible"))


@query("w7_lead_order")
def _(spark, sf):
    return kept(spark, sf).select("location_ord", "card_ord", "listing_id")


@query("w8_column_order")
def _(spark, sf):
    rows = O.sheet_rows(O.batch_values(leads(spark, sf)), REQUIRED, "listing_id")
    order = lit(",".join(rows.columns)).alias("headers")
    return rows.select("listing_id", order, F.concat_ws("|", *[c(f"`{h}`") for h in rows.columns[1:]]).alias("row"))


@query("j1_kept_facts")
def _(spark, sf):
    """Facts after a second run in which one page in a hundred has changed: only those are parsed."""
    path, pages = _output(spark), view(spark, sf, "lead_pages")
    before = F.when(c("page_id") % 100 == 0, F.concat(lit("<p>old@example.org</p>"), "html")).otherwise(c("html"))
    R.refreshed_facts(pages.withColumn("html", before), path)
    return R.refreshed_facts(pages, path).select("page_id", text_of(c("emails")).alias("emails"), "parsed")


# --- projections and routing --------------------------------------------------------------


@query("p1_ledger_union")
def _(spark, sf):
    accepted, rejected = _sheets(spark, sf)
    return L.normalized(L.ledger_of(accepted, rejected)).groupBy("kind").agg(F.count(lit(1)).alias("keys"))


@query("p2_reused_then_fresh")
def _(spark, sf):
    marked = QUERIES["j7_reused_scrapes"](spark, sf)
    rows = marked.join(collected(spark, sf).select("listing_id", "location_ord", "card_ord"), "listing_id")
    return rows.select("listing_id", "location_ord", F.format_string("%d-%012d", "is_fresh", "card_ord").alias("position"))


_on(
    "p3_mailto_union", "parsed:plain_text,hrefs", "page_id",
    lambda: F.size(E.loose_emails(E.loose_matches(c("plain_text")), c("hrefs"))).alias("both"),
    lambda: F.size(E.loose_emails(string_array(), c("hrefs"))).alias("mailto"),
)


@query("p4_ledger_growth")
def _(spark, sf):
    return L.growth(kept(spark, sf))


@query("p5_batch_values")
def _(spark, sf):
    return O.batch_values(leads(spark, sf)).drop("location_ord", "card_ord")


@query("p6_simple_values")
def _(spark, sf):
    rows = O.enrich(fresh(spark, sf), records(spark, sf), with_timestamp=True)
    return O.simple_values(rows).drop("location_ord", "card_ord")


@query("p7_sheet_rows")
def _(spark, sf):
    rows = O.sheet_rows(O.batch_values(leads(spark, sf)), REQUIRED, "listing_id")
    return rows.toDF("listing_id", "company_name", "website", "company_email", "services", "town", "nothing")


@query("p8_routing")
def _(spark, sf):
    return batch(spark, sf).routed.select("listing_id", "reject_reason")


@query("p9_error_rows")
def _(spark, sf):
    return leads(spark, sf).filter(c("error") != "").select("listing_id", *O.SCRAPED_FIELDS, "error")


@query("p10_collect_only")
def _(spark, sf):
    return skip_scrape(view(spark, sf, "listings"), ledger=known(spark, sf))


@query("p10_homepage_only")
def _(spark, sf):
    rows = R.company_records(sites(spark, sf), facts(spark, sf), include_contacts=False)
    return rows.select("website", "company_name", text_of(c("email")).alias("email"), text_of(c("phone")).alias("phone"))


@query("p10_single_location")
def _(spark, sf):
    one = view(spark, sf, "listings")
    rows = run_single_location(one, facts(spark, sf), REQUIRED_SIMPLE)
    return rows.select("listing_id", "company_name", "email", "location")


@query("p11_overrides")
def _(spark, sf):
    values = O.batch_values(leads(spark, sf)).select("listing_id", *[f for f in O.BATCH_FIELDS if f in O.SCRAPED_FIELDS or f in ("source_url", "all_socials")])
    edits = view(spark, sf, "listings").filter(c("location_ord") % 2 == 0).select(
        "listing_id",
        F.when(c("location_ord") % 4 == 0, F.concat(lit(" edited "), c("listing_id").cast("string"))).alias("company_name"),
        lit("").alias("email"),
    )
    return O.apply_overrides(values, edits)


# --- memory -------------------------------------------------------------------------------


@query("t2_second_run")
def _(spark, sf):
    """Leads of the second half of the queue, after a run over the first half."""
    rows = collected(spark, sf)
    first = dedup_leads(rows.filter(c("location_ord") < 12), ["location_ord", "card_ord"])
    second = L.exclude_processed(rows.filter(c("location_ord") >= 12), cut_lineage(L.growth(first)))
    return dedup_leads(second, ["location_ord", "card_ord"]).select("listing_id", "location_ord")


def _chained_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of seven locations that often show another name than their page, with chains that lose sites to one name."""
    cards = view(spark, sf, "listings").withColumn("location_ord", (c("location_ord") % 7).cast("int"))
    other = F.concat(lit("Biz "), (c("listing_id") * 11 % 400).cast("string"))
    cards = cards.withColumn("card_text", F.when(c("listing_id") % 5 == 0, other).otherwise(c("card_text")))
    chain = F.concat(lit("Chain "), c("location_ord").cast("string"), lit("-"), (c("listing_id") % 4).cast("string"))
    return cards.withColumn("business_name", F.when(c("listing_id") % 3 == 0, chain).otherwise(c("business_name")))


@query("t1_batch_by_location")
def _(spark, sf):
    result = run_batch(_chained_cards(spark, sf), facts(spark, sf), view(spark, sf, "ledger"), REQUIRED)
    return result.routed.select("listing_id", "location_ord", "email", "reject_reason")


@query("t1_batch_by_components")
def _(spark, sf):
    """The same batch without the walk of a whole queue in one task: rounds, then components with a wrong guess."""
    result = run_batch(_chained_cards(spark, sf), facts(spark, sf), view(spark, sf, "ledger"), REQUIRED, local_rows=0)
    return result.routed.select("listing_id", "location_ord", "email", "reject_reason")


def _micro_batches(spark: SparkSession, sf: str) -> str:
    """The folder of a run over the same cards in three micro-batches of whole locations, the second one replayed."""

    def build() -> str:
        root, cards = _output(spark), cut_lineage(_chained_cards(spark, sf))
        start = {"start_ledger": view(spark, sf, "ledger"), "buckets": 8, "most_parts": 1}
        for batch_id in (0, 1, 1, 2):
            process_batch(cards.filter(F.floor(c("location_ord") / 3) == batch_id), batch_id, facts(spark, sf), root, REQUIRED, **start)
        return root

    return _once(spark, sf, "micro_batches", build)


@query("t1_micro_batches_by_location")
def _(spark, sf):
    """Leads of the micro-batches: scrapes and the ledger are remembered from one to the next."""
    root = _micro_batches(spark, sf)
    accepted, rejected = (read_table(spark, root, t) for t in ("accepted", "rejected"))
    rows = accepted.withColumn("Reject Reason", lit(None).cast("string")).unionByName(rejected)
    return rows.select("listing_id", "location_ord", c("batch_id").cast("int").alias("batch_id"), c("`Company Email`").alias("email"), c("`Reject Reason`").alias("reject_reason"))


@query("g4_micro_batch_summary")
def _(spark, sf):
    """The summary that the last of the micro-batches leaves, without its times."""
    return read_rows(spark, f"{_micro_batches(spark, sf)}/summary").filter(~c("label").isin("Time Generated", "Date Run"))


@query("t3_failed_locations")
def _(spark, sf):
    """One micro-batch in which a location throws (a position that is no number), and one has cards without an address."""
    cards = _chained_cards(spark, sf).withColumn("position", F.when((c("location_ord") == 2) & (c("listing_id") % 7 == 0), "n/a").otherwise(c("card_ord").cast("string")))
    cards = cards.withColumn("maps_url", F.when(~((c("location_ord") == 5) & (c("listing_id") % 5 == 0)), c("maps_url")))
    root = _output(spark)
    process_batch(cards.withColumn("card_ord", c("position").cast("long")).drop("position"), 0, facts(spark, sf), root, REQUIRED, start_ledger=view(spark, sf, "ledger"), buckets=8)
    handled = [read_table(spark, root, t).select("location_ord", "listing_id", lit("handled").alias("outcome")) for t in ("accepted", "rejected")]
    failed = read_table(spark, root, "failed").select("location_ord", lit(None).cast("long").alias("listing_id"), lit("failed").alias("outcome"))
    return handled[0].unionByName(handled[1]).unionByName(failed)


def _output(spark: SparkSession) -> str:
    """A new folder for what a query writes and reads back."""
    return f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"


@query("a7_leads_csv")
def _(spark, sf):
    path = _output(spark)
    write_csv(cells(view(spark, sf, "listings").select("listing_id", "business_name", "card_text", "website")), path)
    rows = read_leads_csv(spark, path)
    return rows.select(*[F.coalesce(n, lit("")).alias(n) for n in rows.columns])


@query("a10_results_table")
def _(spark, sf):
    path = _output(spark)
    write_results(view(spark, sf, "listings").select("listing_id", "location_ord", "maps_url"), path)
    return read_rows(spark, path)


@query("a16_summary_table")
def _(spark, sf):
    path = _output(spark)
    write_summary(batch(spark, sf).summary, path)
    return read_rows(spark, path)


@query("t1_two_batches")
def _(spark, sf):
    """Leads that two micro-batches handle, the second one against the ledger of the first."""
    root, rows = _output(spark), view(spark, sf, "listings")
    for batch_id, half in enumerate((c("location_ord") < 12, c("location_ord") >= 12)):
        process_batch(rows.filter(half), batch_id, facts(spark, sf), root, REQUIRED, buckets=8)
    handled = [read_table(spark, root, t).select("listing_id", "location_ord", "batch_id") for t in ("accepted", "rejected")]
    return handled[0].unionByName(handled[1]).withColumn("batch_id", c("batch_id").cast("int"))
