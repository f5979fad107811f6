"""Dedup, ledger, batch runs and micro-batches against plain loops over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators.dedup import dedup_leads, kept_positions
from leadloom.operators.joins import Pieces, cut_lineage
from leadloom.operators.ledger import exclude_processed, ledger_of, normalized
from leadloom.operators.listings import collect_listings, result_cards
from leadloom.operators.records import facts_by_url
from leadloom.operators.routing import ColumnSpec, accepted_rows, apply_overrides, column_map, rejected_rows
from leadloom.plans.batch import kept_leads, run_batch, run_single_location

LISTING = (
    "listing_id long, location_ord int, search_location string, card_ord long, maps_url string, card_text string,"
    " business_name string, website string, rating_label string, review_label string"
)


def site(url):
    url = url.strip().lower()
    for scheme in ("http://", "https://"):
        if url.startswith(scheme):
            url = url[len(scheme) :]
            break
    if url.startswith("www."):
        url = url[4:]
    return url.split("?")[0].split("#")[0].rstrip("/")


def greedy(rows):
    """rows: (order, name, site) in order; the orders that are kept."""
    names, sites, kept = set(), set(), []
    for order, name, web in rows:
        if (name and name in names) or (web and web in sites):
            continue
        kept.append(order)
        names.update([name] if name else [])
        sites.update([web] if web else [])
    return kept


def random_rows(rng, n, names, sites):
    return [
        (i, f"n{rng.randrange(names)}" if rng.random() > 0.1 else "", f"s{rng.randrange(sites)}" if rng.random() > 0.1 else "")
        for i in range(n)
    ]


def dedup(spark, rows, **options):
    df = spark.createDataFrame(rows, "at long, business_name string, website string")
    return sorted(r.at for r in kept_positions(df, ["at"], **options).collect())


@pytest.mark.parametrize("seed,n,names,sites", [(1, 400, 60, 60), (2, 1500, 40, 500), (3, 1500, 700, 700)])
def test_dedup_equals_loop(spark, seed, n, names, sites):
    rows = random_rows(random.Random(seed), n, names, sites)
    assert dedup(spark, rows) == greedy(rows)


def test_dedup_with_one_name_on_a_third_of_the_rows(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if rng.random() < 0.34 else name, web) for i, name, web in random_rows(rng, 1200, 300, 300)]
    rows = [(i, name, "s0" if rng.random() < 0.2 else web) for i, name, web in rows]
    assert dedup(spark, rows) == greedy(rows)


def test_dedup_chain_needs_many_rounds(spark):
    rows = [(i, f"n{(i + 1) // 2}", f"s{i // 2}") for i in range(14)]
    assert dedup(spark, rows) == greedy(rows)


def test_dedup_is_not_first_of_both_groups(spark):
    # b falls to a; c meets only b's name, so it stays although it is not the first with it.
    rows = [(0, "x", "s"), (1, "y", "s"), (2, "y", "t")]
    assert dedup(spark, rows) == [0, 2]


def test_dedup_keeps_all_columns_and_blank_rows(spark):
    df = spark.createDataFrame(
        [(1, " ", "", "p"), (2, "", "", "q"), (3, "A ", "https://www.x.org/", "r"), (4, "b", "x.org?u=1", "s")],
        "at long, business_name string, website string, extra string",
    )
    assert sorted((r.at, r.extra) for r in dedup_leads(df, ["at"]).collect()) == [(1, "p"), (2, "q"), (3, "r")]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_one_key_with_half_the_rows_is_split(spark, how):
    """The joins rely on adaptive execution: with low bounds one key becomes several tasks."""
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
    left = spark.range(0, 400_000, 1, 16).select(key.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    right = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).alias("value"))
    if how != "left_anti":
        right = right.unionByName(spark.createDataFrame([("hot", 2)], "key string, value int"))
    bounds = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in bounds}
    for name, value in bounds.items():
        spark.conf.set(name, value)
    try:
        joined = cut_lineage(left.join(right, "key", how))
        assert joined.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
        if how != "left_anti":
            assert joined.filter("key = 'hot'").count() == 200_000
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_ledger_anti_join_is_not_a_nested_loop(spark):
    leads = spark.createDataFrame([("a", "b.org")], "business_name string, website string")
    ledger = spark.createDataFrame([("name", "z")], "kind string, key string")
    plan = exclude_processed(leads, ledger)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ledger_columns(spark):
    accepted = spark.createDataFrame([("m", " Ann ", " WWW.A.org/ "), ("m", " ", None)], "Map string, `Business Name` string, Web string")
    rejected = spark.createDataFrame([("B.org", "Bob"), ("", "")], "Website string, `Company Name` string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ledger_of(accepted, rejected)) == [("name", "ann"), ("name", "bob"), ("site", "b.org"), ("site", "www.a.org/")]
    assert ("name", "b.org") in rows(ledger_of(accepted, rejected, by_position=True))
    assert ("site", "a.org") in rows(normalized(ledger_of(accepted, None)))
    one_column = spark.createDataFrame([("Cy",)], "x string")
    assert rows(ledger_of(one_column, None)) == [("name", "cy")]


# --- batch --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def facts(spark):
    pages = [
        (i, f"https://s{i}.org", f"<title>Site {i}</title>" + (f"<p>m{i}@s{i}.org</p>" if i % 2 else "<p>none</p>"))
        for i in range(12)
    ]
    # One more spelling of a site, to see whose record a reused scrape brings.
    pages.append((50, "https://www.s3.org/", "<title>Other three</title><p>other@s3.org</p>"))
    return facts_by_url(spark.createDataFrame(pages, "page_id long, url string, html string")).cache()


def listing_rows(seed, n=70, locations=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        number = rng.randrange(14)  # sites 12 and 13 have no page
        spelling = rng.choice(["https://s{}.org", "https://www.s{}.org/"]) if number == 3 else "https://s{}.org"
        name = f"Firm {rng.randrange(25)}" if rng.random() > 0.08 else ""
        card = name if rng.random() > 0.25 else f"Firm {rng.randrange(25)}"
        rows.append(
            (i, i * locations // n, f"Town {i * locations // n}", i, f"https://maps.example/{i}", card, name,
             spelling.format(number) if rng.random() > 0.05 else "", "4.5 stars", "10 reviews")
        )
    return rows


PAGES = {f"https://s{i}.org": (f"Site {i}", f"m{i}@s{i}.org" if i % 2 else "") for i in range(12)}
PAGES["https://www.s3.org/"] = ("Other three", "other@s3.org")


def plain_batch(rows, names, sites):
    """The batch as a loop: one location after the other, reused scrapes first."""
    names, sites, cache, leads, counters = set(names), set(sites), {}, {}, {}
    for location in sorted({r[1] for r in rows}):
        found = [r for r in rows if r[1] == location and r[7]]
        known = lambda name: name != "" and name.lower() in names
        new = [r for r in found if not known(r[5]) and not known(r[6]) and site(r[7]) not in sites]
        hits = [(r, cache[site(r[7])], "") for r in new if site(r[7]) in cache]
        scraped = []
        for r in new:
            if site(r[7]) not in cache:
                page = PAGES.get(r[7])
                scraped.append((r, page or ("", ""), "" if page else f"no page for {r[7]}"))
        for r, record, _ in scraped:
            cache[site(r[7])] = record
        order = hits + scraped
        kept = greedy([(i, x[0][6].lower(), site(x[0][7])) for i, x in enumerate(order)])
        for i in kept:
            r, (company, email), error = order[i]
            leads[r[0]] = (company, email, error)
            names.update([r[6].lower()] if r[6] else [])
            sites.add(site(r[7]))
        counters[location] = (len(order), len(kept))
    return leads, counters


COLUMNS = [ColumnSpec("Name", "maps_business_name"), ColumnSpec("Mail", "email", required=True), ColumnSpec("Site", "source_url")]


@pytest.mark.parametrize("seed,locations", [(11, 3), (12, 3), (13, 8), (14, 14)])
def test_batch_by_location_equals_loop(spark, facts, seed, locations):
    rows = listing_rows(seed, locations=locations)
    listings = spark.createDataFrame(rows, LISTING)
    ledger = spark.createDataFrame([("name", "firm 3"), ("site", "http://www.s5.org/#x")], "kind string, key string")
    result = run_batch(listings, facts, ledger, COLUMNS)
    expected, counters = plain_batch(rows, {"firm 3"}, {"s5.org"})
    got = {r.listing_id: (r.company_name, r.email, r.error) for r in result.routed.collect()}
    assert got == expected
    reasons = {r.listing_id: r.reject_reason for r in result.routed.collect()}
    assert reasons == {k: None if v[1] else "Missing Required Field(s): email" for k, v in expected.items()}
    for r in result.counters.collect():
        assert (r.scraped, r.after_dedup) == counters[r.location_ord]
    qualified = sum(1 for v in expected.values() if v[1])
    summary = {r.label: r.value for r in result.summary.collect()}
    assert summary["Qualified Leads"] == str(qualified)
    assert summary["Companies Found"] == str(sum(c[0] for c in counters.values()))
    assert accepted_rows(result.routed, COLUMNS).columns == ["Name", "Mail", "Site"]
    assert rejected_rows(result.routed, COLUMNS).count() == len(expected) - qualified


def test_reused_scrapes_move_to_the_front(spark, facts):
    """Location 0 drops b by its name, so its site is scraped but not kept; in location 1 it comes first."""
    rows = [
        (0, 0, "T0", 0, "m0", "A", "A", "https://s1.org", "", ""),
        (1, 0, "T0", 1, "m1", "A", "A", "https://s2.org", "", ""),
        (2, 1, "T1", 2, "m2", "C", "C", "https://s4.org", "", ""),
        (3, 1, "T1", 3, "m3", "C", "C", "https://s2.org", "", ""),
    ]
    listings = spark.createDataFrame(rows, LISTING)
    ids = lambda order: sorted(r.listing_id for r in run_batch(listings, facts, None, COLUMNS, order=order).routed.collect())
    assert ids("by_location") == [0, 3]
    assert ids("one_pass") == [0, 2]


def test_single_location_run(spark, facts):
    rows = [
        (0, 0, "T", 0, "m0", "A", "A", "https://s1.org", "", ""),
        (1, 0, "T", 1, "m1", "A", "A", "https://s1.org", "", ""),
        (2, 0, "T", 2, "m2", "B", "B", "https://s2.org", "", ""),
    ]
    specs = [ColumnSpec("n", "company_name"), ColumnSpec("e", "email", required=True)]
    got = run_single_location(spark.createDataFrame(rows, LISTING), facts, specs).collect()
    # No dedup here; the site without an email is skipped because of the spelled-out placeholder.
    assert sorted((r.listing_id, r.company_name, r.email, r.location) for r in got) == [
        (0, "Site 1", "m1@s1.org", "T"),
        (1, "Site 1", "m1@s1.org", "T"),
    ]


def test_column_map_rules():
    specs = column_map([ColumnSpec(" A ", "email"), ColumnSpec("", "phone"), ColumnSpec("B", " ")])
    assert specs == [ColumnSpec("A", "email")]
    with pytest.raises(ValueError):
        column_map([ColumnSpec("A", "email"), ColumnSpec("a ", "phone")])


def test_overrides_refuse_empty_rows(spark):
    values = spark.createDataFrame(
        [(1, "x", "", "", "", "", "", "", ""), (2, "y", "", "", "", "", "", "", "")],
        "listing_id long, company_name string, linkedin string, facebook string, instagram string, twitter string,"
        " youtube string, tiktok string, all_socials string",
    )
    edits = spark.createDataFrame([(1, " "), (2, None)], "listing_id long, company_name string")
    assert [(r.listing_id, r.company_name) for r in apply_overrides(values, edits).collect()] == [(2, "y")]


def test_pieces_merge_in_blocks(spark):
    pieces = Pieces(spark.range(0))
    assert pieces.rows().count() == 0
    for i in range(Pieces.BLOCK + 2):
        pieces.add(spark.range(i, i + 1))
    assert len(pieces._merged) == 1 and len(pieces._recent) == 2
    assert sorted(r.id for r in pieces.rows().collect()) == list(range(Pieces.BLOCK + 2))


def test_ranks_are_cut_before_the_shuffle(spark):
    cards = result_cards(spark.createDataFrame(listing_rows(1), LISTING), 5)
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3  # partial and final, for copies and for the first few


def test_number_of_results_is_checked(spark):
    listings = spark.createDataFrame(listing_rows(1), LISTING)
    with pytest.raises(ValueError):
        result_cards(listings, 0)
    assert result_cards(listings, 101).count() == len(listing_rows(1))


def test_card_names_meet_names_of_earlier_locations(spark, facts):
    """The card of location 1 shows the name of a kept lead, its page another one."""
    rows = [
        (0, 0, "T0", 0, "m0", "Acme", "Acme", "https://s1.org", "", ""),
        (1, 1, "T1", 1, "m1", "Acme", "Acme Berlin", "https://s2.org", "", ""),
        (2, 1, "T1", 2, "m2", "Other", "Other", "https://s4.org", "", ""),
        (3, 1, "T1", 3, "m3", "Other", "Other Berlin", "https://s5.org", "", ""),  # same location: not yet known
    ]
    kept = run_batch(spark.createDataFrame(rows, LISTING), facts, None, COLUMNS).routed.collect()
    assert sorted(r.listing_id for r in kept) == [0, 2, 3]


def test_jobs_do_not_grow_with_the_queue(spark, facts):
    def jobs(locations):
        rows = [
            (i, i % locations, "T", i, f"m{i}", f"N{i}", f"N{i}", f"https://s{i}.org", "", "") for i in range(40)
        ]
        found = cut_lineage(collect_listings(spark.createDataFrame(rows, LISTING)))
        group = f"queue-{locations}"
        spark.sparkContext.setJobGroup(group, group)
        kept = kept_leads(found).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert kept == 40
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    # Adaptive execution starts a few jobs more or less; a loop over locations would start ten times as many.
    assert 0 < jobs(20) < 2 * jobs(2)


def test_names_looked_up_by_leads_without_keys_of_their_own(spark):
    """A lead that only looks a name up goes if an earlier step kept that name, not if its own or a later step did."""
    rows = [(0, 0, "a", "s0", "b"), (1, 0, "", "", "a"), (2, 1, "", "", "a"), (3, 1, "b", "s1", "a"), (4, 2, "b", "s2", "c"), (5, 3, "c", "s2", "b")]
    df = spark.createDataFrame(rows, "at long, step long, business_name string, website string, card string")
    seen = F.nullif("card", F.lit(""))
    kept = kept_positions(df, ["step", "at"], seen_as=seen).collect()
    # 3 falls to a, so 4 keeps b and s2, and 5 falls to both.
    assert sorted(r.at for r in kept) == [0, 1, 4]
