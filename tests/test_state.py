"""What runs leave for later ones: published tables, keyed state, components, remembered scrapes, kept facts."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators.components import component_of
from leadloom.operators.dedup import kept_positions
from leadloom.operators.ledger import LEDGER_SCHEMA, exclude_processed_cards
from leadloom.operators.listings import collect_listings
from leadloom.operators.parse import _codecs, decode_html
from leadloom.operators.records import facts_by_url, facts_of_pages, refreshed_facts
from leadloom.plans import batch
from leadloom.plans.batch import kept_leads, run_batch
from leadloom.sources import tables as T
from leadloom.sources import versions
from leadloom.sources.state import KeyedState
from leadloom.streaming.incremental import process_batch, read_table, totals_before
from tests.test_leads import COLUMNS, LISTING, greedy, listing_rows, plain_batch, random_rows
from tests.test_leads import facts as lead_facts  # noqa: F401 - a fixture


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


# --- published tables -----------------------------------------------------------------------


def test_a_run_that_ends_before_publishing_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    T.write_results(spark.createDataFrame([("old",)], "a string"), path)

    def ended(*_):
        raise RuntimeError("ended")

    with monkeypatch.context() as broken:
        broken.setattr(versions, "_publish", ended)
        with pytest.raises(RuntimeError):
            T.write_results(spark.createDataFrame([("new",)], "a string"), path)
    assert rows(T.read_rows(spark, path)) == [("old",)]
    (tmp_path / "results/_pointers/.draft").write_text('{"parts": {')  # a pointer that was never renamed
    assert rows(T.read_rows(spark, path)) == [("old",)]
    T.write_results(spark.createDataFrame([("new",)], "a string"), path)
    assert rows(T.read_rows(spark, path)) == [("new",)]


def test_repeated_appends_replace_their_rows(spark, tmp_path):
    path = str(tmp_path / "accepted")
    one, two = spark.createDataFrame([("a", "1")], "Name string, Phone string"), spark.createDataFrame([("2", "x")], "`phone ` string, Extra string")
    for run_id, df in (("r1", one), ("r2", two.limit(0)), ("r2", two), ("r1", one)):
        T.append_rows(df, path, run_id)
    got = T.read_rows(spark, path)
    assert got.columns == ["Name", "Phone", "Extra"] and rows(got) == [("", "2", "x"), ("a", "1", "")]
    T.append_rows(one, path)
    T.append_rows(one, path)
    assert T.read_rows(spark, path).count() == 4


def test_vacuum_keeps_what_the_last_versions_need(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(5):
        versions.put(spark.createDataFrame([(i,)], "a int"), path, "x" if i != 1 else "y")
    versions.vacuum(spark, path, keep=2)
    assert rows(versions.read(spark, path)) == [(1,), (4,)]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]) == 3
    assert versions.read(spark, str(tmp_path / "none")) is None


# --- keyed state ----------------------------------------------------------------------------


def keys_of(spark, batch_id, n=40):
    return spark.range(n).select(F.lit("name").alias("kind"), F.concat(F.lit(f"k{batch_id}-"), F.col("id").cast("string")).alias("key"))


def test_lookups_do_not_shuffle_the_state(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "ledger"), "key", LEDGER_SCHEMA, buckets=4)
    for batch_id in range(3):
        state.add(keys_of(spark, batch_id), batch_id)
    cards = spark.createDataFrame([("K1-7", "x", "y.org"), ("", "k0-3", ""), ("", "new", ""), (None, None, None)], "card_name string, business_name string, website string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = exclude_processed_cards(cards, state.before(3))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert rows(left, "business_name") == [("new",), (None,)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Every exchange lies above the scan of the cards, none above a scan of the ledger.
    assert plan.count("Bucketed: true") == 3 and plan.count("Exchange hashpartitioning") == 3
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Bucketed: true" in line:
            depth, above = len(line) - len(line.lstrip(" :|+-")), []
            for upper in reversed(lines[:i]):
                own = len(upper) - len(upper.lstrip(" :|+-"))
                if own < depth:
                    above.append(upper)
                    depth = own
                if "Join" in upper:
                    break
            assert not any("Exchange" in u for u in above)


def test_parts_are_merged_and_replays_see_the_same(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "ledger"), "key", LEDGER_SCHEMA, buckets=4, most_parts=3)
    parts = []
    for batch_id in range(12):
        state.compact(batch_id)
        seen = rows(state.before(batch_id))
        assert len(seen) == 5 * batch_id
        state.add(keys_of(spark, batch_id, 5), batch_id)
        if batch_id % 4 == 2:  # replayed
            assert rows(state.before(batch_id)) == seen
            state.add(keys_of(spark, batch_id, 5), batch_id)
        parts.append(len(versions.live_parts(spark, state.path)))
    assert max(parts) <= state.most_parts + 2
    assert rows(state.before(12)) == rows(spark.createDataFrame([("name", f"k{b}-{i}") for b in range(12) for i in range(5)], LEDGER_SCHEMA))


# --- components and the dedup of long chains ------------------------------------------------


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 600)] + [(700, 700)]
    links += [(1000, i) for i in range(1001, 1400)]  # one node with very many neighbours
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(component_of(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert component_of(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("component_rows", [0, 6, 10_000])
def test_dedup_by_components_equals_loop(spark, component_rows):
    leads = random_rows(random.Random(31), 500, 90, 120) + [(600 + i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(24)]
    df = spark.createDataFrame(leads, "at long, business_name string, website string")
    got = kept_positions(df, ["at"], local_rows=0, component_rows=component_rows)
    assert sorted(r.at for r in got.collect()) == greedy(leads)


def test_a_long_chain_takes_few_jobs(spark):
    n = 100_000
    chain = spark.range(n).select(
        F.col("id").alias("at"), F.format_string("n%d", F.shiftright(F.col("id") + 1, 1)).alias("business_name"), F.format_string("s%d", F.shiftright("id", 1)).alias("website")
    )
    spark.sparkContext.setJobGroup("chain", "chain")
    got = [r.at for r in kept_positions(chain, ["at"], local_rows=0).collect()]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Every lead but the first shares a name or a site with the one before: every other one stays.
    assert sorted(got) == greedy([(i, f"n{(i + 1) // 2}", f"s{i // 2}") for i in range(n)])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 250  # rounds alone: 50,000 times several


@pytest.mark.parametrize(("seed", "component_rows"), [(41, 0), (42, 8), (43, 10_000)])
def test_batch_by_components_equals_loop(spark, lead_facts, seed, component_rows):  # noqa: F811
    leads = listing_rows(seed, locations=9)
    result = run_batch(spark.createDataFrame(leads, LISTING), lead_facts, None, COLUMNS, local_rows=0, component_rows=component_rows)
    expected, _ = plain_batch(leads, (), ())
    assert {r.listing_id: (r.company_name, r.email, r.error) for r in result.routed.collect()} == expected


def test_only_components_with_a_wrong_guess_are_decided_again(spark, monkeypatch):
    reused = [(0, 0, "A", "https://s1.org"), (1, 0, "A", "https://s2.org"), (2, 1, "C", "https://s4.org"), (3, 1, "C", "https://s2.org")]
    others = [(10 + i, i % 3, f"N{i}", f"https://t{i}.org") for i in range(30)]
    leads = [(i, at, f"T{at}", i, f"m{i}", name, name, web, "", "") for i, at, name, web in reused + others]
    walked = []
    plain = batch._walk_locations
    monkeypatch.setattr(batch, "_walk_locations", lambda df: walked.append(rows(df, "listing_id")) or plain(df))
    kept = kept_leads(collect_listings(spark.createDataFrame(leads, LISTING)), local_rows=0)
    assert {r.listing_id for r in kept.collect()} == {0, 3, *range(10, 40)}
    assert walked == [[(0,), (1,), (2,), (3,)]]


# --- micro-batches --------------------------------------------------------------------------


def outcome(spark, root):
    accepted, rejected = read_table(spark, root, "accepted"), read_table(spark, root, "rejected")
    return rows(accepted, "listing_id", "Name", "Mail"), rows(rejected, "listing_id", "Name", "Reject Reason")


def test_micro_batches_equal_one_run_by_location(spark, lead_facts, tmp_path):  # noqa: F811
    """One location each: scrapes are reused across batches, totals add up, a replay in between changes nothing."""
    leads, root = listing_rows(14, locations=5), str(tmp_path / "out")
    one = spark.createDataFrame([("name", "firm 3")], LEDGER_SCHEMA)
    df = spark.createDataFrame(leads, LISTING)
    for at in (0, 1, 2, 2, 3, 4):
        process_batch(df.filter(F.col("location_ord") == at), at, lead_facts, root, COLUMNS, start_ledger=one, buckets=4, most_parts=2)
    whole = run_batch(df, lead_facts, one, COLUMNS)
    routed = whole.routed
    expected = rows(routed.filter("reject_reason IS NULL"), "listing_id", "maps_business_name", "email"), rows(routed.filter("reject_reason IS NOT NULL"), "listing_id", "maps_business_name", "reject_reason")
    assert outcome(spark, root) == expected and all(expected)
    assert rows(read_table(spark, root, "ledger"), "kind", "key") == rows(whole.ledger, "kind", "key")
    summary = {r.label: r.value for r in read_table(spark, root, "summary").collect()}
    assert {r.label: r.value for r in whole.summary.collect()}.items() <= summary.items() and "Time Generated" in summary
    sums = totals_before(spark, root, 5).first()
    assert sums.after_dedup == routed.count() and set(versions.live_parts(spark, f"{root}/totals")) == {"3", "4"}
    # A scrape of an earlier batch is used although the page is gone since, and its lead comes first.
    reused = {r.listing_id for r in kept_leads(collect_listings(df, ledgers=[one])).filter("is_fresh = 0").collect()}
    assert reused


def test_a_remembered_scrape_outlives_its_page(spark, tmp_path):
    page = spark.createDataFrame([(1, "https://s1.org", "<title>One</title><p>a@s1.org</p>")], "page_id long, url string, html string")
    lead = lambda i, at, name: (i, at, "T", i, f"m{i}", name, name, "https://s1.org", "", "")
    root, some = str(tmp_path / "out"), facts_by_url(page)
    # Location 0 drops the second lead by its name, so the site of the first ledger entry differs from what is scraped.
    first = [lead(0, 0, "A"), (1, 0, "T", 1, "m1", "A", "A", "https://s2.org", "", "")]
    pages = page.unionByName(spark.createDataFrame([(2, "https://s2.org", "<title>Two</title><p>b@s2.org</p>")], page.schema))
    process_batch(spark.createDataFrame(first, LISTING), 0, facts_by_url(pages), root, COLUMNS, buckets=2)
    second = [(2, 1, "T", 2, "m2", "B", "B", "https://www.s2.org/", "", "")]
    process_batch(spark.createDataFrame(second, LISTING), 1, some, root, COLUMNS, buckets=2)
    assert (2, "B", "b@s2.org") in outcome(spark, root)[0]


def test_a_location_that_throws_is_isolated(spark, lead_facts, tmp_path):  # noqa: F811
    good = listing_rows(51, 40, 4)
    texts = [(*r[:3], str(r[3]), *r[4:]) for r in good]
    bad = [(900, 2, "Town 2", "no number", "m900", "X", "X", "https://s1.org", "", ""), (901, None, "?", "7", "m901", "X", "X", "https://s1.org", "", "")]
    as_text = LISTING.replace("card_ord long", "position string")
    read = lambda data: spark.createDataFrame(data, as_text).withColumn("card_ord", F.col("position").cast("long")).drop("position")
    root, clean = str(tmp_path / "out"), str(tmp_path / "clean")
    process_batch(read(texts + bad), 0, lead_facts, root, COLUMNS, buckets=2)
    process_batch(read([r for r in texts if r[1] != 2]), 0, lead_facts, clean, COLUMNS, buckets=2)
    failed = {r.location_ord: r.error for r in read_table(spark, root, "failed").collect()}
    assert set(failed) == {2, None} and "CAST_INVALID_INPUT" in failed[2] and failed[None] == "1 unusable listings"
    assert outcome(spark, root) == outcome(spark, clean)
    assert rows(read_table(spark, root, "ledger"), "kind", "key") == rows(read_table(spark, clean, "ledger"), "kind", "key")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):  # all locations throw: not their fault
        process_batch(read([(*r[:3], "x", *r[4:]) for r in texts]), 1, lead_facts, root, COLUMNS, buckets=2)


# --- kept facts and charsets ----------------------------------------------------------------


def test_only_changed_pages_are_parsed(spark, tmp_path):
    path = str(tmp_path / "facts")
    pages = lambda n, old: spark.range(n).select(
        F.col("id").alias("page_id"), F.format_string("https://s%d.org", F.col("id") % 150).alias("url"),
        F.format_string("<title>Page %d</title><p>%s%d@x.org</p>", "id", F.when(F.col("id") % 100 == 7, F.lit(old)).otherwise(F.lit("m")), "id").alias("html"),
        F.lit(f"2024-01-0{len(old)} 00:00:00").cast("timestamp").alias("crawled_at"),
    )
    assert refreshed_facts(pages(210, "old"), path).filter("parsed").count() == 210
    second = refreshed_facts(pages(200, "m"), path)
    assert rows(second.filter("parsed"), "page_id") == [(107,), (7,)]
    whole = facts_by_url(pages(200, "m"))
    assert rows(facts_of_pages(second)) == rows(whole.select(*facts_of_pages(second).columns))
    assert refreshed_facts(pages(200, "m"), path).filter("parsed").isEmpty()


@pytest.mark.parametrize("name", ["ISO-8859-1", "windows-1252", "Windows-1251", "KOI8-R", "us-ascii", "ISO-8859-15", "no-such", None, "UTF8"])
def test_charsets_equal_the_codecs(spark, name):
    raw = [bytes(range(256)), b"", "naïve €".encode("utf-8")]
    df = spark.createDataFrame([(i, bytearray(b), name) for i, b in enumerate(raw)] + [(9, None, name)], "i int, raw binary, charset string")
    got = dict(df.select("i", decode_html(F.col("raw"), F.col("charset"))).collect())
    codec = name if name not in ("no-such", None) else "utf-8"
    assert got == {**{i: b.decode(codec, "replace") for i, b in enumerate(raw)}, 9: None}


def test_pages_name_their_charset(spark, tmp_path):
    text = "<p>日本 ü</p>"
    pages = [
        (0, text.encode("shift_jis", "replace"), "text/html; charset=Shift_JIS"), (1, text.encode("utf-16"), None), (2, "<META charset='koi8-r'>Ж".encode("koi8-r"), "text/html"),
        (3, "ü".encode("latin-1"), 'text/html; foo=1; CHARSET = "latin1"'), (4, b"\xef\xbb\xbfx", None), (5, b"<meta charset=utf-8>\xff", ""),
    ]
    spark.createDataFrame([(i, "u", bytearray(b), t) for i, b, t in pages], "page_id long, url string, html binary, content_type string").write.parquet(str(tmp_path / "p"))
    read = lambda **how: {r.page_id: r.html for r in T.read_pages(spark, str(tmp_path / "p"), **how).collect()}
    sniffed = read(sniff=True, multibyte=True)
    assert sniffed == {0: text.encode("shift_jis", "replace").decode("shift_jis"), 1: text, 2: "<META charset='koi8-r'>Ж", 3: "ü", 4: "﻿x", 5: "<meta charset=utf-8>�"}
    plain = read()
    assert plain[3] == "ü" and plain[2] == "<META charset='koi8-r'>�" and plain[5] == sniffed[5]
    assert set(_codecs()[0]) & set(_codecs()[1]) == set()
