"""Sources, sinks and incremental runs, read back from files."""

import shutil

import pytest
from pyspark.sql import functions as F

from leadloom.operators.records import facts_by_url
from leadloom.operators.routing import ColumnSpec
from leadloom.plans.batch import run_batch
from leadloom.sources import tables as T
from leadloom.streaming.incremental import ledger_before, process_batch, read_table, run_incremental
from tests.test_leads import COLUMNS, LISTING, listing_rows


@pytest.fixture(scope="module")
def facts(spark):
    pages = [(i, f"https://s{i}.org", f"<title>Site {i}</title><p>m{i}@s{i}.org</p>") for i in range(8)]
    return facts_by_url(spark.createDataFrame(pages, "page_id long, url string, html string")).cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr) if columns else sorted(map(tuple, df.collect()), key=repr)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x", y'), ("b\nc", "007")], "name string, code string")
    T.write_csv(df, str(tmp_path / "out"))
    back = T.read_leads_csv(spark, str(tmp_path / "out"))
    assert back.dtypes == [("name", "string"), ("code", "string")]
    assert rows(back) == rows(df)


def test_empty_csv_has_no_header(spark, tmp_path):
    T.write_csv(spark.createDataFrame([], "name string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv")) == ""


def test_results_are_replaced_unless_empty(spark, tmp_path):
    path = str(tmp_path / "results")
    df = spark.createDataFrame([(["a", "b"], 0, None, True), ([], 2, "x", False)], "l array<string>, n int, s string, b boolean")
    assert T.write_results(df, path)
    assert not T.write_results(df.limit(0), path)
    assert rows(T.read_rows(spark, path)) == [("", "2", "x", ""), ("a, b", "", "", "True")]


def test_append_grows_columns(spark, tmp_path):
    path = str(tmp_path / "accepted")
    assert T.read_rows(spark, path) is None
    T.append_rows(spark.createDataFrame([("a", "1")], "`Company Name` string, Phone string"), path)
    T.append_rows(spark.createDataFrame([("2", "x")], "`Phone ` string, Extra string"), path)
    got = T.read_rows(spark, path)
    assert rows(got, "Company Name", "Phone", "Extra") == [("", "2", "x"), ("a", "1", "")]


def test_append_list_before_text(spark, tmp_path):
    path = str(tmp_path / "accepted")
    T.append_rows(spark.createDataFrame([(["1", "2"],)], "Phone array<string>"), path)
    T.append_rows(spark.createDataFrame([("3",)], "Phone string"), path)
    assert rows(T.read_rows(spark, path)) == [("1, 2",), ("3",)]


def test_summary_is_replaced_unless_empty(spark, tmp_path):
    path = str(tmp_path / "summary")
    summary = spark.createDataFrame([("Qualified Leads", "3")], "label string, value string")
    assert T.write_summary(summary, path) and not T.write_summary(summary.limit(0), path)
    assert rows(T.read_rows(spark, path)) == [("Qualified Leads", "3")]


def test_pages_as_bytes(spark, tmp_path):
    spark.createDataFrame([(1, "u", bytearray(b"<p>\xff</p>"))], "page_id long, url string, html binary").write.parquet(str(tmp_path / "p"))
    assert T.read_pages(spark, str(tmp_path / "p")).first().html == "<p>�</p>"


TABLES = {"accepted": ("listing_id", "Name", "Mail"), "rejected": ("listing_id", "Reject Reason"), "ledger": ("kind", "key"), "counters": ("location_ord", "scraped", "after_dedup")}


def state(spark, root):
    return {t: rows(read_table(spark, root, t), *c) for t, c in TABLES.items()}


def test_micro_batches_equal_one_run(spark, facts, tmp_path):
    """Two files, one per batch; then a replay of the second batch changes nothing."""
    listings = spark.createDataFrame(listing_rows(21, 60, 2), LISTING)
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    halves = [listings.filter(F.col("location_ord") == k).coalesce(1) for k in (0, 1)]
    halves[0].write.mode("append").parquet(source)
    run_incremental(spark, source, LISTING, facts, root, checkpoint, COLUMNS).awaitTermination()
    assert ledger_before(spark, root, 0).isEmpty()
    halves[1].write.mode("append").parquet(source)
    run_incremental(spark, source, LISTING, facts, root, checkpoint, COLUMNS).awaitTermination()

    # One pass, because a scrape cache does not outlive a run.
    whole = run_batch(listings, facts, None, COLUMNS, order="one_pass")
    accepted = whole.routed.filter("reject_reason IS NULL")
    got = state(spark, root)
    assert got["accepted"] == rows(accepted, "listing_id", "maps_business_name", "email")
    assert got["ledger"] == rows(whole.ledger, "kind", "key")
    assert got["accepted"] and got["rejected"]

    process_batch(halves[1], 1, facts, root, COLUMNS)
    assert state(spark, root) == got


def test_replay_after_a_partial_write(spark, facts, tmp_path):
    listings = spark.createDataFrame(listing_rows(22, 30, 1), LISTING)
    root = str(tmp_path / "out")
    process_batch(listings, 0, facts, root, COLUMNS)
    got = state(spark, root)
    shutil.rmtree(f"{root}/ledger")  # the run ended before its last table was written
    process_batch(listings, 0, facts, root, COLUMNS)
    assert state(spark, root) == got


def test_failed_location_is_isolated(spark, facts, tmp_path):
    good = listing_rows(23, 40, 2)
    bad = [(900, 7, "Broken", 900, None, "X", "X", "https://s1.org", "", "")]
    root, clean = str(tmp_path / "out"), str(tmp_path / "clean")
    process_batch(spark.createDataFrame(good + bad, LISTING), 0, facts, root, COLUMNS)
    process_batch(spark.createDataFrame(good, LISTING), 0, facts, clean, COLUMNS)
    assert rows(read_table(spark, root, "failed"), "location_ord", "error") == [(7, "1 unusable listings")]
    assert state(spark, root) == state(spark, clean)


def test_blocked_and_nameless_locations_are_isolated(spark, facts, tmp_path):
    good = listing_rows(25, 40, 2)
    root, clean = str(tmp_path / "out"), str(tmp_path / "clean")
    rows_in = [(*r, None, "<p>maps</p>") for r in good]
    rows_in += [(900, 7, "Walled", 900, "m900", "X", "X", "https://s1.org", "", "", "https://maps.example/", "Solve the Captcha")]
    rows_in += [(901, None, None, 901, "m901", "Y", "Y", "https://s2.org", "", "", None, None)]
    process_batch(spark.createDataFrame(rows_in, LISTING + ", result_url string, result_html string"), 0, facts, root, COLUMNS)
    process_batch(spark.createDataFrame(good, LISTING), 0, facts, clean, COLUMNS)
    failed = {(r.location_ord, r.error) for r in read_table(spark, root, "failed").collect()}
    assert failed == {(7, "verification page"), (None, "1 unusable listings")}
    assert state(spark, root) == state(spark, clean)


def test_csv_keeps_white_space_at_the_ends(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 'say "x"\nand, y ')], "a string, b string")
    T.write_csv(df, str(tmp_path / "c"))
    assert T.read_leads_csv(spark, str(tmp_path / "c")).collect() == df.collect()


def test_required_field_in_exported_mode(spark, facts):
    listings = spark.createDataFrame(listing_rows(24, 20, 1), LISTING)
    specs = [ColumnSpec("Map", "maps_url", required=True)]
    by_scraped = run_batch(listings, facts, None, specs, mode="scraped").routed
    by_exported = run_batch(listings, facts, None, specs, mode="exported").routed
    assert by_scraped.filter("reject_reason IS NULL").isEmpty()
    assert by_exported.filter("reject_reason IS NOT NULL").isEmpty()
