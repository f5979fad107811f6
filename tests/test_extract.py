"""The situations a page can show, with pages of our own, and one case per special rule."""

import pytest
from pyspark.sql import functions as F

from leadloom.operators.extract import page_facts

URL = "https://example.com"

# name -> (html, field, expected)
CASES = {
    "name_suffix": ("<title>Birch Partners - Start</title>", "company_name", "Birch Partners"),
    "name_site_meta": (
        '<title>t</title><meta property="og:site_name" content="Birch | Shop - x">',
        "company_name",
        "Birch",
    ),
    "name_h1": ("<h1>Oak :: Home</h1>", "company_name", "Oak"),
    "name_host": ("<p>nothing</p>", "company_name", "Example"),
    "emails_visible": (
        '<p>Write to info@birch.org now.</p><a href="mailto:team@birch.org">t</a><script>no@birch.org</script>',
        "emails",
        ["info@birch.org", "team@birch.org"],
    ),
    "emails_two_spellings": (
        "<p>A@birch.org and a@birch.org</p>",
        "emails",
        ["a@birch.org", "a@birch.org"],
    ),
    "emails_prose": ("<p>us at example.com</p>", "emails", ["us@example.com"]),
    "emails_written_out": (
        "<p>one [at] birch [dot] org</p><p>two(AT)birch.org</p><p>three at birch dot org</p>",
        "emails",
        ["one@birch.org", "three@birch.org", "two@birch.org"],
    ),
    "emails_noscript": ("<noscript>a@birch.org</noscript><p>b@birch.org</p>", "emails", ["b@birch.org"]),
    "loose_emails": (
        '<noscript>a@birch.org</noscript><a href="MAILTO:Z@birch.org">m</a>'
        '<a href="mailto:q@birch.org?subject=x">open<template>t@birch.org</template>',
        "loose_emails",
        ["a@birch.org", "mailto:z@birch.org", "q@birch.org?subject=x"],
    ),
    "first_email": ("<p>z@birch.org, a@birch.org.</p>", "first_email", "z@birch.org"),
    "contact_same_site": (
        '<a href="/reach">Reach us</a><a href="https://other.test/contact">Contact</a>'
        '<a href="https://www.example.com/Contact">x</a><a href="/REACH">reach us</a>',
        "contact_links",
        ["https://example.com/reach", "https://www.example.com/Contact"],
    ),
    "services_section": (
        '<header><nav><a href="/services/move">Data Moves</a></nav></header><h2>Services</h2>'
        "<h3>Web Analytics</h3><li>Site Security</li><li>Services</li><li>© Birch</li><h2>Other</h2><h3>Cooking</h3>",
        "services",
        ["Security", "Analytics"],
    ),
    "services_uncategorized": (
        '<nav><a href="/services/move">Cloud Moves</a></nav><h2>Our Services</h2><li>Hosting</li>',
        "services",
        ["Hosting", "Cloud Moves"],
    ),
    "services_headings": (
        "<h1>Growth Marketing Helpers</h1><h3>Strategy</h3><h3>Paid Media Plans</h3><h3>Reporting</h3>"
        "<h3>Discover SEO</h3><h3>Creative?</h3>",
        "services",
        ["PPC", "Analytics", "Strategy"],
    ),
    "services_noise": (
        "<h2>Services</h2><h3>Websites</h3><h3>Rodeo Austin</h3><h3>Compliance</h3><h3>Page Load Time Test</h3>",
        "services",
        ["Websites", "Compliance"],
    ),
    "services_nested_li": (
        "<h2>Services</h2><ul><li>Outer<ul><li>Logo Design</li></ul></li></ul>",
        "services",
        ["Branding"],
    ),
    "phones": (
        '<p>Call +1 (555) 010-4477 or +1-555-010-7788, not 20240131.</p><a href="tel:+1%20555%200100">c</a>',
        "phones",
        ["+1 (555) 010-4477", "+1 555 0100", "+1-555-010-7788"],
    ),
    "phone_parenthesis": ("<p>(555) 010-4477</p>", "phones", ["555) 010-4477"]),
    "phone_tel_no_check": ('<a href="tel:12">c</a><a href="TEL:34">d</a>', "phones", ["12", "TEL:34"]),
    "location_text": (
        "<p>Find us at 12 Long Street, Suite 9, Bonn.</p>",
        "location",
        "Find us at 12 Long Street, Suite 9, Bonn.",
    ),
    "location_substring": ("<p>We always had 3 cats here</p>", "location", "We always had 3 cats here"),
    "location_meta": (
        '<meta name="geo.Region" content=" "><meta name="place:locality" content="Bonn"><p>1 Main Street 2</p>',
        "location",
        "Bonn",
    ),
    "location_too_long": ("<p>1 street " + "x" * 150 + "</p>", "location", None),
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(i, URL, html) for i, (html, _, _) in enumerate(CASES.values())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.asDict(True) for r in page_facts(pages).collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(facts, name):
    _, field, expected = CASES[name]
    assert facts[list(CASES).index(name)][field] == expected


def test_socials(spark):
    html = (
        '<a href="/about">x</a><a href="https://x.com/birch_a/">1</a><a href="https://x.com/birch_b">2</a>'
        '<a href="//fb.com/birch">3</a><a href="https://WWW.linkedin.com/company/birch/">4</a>'
        '<a href="https://youtu.be/c/birch">5</a><a href="https://tiktok.com/@birch">6</a>'
        '<a href="https://instagram.com/birch.b//">7</a><a href="https://linkedin.com/jobs/q">8</a>'
    )
    row = page_facts(spark.createDataFrame([(1, URL, html)], "page_id long, url string, html string")).first()
    assert [(s.network, s.url) for s in row.socials] == [
        ("twitter", "https://x.com/birch_a"),
        ("facebook", "https://fb.com/birch"),
        ("linkedin", "https://WWW.linkedin.com/company/birch"),
        ("youtube", "https://youtu.be/c/birch"),
        ("tiktok", "https://tiktok.com/@birch"),
        ("instagram", "https://instagram.com/birch.b"),
    ]


def test_facts_add_no_exchange(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = page_facts(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_loose_emails_in_a_long_word_take_linear_time(spark):
    """A start inside a run can't match where its edge didn't, so each run is read once."""
    import time

    from leadloom.functions.patterns import LOOSE_EMAIL

    text = spark.createDataFrame([("@" + "a" * 1_000_000 + " x@y.zz-u@v.ww",)], "t string")
    started = time.perf_counter()
    found = text.select(F.regexp_extract_all("t", F.lit(LOOSE_EMAIL), F.lit(0)).alias("f")).first().f
    assert found == ["x@y.zz", "-u@v.ww"] and time.perf_counter() - started < 20


def test_paths_of_many_segments(spark):
    import random
    import time
    from urllib.parse import urljoin

    from leadloom.functions.urls import resolve_url

    rng = random.Random(5)
    paths = ["/".join(rng.choice(["a", "b", "..", ".", "c.d"]) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    paths += ["/" + p for p in paths[:150]]
    df = spark.createDataFrame([(p,) for p in paths], "href string")
    got = df.select("href", resolve_url(F.lit("https://h.org/x/y/z"), F.col("href")).alias("url")).collect()
    assert {r.href: r.url for r in got} == {p: urljoin("https://h.org/x/y/z", p) for p in paths}
    long = "/" + "a/" * 100_000 + "../" * 99_999 + "end"
    started = time.perf_counter()
    found = spark.createDataFrame([(long,)], "href string").select(resolve_url(F.lit("https://h.org/"), F.col("href")).alias("u")).first().u
    assert found == "https://h.org/a/end" and time.perf_counter() - started < 30


@pytest.mark.parametrize("name", ["e1_emails", "b8_title"])
def test_page_queries_have_no_exchange(spark, name):
    from checks.spark_queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
