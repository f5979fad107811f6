"""The parsed columns against the standard library's HTML parser.

The check records the parser's events as a flat list and then reads each structure from
that list on its own, page by page; it shares no code with the column expressions.
"""

import random
from html import unescape
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from leadloom.operators.parse import decode_html, parse_pages

HIDDEN = ("script", "style", "noscript", "template", "svg")


class Recorder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, {n: v or "" for n, v in attrs}))

    def handle_endtag(self, tag):
        self.events.append(("end", tag, None))

    def handle_data(self, data):
        self.events.append(("text", unescape(data).strip(), None))


def events_of(html):
    recorder = Recorder()
    recorder.feed(html)
    recorder.close()
    return recorder.events


def depths(events, tags):
    """Depth before each event, never below zero."""
    depth, out = 0, []
    for kind, name, _ in events:
        out.append(depth)
        if name in tags and kind == "start":
            depth += 1
        elif name in tags and kind == "end":
            depth = max(depth - 1, 0)
    return out


def one_space(parts):
    return " ".join(" ".join(parts).split())


def expected(html):
    events = events_of(html)
    hidden = depths(events, HIDDEN)
    nav = depths(events, ("nav", "header"))
    seen = [k == "text" and bool(n) and not hidden[i] for i, (k, n, _) in enumerate(events)]
    text = lambda a, b: one_space(events[i][1] for i in range(a, b) if seen[i])
    is_link = lambda e: e[0] == "start" and e[1] == "a" and e[2].get("href")
    links, elements, title, meta = [], [], [], {}
    for i, event in enumerate(events):
        if is_link(event):
            stop = next((j for j in range(i + 1, len(events)) if events[j][:2] == ("end", "a") or is_link(events[j])), None)
            if stop is not None and events[stop][0] == "end":
                links.append((event[2]["href"], text(i, stop), nav[i] > 0))
        starts = ("title", "h1", "h2", "h3", "h4", "li")
        if event[0] == "start" and event[1] in starts:
            for j in range(i + 1, len(events)):
                if events[j][0] == "start" and events[j][1] in starts:
                    break
                if events[j][:2] == ("end", event[1]):
                    if text(i, j) and event[1] != "title":
                        elements.append((event[1], text(i, j)))
                    break
        if event[:2] == ("start", "meta"):
            key = (event[2].get("property") or event[2].get("name") or "").lower()
            if key and event[2].get("content"):
                meta[key] = one_space([event[2]["content"]])
    inside = False
    for i, (kind, name, _) in enumerate(events):
        if name == "title" and kind in ("start", "end"):
            inside = kind == "start"
        elif inside and seen[i]:
            title.append(events[i][1])
    parts = [events[i][1] for i in range(len(events)) if seen[i]]
    return {
        "text": one_space(parts),
        "text_parts": parts,
        "title": one_space(title) or None,
        "links": links,
        "elements": elements,
        "meta": list(meta.items()),
    }


def found(row):
    return {
        "text": row.text,
        "text_parts": row.text_parts,
        "title": row.title,
        "links": [tuple(a) for a in row.links],
        "elements": [tuple(e) for e in row.elements],
        "meta": [tuple(m) for m in row.meta],
    }


def check(spark, htmls):
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").repartition(8)
    for row in parse_pages(pages).collect():
        assert found(row) == expected(htmls[row.page_id]), htmls[row.page_id]


def test_all_driver_pages(spark):
    """Every page of the largest folder, as crawled and with the added lead snippets."""
    from checks.spark_queries import view

    sf = "/root/testdata/sf0.1"
    rows = view(spark, sf, "lead_pages").select("html").union(spark.read.parquet(f"{sf}/pages.parquet").select("html"))
    check(spark, [r.html for r in rows.collect()])


SPECIAL = [
    "",
    "plain",
    "a < b <c",
    "x <",
    "<p>tail</p",
    "<p>cut <a href='x",
    "<a href=\"x>y</a> and \"more\">z</a>",
    "one<!-- never closed <b>two</b>",
    "one<!-- c -- >two<!--x-->three",
    "<!doctype html><?php echo 1 ?>t<![CDATA[ x ]]>u<!weird>v",
    "<script>if (a < b) { '</p>' }</script>after<script>open <p>never",
    "<style>p{}</STYLE >x</style>y",
    "</svg>a<svg>b<svg>c</svg>d</svg>e</noscript>f",
    "<svg/>a<svg />b<noscript>c</svg>d</noscript>e",
    "<script/>a<template>b<a href=1>c</a><title>d</title></template>e",
    "<a href=a>1<a href=b>2</a>3</a>",
    "<a href=a/>1</a><a href='b'/>2<a name=x>3</a>",
    "<a HREF=one href=two title='>'>x</a>",
    "<a href = 'q' >x</a><a href>y</a><a href=''>z</a>",
    "<a href=it's>x</a><a title=it's href=y>z</a>",
    "<li>1<li>2</li>3</li><h1>4<h2>5</h1>6</h2><H3>7</h3 >",
    "<title>a</title><title>b<title>c</title>d",
    "<title>a<li>b</title>c</li>",
    "<meta name=A content=1><meta name=b content=2><meta name=a content=' 3  4'><meta property='' name=c content=5>",
    "<nav><header></nav><a href=1>x</a></header></header></nav><a href=2>y</a>",
    "&amp;lt; &lt;b&gt; &copy2024 &copy;x &notit; &notin; &#65;&#x42;&#0;&#128;&#xD800;&#x110000; &#99999999999; &bogus; &",
    "<a href='?a=1&copy=2&amp;b=3&lt'>x</a><meta name=d content='&eacute;&#8212;'>",
    "<p> x y\x1cz　</p><p>​</p>",
    "<a:b>x</a:b><lib>y</lib><h12>z</h12></ p >q</>w</1>r",
    "<ruby>a<rt>b</rt></ruby>",
    "<p" + " x" * 5000 + ">t</p>",
    "<p x='" + "y" * 200000 + "'>" + "z " * 100000 + "</p>",
    "<b>" * 3000 + "deep" + "</b>" * 3000,
]


@pytest.mark.parametrize("start", range(0, len(SPECIAL), 11))
def test_special_pages(spark, start):
    check(spark, SPECIAL[start : start + 11])


def test_random_pages(spark):
    """Random strings of markup pieces, most of them malformed."""
    rng = random.Random(7)
    tags = ["a", "li", "h1", "h2", "title", "nav", "header", "svg", "noscript", "template", "script", "style", "p", "b"]
    pieces = [f"<{t}>" for t in tags] + [f"</{t}>" for t in tags] + [f"<{t}/>" for t in ("svg", "li", "nav", "a")]
    pieces += ["<a href='x'>", "<a href=y>", '<a href="z" class=k>', "t", " u ", "&amp;", "&lt;", "<", ">", "\n", "<!-- c -->"]
    pieces += ["<meta name=k content=v>", "<meta property=p content='w  x'>", "é", "'", '"']
    check(spark, ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(3000)])


def test_plain_text_leaves_out_templates_only(spark):
    html = "<noscript>a&amp;lt;</noscript><template>b</template><svg>c</svg><rt>d</rt><script>e</script>f"
    row = parse_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert row.plain_text.split() == ["a&lt;", "c", "f"]


def test_bytes_that_are_not_utf8(spark):
    row = spark.createDataFrame([(bytearray(b"caf\xe9 \xc3\xa9"),)], "html binary").select(decode_html(F.col("html")).alias("h")).first()
    assert row.h == "caf� é"


def test_named_columns_only(spark):
    pages = spark.createDataFrame([(1, "<title>a</title><p>b</p>")], "page_id long, html string")
    one = parse_pages(pages, "title", "text_parts")
    assert one.columns == ["page_id", "title", "text_parts"]
    assert one.collect() == parse_pages(pages).select(one.columns).collect()


def test_many_regions_take_linear_time(spark):
    """Every region tag is a step of the running depth; hidden text stays hidden in all of them."""
    import time

    html = "<svg>no</svg>yes" * 50_000 + "</svg></svg><nav><svg><svg>no</svg>no</svg>end"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    started = time.perf_counter()
    parts = parse_pages(pages, "text_parts").first().text_parts
    assert parts == ["yes"] * 50_000 + ["end"] and time.perf_counter() - started < 30
