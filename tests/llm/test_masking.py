"""Masked texts keep no character of a span, whatever overlaps."""

import itertools
import random

from pyspark.sql import functions as F

from leadloom.llm import pii

PARTS = {
    "email": ["a.b+c@mail.example.com", "x_1@h-1.org"],
    "ip": ["10.1.22.255", "1.2.3.4"],
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004"],
    "phone": ["+1 (743) 555-3824", "+49 170 1234567"],
}


def texts():
    rng = random.Random(12)
    out = ["+49 170 1234567@c.us", "4111 1111 1111 1111@x.com", "+49 170 1234567 4111 1111 1111 1111", None, "", "no data", "ünïcode 日本 a.b@c.org é 10.1.2.3", "🙂a@b.co🙂"]
    kinds = [t for some in PARTS.values() for t in some]
    for a, b in itertools.product(kinds, kinds):
        out += [a + b, f"{a} {b}", f"é {a}.{b} x", f"{a}@{b}", f"+{a}-{b}"]
    out += ["".join(rng.choices([*kinds, " ", "@", ".", "+", "7", "é", "\n", "<EMAIL>"], k=12)) for _ in range(200)]
    return out


def plain_mask(text, spans):
    done, upto = "", 0
    for start, end, kind in spans:
        if start >= upto:
            done += text[upto:start] + f"<{kind.upper()}>"
        upto = max(upto, end)
    return done + text[upto:]


def test_no_character_of_a_span_stays(spark):
    rows = [(i, t, "f", "s") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, spans string").repartition(3)
    spans = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.spans(docs, ["doc_id"]).collect()}
    got = pii.masked(docs)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    masked = {r.doc_id: (r.text, r.found, r.spans) for r in got.collect()}
    for i, text, *rest in rows:
        assert masked[i] == (None if text is None else plain_mask(text, spans[i]), *rest)
    assert masked[0][0] == "<PHONE>" and masked[1][0] == "<CARD>"
    assert any(b[0] < a[1] for own in spans.values() for a, b in itertools.pairwise(own))  # overlaps occur
    assert pii.masked(docs.select("doc_id", F.col("text").alias("body"), "found"), text_column="body").columns == ["doc_id", "body", "found"]


def test_a_long_text_with_many_spans(spark):
    text = "é é mail a.b@c.org or 10.1.2.3, " * 3000
    got = pii.masked(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert got == text.replace("a.b@c.org", "<EMAIL>").replace("10.1.2.3", "<IP>")


def test_the_classifier_adds_what_the_base_checks_miss(spark):
    rng = random.Random(7)
    words = [a + b + c for a in "bdklmt" for b in "aeiou" for c in "nrs"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows, planted = [], {}

    def plant(kind, span, before, after):
        left = f"{prose(8)} {before}"
        planted[len(rows)] = (len(left), len(left) + len(span), kind)
        rows.append((len(rows), f"{left}{span}{after} {prose(8)}"))

    for two in ("7536784127813050 4845168114407329", "4111 1111 1111 1111 5500-0000-0000-0004", "378282246310005 4111111111111111 5500000000000004"):
        for _ in range(4):
            plant("number", two, "", "")
    for _ in range(15):  # no list holds these names
        name = " ".join(rng.choice(["Xav", "Quil", "Zor", "Bram"]) + rng.choice(["lian", "mond", "beck"]) for _ in range(2))
        plant("person", name, rng.choice(["dear ", "called "]), rng.choice([" said", ", born"]))
        plant("number", f"{rng.randrange(10**8, 10**9)}", rng.choice(["passport: ", "account: ", "ssn: "]), ",")
    clean = len(rows)
    for _ in range(60):
        bad = rng.choice(["9807915762804490", "1219538112535716", "2852466340876421"])  # fail the check digit
        rows.append((len(rows), f"{prose(9)} {bad} {prose(5)}"))
        rows.append((len(rows), f"{prose(9)} {' '.join(w.title() for w in rng.choices(words, k=2))} {prose(5)}"))
        rows.append((len(rows), f"{prose(9)} version {rng.randrange(10**8, 10**9)} {prose(5)}"))
        rows.append((len(rows), f"{prose(9)} 4111111111111111 {prose(5)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.spans(docs, ["doc_id"]).collect()}
    assert not [(rows[i][1], s, found[i]) for i, s in planted.items() if found[i] != [s]]
    assert not [(rows[i][1], found[i]) for i in range(clean, len(rows)) if [s[2] for s in found[i]] != ["card"] * ((i - clean) % 4 == 3)]


def test_rows_of_cards(spark):
    cases = {
        "7536784127813050 4845168114407329": True,
        "7536784127813050-4845168114407329 4111 1111 1111 1111": True,
        "7536784127813050 4845168114407328": False,
        "75367841278130504845168114407329": False,
        "4111 1111 1111 1111": False,
        "7536784127813050 4845168114407329 12": False,
        " ".join(["4111111111111111"] * 500): True,
        "1" * 100_000: False,
        "": False,
    }
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", pii.row_of_cards(F.col("c")).alias("is")).collect()
    assert {r.c: r["is"] for r in got} == cases
