"""Heavy work on rows: dealt over all tasks, and by plain searches and hashes."""

import random
import re

from pyspark.sql import functions as F

from leadloom.functions import patterns as P
from leadloom.functions.arrays import unique_ignoring_case
from leadloom.operators import records
from leadloom.operators.extract import categorize


def test_pages_of_one_row_group_are_parsed_by_many_tasks(spark, monkeypatch):
    rows = [(i, f"https://s{i}.example/", f"<title>Shop {i}</title>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    met, parse = [], records.page_facts
    monkeypatch.setattr(records, "page_facts", lambda given, *kept: met.append(given) or parse(given, *kept))
    names = {r.url: r.company_name for r in records.facts_by_url(pages).collect()}
    assert names == {url: f"Shop {i}" for i, (_, url, _) in enumerate(rows)}
    assert met[0].select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_categories_are_plain_searches(spark):
    words = [w for ws in P.SERVICE_CATEGORIES.values() for w in ws]
    deal = random.Random(3)
    lists = [[]] + [[f"{deal.choice('xyz')} {deal.choice([w, w.title(), w[:-1], 'paid', 'media'])}" for w in deal.sample(words, 4)] for _ in range(300)]
    lists += [["paid", "media"], ["web", "design", "WEB", "Web Design"], ["SEO", "seo"], ["Ppc", "Plumbing", "PLUMBING", "ppc"]]
    found = spark.createDataFrame(list(enumerate(lists)), "id int, labels array<string>").withColumn("got", categorize(F.col("labels")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan

    def expected(labels):
        rules = {name: P.any_of(ws) for name, ws in P.SERVICE_CATEGORIES.items()}
        out = [n for n, rule in rules.items() if any(re.search(rule, x.lower()) for x in labels)]
        out += [x for x in labels if not re.search("|".join(rules.values()), x.lower())]
        return list({x.lower(): x for x in reversed(out)}[k] for k in dict.fromkeys(x.lower() for x in out))

    assert all(r.got == expected(r.labels) for r in found.collect())


def test_lists_are_made_unique_by_hash(spark):
    deal = random.Random(4)
    words = ["a", "A", "ab", "aB", "AB", "", "é", "É", "ς", "Σ", "σ", "x1", "X1", "straße", "STRASSE", "İ", "i̇", "K", "k"]
    lists = [[]] + [deal.choices(words, k=deal.randrange(1, 30)) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(lists)), "id int, words array<string>")
    lowered = F.transform("words", F.lower)
    found = frame.select("words", lowered.alias("keys"), unique_ignoring_case(F.col("words")).alias("got"))
    assert "array_sort" not in found._jdf.queryExecution().executedPlan().toString()
    for row in found.collect():
        kept = {}
        for word, key in zip(row["words"], row["keys"], strict=True):
            kept.setdefault(key, word)
        assert row["got"] == list(kept.values())
