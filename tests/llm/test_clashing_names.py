"""Columns of the input keep their values whatever they are called, and equal rows are dealt like others."""

import math

from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import lines, quality, sharding

NAMES = ["_row", "_rank", "_part", "_bucket", "_local", "_order", "_n", "_keep", "_doc", "_key", "_n_lines", "_n_dropped", "_copy", "_hot", "_copies", "__x"]


def clashing(spark):
    text = lambda i: "one line of more than twenty characters\n" + " ".join(f"word{chr(97 + j % 26)}{j}of{i}" for j in range(80))
    rows = [(i, text(i), "en", f"s{i % 2}", i, *[f"{n}{i}" for n in NAMES]) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))


def test_columns_of_any_name_stay(spark):
    docs = clashing(spark)
    stages = dict(corpus_pipeline.STAGES)
    for got in (
        sharding.uniform_shards(docs, shards=3, partition_rows=4),
        lines.deduplicated(docs),
        quality.judged(docs),
        *(stages[s](spark, docs, "") for s in ("quality_rules", "line_dedup", "near_dedup", "mask_personal_data")),
    ):
        rows = got.select("doc_id", *NAMES).collect()
        assert rows
        for r in rows:
            assert list(r[1:]) == [f"{n}{r.doc_id}" for n in NAMES]


def test_equal_rows_spread_over_shards(spark):
    n, equal, shards = 20_000, 8_000, 8
    rows = spark.range(n).select(F.when(F.col("id") < equal, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.lit("x").alias("text"))
    dealt = sharding.uniform_shards(rows, shards=shards, partition_rows=1000)
    per_shard = {r.shard: (r.n, r.equal) for r in dealt.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("id") == -1).alias("equal")).collect()}
    spread = math.sqrt(n / shards * 0.4 * 0.6)
    assert all(size == n // shards and abs(e - equal / shards) < 5 * spread for size, e in per_shard.values())
    by_slot = dealt.filter("id = -1").agg(F.avg("slot"), F.stddev("slot")).first()
    assert abs(by_slot[0] - n / shards / 2) < 40 and abs(by_slot[1] - n / shards / math.sqrt(12)) < 40
