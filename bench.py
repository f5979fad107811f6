"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts without results shared with earlier ones. ``rates`` gives rows per second
for page extraction and for the two-key dedup.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.spark_queries import QUERIES, forget_shared, view  # noqa: E402
from leadloom.operators.dedup import kept_positions  # noqa: E402
from leadloom.operators.extract import page_facts  # noqa: E402

HEADLINE = (
    "b3_text_parts", "e1_emails", "e13_services", "a4_homepage", "g2_contact_fold", "j3_social_fallback",
    "j4_enrich", "j8_email_cascade", "w1_dedup", "p8_routing", "g4_summary",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def with_split_pages(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The tables of ``sf_dir``, pages in several files: the given one is a single row group, which only one core can read."""
    folder = Path(tempfile.mkdtemp(prefix="bench-"))
    for file in Path(sf_dir).resolve().iterdir():
        if file.name != "pages.parquet":
            (folder / file.name).symlink_to(file)
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(files).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leadloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site capture per column call costs seconds on large expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    split = with_split_pages(spark, sf_dir, int(cpus))
    seconds = {}
    for name in HEADLINE:
        forget_shared()
        seconds[name] = round(timed(lambda: run(QUERIES[name](spark, split))), 3)

    pages = view(spark, sf_dir, "lead_pages").repartition(int(cpus)).cache()
    listings = view(spark, sf_dir, "listings").cache()
    n_pages, n_listings = pages.count(), listings.count()
    extract = min(timed(lambda: run(page_facts(pages))) for _ in range(2))
    dedup = min(timed(lambda: run(kept_positions(listings, ["location_ord", "card_ord"]))) for _ in range(2))
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "rates": {
                    "pages_per_sec_parse_extract": round(n_pages / extract, 1),
                    "listings_per_sec_two_key_dedup": round(n_listings / dedup, 1),
                },
                "machine": f"local[{cpus}], {os.cpu_count()} cores",
            }
        )
    )


if __name__ == "__main__":
    main()
