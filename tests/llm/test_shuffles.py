"""What moves between tasks."""

from leadloom.llm import warc
from leadloom.llm.common import conf


def test_pages_are_shuffled_once_whatever_the_estimates(spark):
    """The few hot keys are sent to the pages; before, an estimate above the threshold had whole pages shuffled for them."""
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", "x" * 1200 + str(i % 7)) for i in range(40)], "page_id long, url string, html string")
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        linked = warc._linked(pages, 1000, "page_id", "url", "html", None)
        plan = linked._jdf.queryExecution().executedPlan().toString()
        rows = linked.collect()
    assert plan.count("SortMergeJoin") == 1
    assert sum(not r.revisit for r in rows) == 7 and {r.refers_to for r in rows if r.revisit} == set(range(33, 40))
