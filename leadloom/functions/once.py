"""Build an expression once per Spark application.

A column expression only names its inputs, so it can serve any number of DataFrames; large
ones take seconds to assemble through the Python gateway.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def once_per_application(build: Callable):
    built: dict[str, object] = {}

    @wraps(build)
    def cached():
        context = SparkContext._active_spark_context
        application = context.applicationId if context else ""
        if application not in built:
            built.clear()
            built[application] = build()
        return built[application]

    return cached
