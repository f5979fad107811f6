"""What earlier micro-batches leave for later ones: rows by key, laid out in hash buckets.

Each batch adds one part (see ``versions``), written in buckets of the key. All parts are read as
one bucketed table, so a lookup shuffles the small batch to the buckets and never the state. Rows
carry the batch that added them; a batch sees those of earlier ones only, so a replayed batch sees
what it saw the first time and replaces its own part. Parts of batches that can no longer be
replayed are merged, bucket by bucket, once there are more than ``most_parts``: the number of
files a batch opens does not grow with the number of batches before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.sources import versions

BATCH = "batch_id"
_MERGED = "merged"


@dataclass(frozen=True)
class KeyedState:
    spark: SparkSession
    path: str
    key: str
    columns: str  # DDL of the rows, key included
    buckets: int = 32
    most_parts: int = 16

    @property
    def _layout(self) -> tuple[str, int]:
        return self.key, self.buckets

    def before(self, batch_id: int) -> DataFrame:
        """The rows that batches before this one added."""
        rows = versions.read_buckets(self.spark, self.path, f"{self.columns}, {BATCH} BIGINT", self._layout)
        if rows is None:
            return self.spark.createDataFrame([], self.columns)
        return rows.filter(F.col(BATCH) < batch_id).drop(BATCH)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of a batch, in place of those it added before if it is run again."""
        own = rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        versions.put(own.repartition(self.buckets, self.key), self.path, str(batch_id), buckets=self._layout)

    def compact(self, batch_id: int) -> None:
        """Merge the parts of batches before ``batch_id``, which is running: they are committed for good."""
        settled = [k for k in versions.live_parts(self.spark, self.path) or {} if k == _MERGED or int(k) < batch_id]
        if len(settled) > self.most_parts:
            rows = versions.read_buckets(self.spark, self.path, f"{self.columns}, {BATCH} BIGINT", self._layout)
            versions.put(rows.filter(F.col(BATCH) < batch_id), self.path, _MERGED, drop=settled.__contains__, buckets=self._layout)
