"""Cut points of loops, and join keys that hold up when one key has a large share of the rows.

Tables are joined against one row per key with plain equi-joins. A key with very many rows makes
a large partition of one side only, which adaptive execution measures and splits at run time
(``spark.sql.adaptive.skewJoin``, on by default) for inner, left, semi and anti joins alike. NULL
keys are one such key that matches nothing; ``filled`` spreads them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(session: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, else one in the warehouse: all executors share it."""
    return session.conf.get("spark.checkpoint.dir", None) or session.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps plans of loops short."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as the session gives a shuffle.

    For work on a row that takes far longer than moving it: a scan has no more tasks with rows than
    the files have row groups. The number is fixed, so adaptive execution doesn't merge tasks of few
    bytes and much work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Pieces:
    """Rows that a loop adds step by step, each step checkpointed once.

    Steps are merged in blocks, so neither the plan nor the rewritten data grows with the
    square of the number of steps.
    """

    BLOCK = 32

    def __init__(self, none: DataFrame):
        self._none = none
        self._merged: list[DataFrame] = []
        self._recent: list[DataFrame] = []

    def add(self, step: DataFrame) -> DataFrame:
        step = cut_lineage(step)
        self._recent.append(step)
        if len(self._recent) == self.BLOCK:
            self._merged.append(cut_lineage(reduce(DataFrame.unionByName, self._recent)))
            self._recent = []
        return step

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [*self._merged, *self._recent] or [self._none])


def filled(key: Column, *row: str) -> Column:
    """Key in which every NULL is a value of its own: it matches nothing and spreads evenly."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.hex(F.xxhash64(*row))))
