"""Helpers of the training-data operators: input columns, bindings, written tables, skewed lookups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def work_folder(spark: SparkSession) -> str:
    """New folder name in the shared folder of ``spark.checkpoint.dir``.

    A session that names none gets a folder inside its warehouse, which all executors share too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = work_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/llm-" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_prefix(*frames: DataFrame) -> str:
    """Underscores that no column of ``frames`` begins with: a prefix for columns of one's own."""
    names, prefix = [c.lower() for df in frames for c in df.columns], "_"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def one_row(df: DataFrame, *columns: str):
    return df.select(*columns).first()


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left", rows: int = 100_000) -> DataFrame:
    """Equi-join of many rows with one row per key, where a key may hold a third of ``left``.

    ``right`` carries in ``weight`` how many rows of ``left`` have its key (counted beside its
    other columns, so nothing runs while the plan is built). Keys with more than ``rows`` rows
    are repeated once per ``rows`` and the rows of ``left`` dealt over all copies by a hash of
    the row: the split grows with the key and no task gets more than about ``rows`` of one key.
    The number of copies of each key reaches ``left`` through a join on its hot keys only.
    """
    p = free_prefix(left, right)
    copies = F.ceil(F.col(weight) / F.lit(rows)).cast("int")
    hot = right.filter(F.col(weight) > rows).select(F.col(key).alias(f"{p}hot"), copies.alias(f"{p}copies"))
    # At most rows(left) / `rows` hot keys: without the hint an estimate may have ``left`` shuffled for them.
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col(f"{p}hot"), "left").withColumn(
        f"{p}copy",
        F.when(F.col(f"{p}copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*left.columns), F.col(f"{p}copies")).cast("int")),
    )
    repeated = right.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1))).drop(weight)
    return dealt.drop(f"{p}hot", f"{p}copies").join(repeated, [key, f"{p}copy"], how).drop(f"{p}copy")


@contextmanager
def conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings for the jobs inside (dots written as __)."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
