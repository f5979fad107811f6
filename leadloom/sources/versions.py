"""Tables of parts whose newest pointer is published last.

A table is a folder. Its parts are Parquet folders with names of their own, which are written once
and never changed; ``_pointers/<number>.json`` names the live parts by key. Readers follow the
pointer with the highest number. A run that ends between the write of a part and its pointer
leaves the old table as it was, and putting a part under a key that is there replaces it, so a
repeated run changes nothing. One writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_POINTERS = "_pointers"


def _files(spark: SparkSession, path: str):
    """Hadoop's Path class and the file system of ``path``: whatever store the table lies in."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    make, files = _files(spark, path)
    folder = make(f"{path}/{_POINTERS}")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def _pointer(spark: SparkSession, path: str, number: int) -> dict:
    """``parts``: folder by key; ``columns``: the columns of all parts so far, in the order they came."""
    make, files = _files(spark, path)
    stream = files.open(make(f"{path}/{_POINTERS}/{number:012d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def live_parts(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Folders of the live parts by key, in the order they were first put; None if there is no table yet."""
    newest = _newest(spark, path)
    return newest["parts"] if newest else None


def _newest(spark: SparkSession, path: str) -> dict | None:
    numbers = _numbers(spark, path)
    return _pointer(spark, path, numbers[-1]) if numbers else None


def _publish(spark: SparkSession, path: str, content: dict) -> None:
    make, files = _files(spark, path)
    number = max(_numbers(spark, path), default=0) + 1
    final, draft = make(f"{path}/{_POINTERS}/{number:012d}.json"), make(f"{path}/{_POINTERS}/.{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    if files.exists(final) or not files.rename(draft, final):
        raise RuntimeError(f"another run has published version {number} of {path}")


def put(df: DataFrame, path: str, key: str = "all", drop: Callable[[str], bool] = lambda _: False, buckets: tuple[str, int] | None = None) -> None:
    """Write ``df`` as the part ``key`` and publish it; other parts stay unless ``drop`` names them.

    ``buckets`` (column, number) lays the part out by a hash of the column.
    """
    spark, folder = df.sparkSession, f"part-{uuid.uuid4().hex}"
    if buckets is None:
        df.write.parquet(f"{path}/{folder}")
    else:
        column, number = buckets
        name = f"leadloom_part_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(number, column).sortBy(column).option("path", f"{path}/{folder}").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the table was a name for the writer only; its files stay
    newest = _newest(spark, path) or {"parts": {}, "columns": []}
    kept = {k: f for k, f in newest["parts"].items() if not drop(k)}
    before = newest["columns"] if kept else []
    columns = before + [c for c in df.columns if c.lower() not in {b.lower() for b in before}]
    _publish(spark, path, {"parts": {**kept, key: folder}, "columns": columns})


def read(spark: SparkSession, path: str, keys: Callable[[str], bool] = lambda _: True, merge: bool = False) -> DataFrame | None:
    """The live parts, those of ``keys``; None if there are none. ``merge`` unites the columns of all parts."""
    newest = _newest(spark, path)
    folders = [f"{path}/{f}" for k, f in newest["parts"].items() if keys(k)] if newest else []
    if not folders:
        return None
    rows = spark.read.option("mergeSchema", merge).parquet(*folders)
    return rows.select(*[f"`{c}`" for c in newest["columns"]]) if merge else rows


def read_buckets(spark: SparkSession, path: str, columns: str, buckets: tuple[str, int]) -> DataFrame | None:
    """The live parts as one bucketed scan: joins on the bucket column need no exchange of it."""
    parts = live_parts(spark, path)
    if not parts:
        return None
    column, number = buckets
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()[:16]
    prefix = f"leadloom_{digest(path)}_"
    name = prefix + digest(str(sorted(parts.items())))
    if not spark.catalog.tableExists(name):
        for older in spark.catalog.listTables(pattern=f"{prefix}*"):  # names only: the files of a table stay
            spark.sql(f"DROP TABLE IF EXISTS {older.name}")
        where = "LOCATION '{}'".format
        spark.sql(
            f"CREATE TABLE {name} ({columns}, part STRING) USING parquet PARTITIONED BY (part)"
            f" CLUSTERED BY ({column}) INTO {number} BUCKETS {where(path)}"
        )
        spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION (part='{k}') {where(f'{path}/{f}')}" for k, f in parts.items()))
    return spark.table(name).drop("part")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the parts and pointers that the newest ``keep`` pointers do not need."""
    make, files = _files(spark, path)
    numbers = _numbers(spark, path)
    needed = {f for n in numbers[-keep:] for f in _pointer(spark, path, n)["parts"].values()}
    for number in numbers[:-keep]:
        files.delete(make(f"{path}/{_POINTERS}/{number:012d}.json"), False)
    for status in files.listStatus(make(path)) if numbers else []:
        folder = status.getPath().getName()
        if folder.startswith("part-") and folder not in needed:
            files.delete(status.getPath(), True)
