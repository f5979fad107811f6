"""Run the Spark queries and their SQL on one data folder and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracle
from checks.spark_queries import QUERIES

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    db = duckdb.connect()
    for t in ALL_TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def main(sf: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, sql, bad = connect(sf), oracle.build(), 0
    for name in names or QUERIES:
        try:
            started = time.time()
            got = QUERIES[name](spark, sf)
            spark_rows = rows_of(got.columns, got.collect())
            middle = time.time()
            if name not in sql:
                print(f"{name:28s} no sql, {len(spark_rows)} rows")
                continue
            ref = db.execute(sql[name])
            columns = [d[0] for d in ref.description]
            sql_rows = rows_of(columns, ref.fetchall())
            times = f"spark {middle - started:6.2f}s sql {time.time() - middle:6.2f}s"
            if sorted(columns) != sorted(got.columns):
                bad += 1
                print(f"{name:28s} COLUMNS {sorted(got.columns)} {sorted(columns)}")
            elif spark_rows != sql_rows:
                bad += 1
                only_spark = [r for r in spark_rows if r not in set(sql_rows)][:2]
                only_sql = [r for r in sql_rows if r not in set(spark_rows)][:2]
                print(f"{name:28s} DIFFERS {len(spark_rows)} {len(sql_rows)} {times}\n   spark {str(only_spark)[:700]}\n   sql   {str(only_sql)[:700]}")
            else:
                print(f"{name:28s} same {len(spark_rows):7d} rows {times}{'' if spark_rows else ' EMPTY'}")
        except Exception as problem:  # noqa: BLE001 - report and go on with the next query
            bad += 1
            print(f"{name:28s} FAILED {type(problem).__name__} {str(problem)[:500]}")
        sys.stdout.flush()
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
