"""Lead files: long ones are read in splits where every line is a whole record, else as one."""

import csv
import random

from pyspark.sql import functions as F

from leadloom.sources.tables import read_leads_csv, whole_line_files


def write(path, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator=end).writerows(rows)


def plain(path):
    with open(path, newline="", encoding="utf-8") as file:
        header, *rows = list(csv.reader(file))
    return [dict(zip(header, row, strict=True)) for row in rows]


def cell(rng, alphabet):
    return "".join(rng.choices(alphabet, k=rng.randint(0, 12)))


def test_long_files_are_split_and_equal_the_csv_module(spark, tmp_path):
    rng = random.Random(8)
    folder = tmp_path / "leads"
    folder.mkdir()
    header = ["name", "site", "note"]
    alphabets = {"lines.csv": 'ab",é; \'', "cells.csv": 'ab",\né ', "feeds.csv": 'ab",;\n '}
    expected = []
    for name, alphabet in alphabets.items():
        rows = [[f"{name} {i}", "x" + cell(rng, alphabet), "y" + cell(rng, alphabet)] for i in range(400)]
        write(folder / name, [header, *rows], "\n" if name == "cells.csv" else "\r\n")
        expected += plain(folder / name)
    write(folder / "short.csv", [header, ["short", "a\nb", "c"]])
    expected += plain(folder / "short.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert [p.rpartition("/")[2] for p in whole_line_files(spark, str(folder))] == ["lines.csv"]
        rows = read_leads_csv(spark, str(folder))
        assert rows.columns == header
        assert sorted(tuple(r) for r in rows.collect()) == sorted(tuple(d[c] for c in header) for d in expected)
        tasks = rows.filter(F.col("name").startswith("lines.csv")).select(F.spark_partition_id().alias("task")).distinct().count()
        assert tasks > 3
        # The rest of the session's bound: nothing is longer, nothing is searched.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64MB")
        assert whole_line_files(spark, str(folder)) == []
        assert read_leads_csv(spark, str(folder)).count() == len(expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_that_could_be_part_of_a_record_keep_a_file_whole(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10")
    texts = {
        "open.csv": 'a,b\n1,"x\ny"\n',
        "even.csv": 'a,b\n5" x,"p\nq" 5"\n',
        "stray.csv": 'a,b\n5" pipe,2\n',
        "return.csv": "a,b\n1,x\ry\n",
        "good.csv": 'a,b\r\n"1, ""one""",\r\n,"2"\r\n',
    }
    try:
        for name, text in texts.items():
            (tmp_path / name).write_bytes(text.encode())
        assert [p.rpartition("/")[2] for p in whole_line_files(spark, str(tmp_path))] == ["good.csv"]
        assert [tuple(r) for r in read_leads_csv(spark, str(tmp_path / "good.csv")).collect()] == [('1, "one"', None), (None, "2")]
        assert [tuple(r) for r in read_leads_csv(spark, str(tmp_path / "open.csv")).collect()] == [("1", "x\ny")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
