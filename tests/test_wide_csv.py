"""CSV files cut into byte ranges at any place give the records that one reader gives."""

import csv
import random

import pytest
from pyspark.sql import types as T

from sitetable.sources.targets import open_target
from sitetable.sources.wide_csv import read_wide_csv

COLUMNS = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b.c", "d")])


def written(path, seed, rows, end="\n"):
    rng = random.Random(seed)
    value = lambda: "".join(rng.choice(['x', 'é', '"', ",", "\n", "\r\n", " ", "y" * 9]) for _ in range(rng.randint(0, 12)))
    made = [[f"k{i}", value(), value()] for i in range(rows)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL)
        out.writerow(["a", "b\nc", "d"])
        out.writerows(made)
    return made


@pytest.mark.parametrize(("size", "end"), [(29, "\n"), (64, "\r\n"), (1 << 20, "\n"), (1 << 20, "\r\n")])
def test_records_do_not_depend_on_the_cuts(spark, tmp_path, size, end):
    made = written(tmp_path / "one.csv", 1, 14, end) + written(tmp_path / "two.csv", 2, 6, end)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b,d\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths = [str(tmp_path / n) for n in ("one.csv", "two.csv", "empty.csv", "head.csv")]
        df = read_wide_csv(spark, paths, COLUMNS)
        got = sorted((tuple(r["row"]) for r in df.collect()), key=repr)
        if size == 64:
            assert df.filter("row IS NOT NULL").rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # Spark reads an empty value, quoted or not, as null
    assert got == sorted((tuple(v or None for v in r) for r in made), key=repr)


def test_equal_to_the_reader_for_whole_files(spark, tmp_path):
    target = open_target(spark, "csv", str(tmp_path / "t"))
    rows = [("a", "one\ntwo\r\n", None), ('b"', ", ", ""), ("c", " x ", "\n"), ("d", "plain", "y"), (None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    target.append(df, "t")
    expected = spark.read.schema(COLUMNS).options(**target.OPTIONS, multiLine=True, recursiveFileLookup=True).csv(str(tmp_path / "t" / "t" / "part=*"))
    assert sorted(map(repr, target.read("t").collect())) == sorted(map(repr, expected.collect()))
    assert not target.log("t").state().of_kind("rows")[0].one_line


def test_parts_without_breaks_are_plain_lines(spark, tmp_path):
    target = open_target(spark, "csv", str(tmp_path))
    target.append(spark.createDataFrame([("a", "b,\"c")], "k string, v string"), "t")
    part, = target.log("t").state().of_kind("rows")
    assert part.one_line and [tuple(r) for r in target.read("t").collect()] == [("a", 'b,"c')]
