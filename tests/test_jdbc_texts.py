"""What the JDBC target says to a database; no database is needed for it."""

import pytest
from pyspark.sql import functions as F

from sitetable.operators import tables as K
from sitetable.sources.snapshots import requests
from sitetable.sources.targets import JdbcTarget, merge_statement, partition_options


def test_merge_statement():
    assert merge_statement("t", "s1", ["id", 'a"b'], ["id"]) == (
        'MERGE INTO t t USING s1 s ON ((t."id" = s."id" OR (t."id" IS NULL AND s."id" IS NULL)))'
        ' WHEN MATCHED THEN UPDATE SET "a""b" = s."a""b" WHEN NOT MATCHED THEN INSERT ("id", "a""b") VALUES (s."id", s."a""b")')
    only_keys = merge_statement("t", "s", ["a", "b"], ["a", "b"], "`")
    assert "WHEN MATCHED" not in only_keys and "(t.`b` = s.`b` OR" in only_keys


def test_partition_options():
    assert partition_options("id", 0, 99, 4) == {"partitionColumn": "id", "lowerBound": "0", "upperBound": "99", "numPartitions": "4"}
    with pytest.raises(ValueError):
        partition_options("id", 0, 99, 0)


def test_upsert_stages_one_row_per_key_and_merges_once(spark, monkeypatch):
    saved, ran = [], []
    target = JdbcTarget(spark, "jdbc:x", partitioned=partition_options("id", 0, 9, 2))

    def save(df, table, mode):
        saved.append((table, mode, sorted(map(tuple, df.collect()), key=repr)))
        return len(saved[-1][2])

    monkeypatch.setattr(target, "_save", save)
    monkeypatch.setattr(target, "_execute", lambda statements: ran.extend(statements))
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1)], "id int, v string, n int")
    assert target.upsert(rows, "t", ["id"], ["n"]) == 3
    (table, mode, given), = saved
    assert table.startswith("t_") and mode == "overwrite" and given == [(1, "b", 2), (None, "c", 1)]
    assert ran == [merge_statement("t", table, ["id", "v", "n"], ["id"]), f"DROP TABLE {table}"]


def test_long_request_logs_are_grouped_like_short_ones(spark):
    log = [("u1", "GET", "document", None), ("u2", "POST", None, None), ("u1", None, None, 200), ("u1", "GET", "x", 404), (None, "GET", None, None)]
    rows = spark.createDataFrame([("p", {"requests": log}), ("q", {"requests": []}), ("r", None)],
                                 "id string, har struct<requests:array<struct<url:string,method:string,resource_type:string,status:int>>>")
    short, long = (sorted(map(tuple, requests(rows, in_row=n).collect()), key=repr) for n in (500, 1))
    assert short == long == sorted([("p", "u1", "GET", "document", 404, 2, 2), ("p", "u2", "POST", None, None, 1, 0),
                                    ("p", None, "GET", None, None, 1, 0)], key=repr)
    assert "Exchange" not in requests(rows.limit(5), in_row=500).filter("page_id = 'p'")._jdf.queryExecution().optimizedPlan().toString()


def test_lengths(spark):
    pages = spark.createDataFrame([("1", "s", "u" * 2048, "t" * 513), ("2", "s", "u" * 2049, None)], "id string, site_id string, url string, title string")
    pages = pages.withColumn("page_type", F.lit("list"))
    found = {(r["rule"], r["column_name"], r["key"], r["n_rows"]) for r in K.violations({"pages": pages}).collect()}
    assert found == {("length", "title", "513", 1), ("length", "url", "2049", 1)}
