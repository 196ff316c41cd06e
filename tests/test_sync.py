import pytest
from pyspark.sql import functions as F

from sitetable.functions.text import count_of, iso_utc, table_name
from sitetable.operators import sync as Y
from sitetable.sources.audit import LOG_LINE
from sitetable.sources.targets import JdbcTarget, last_cursor, open_target
from sitetable.streaming import flows


def rows(spark, *values, schema="name string, age int"):
    return spark.createDataFrame(list(values), schema)


@pytest.mark.parametrize("kind", ["csv", "parquet", "sqlite"])
def test_targets(spark, tmp_path, kind):
    target = open_target(spark, kind.upper(), str(tmp_path / kind))
    assert target.read("t") is None and target.last_cursor("t") is None
    assert target.append(rows(spark, ("a, \"b\"", 1), (" c\nd ", 2)), "t") == 2
    assert target.append(rows(spark, ("2024-02-01", "e"), schema="updated_at string, name string"), "t") == 1
    assert target.append(rows(spark, (3, "f"), schema="age int, name string"), "t") == 1
    got = target.read("t")
    assert set(got.columns) == {"name", "age", "updated_at"}
    if kind == "csv":  # read by position
        assert got.columns == ["name", "age", "updated_at"]
    assert {(r["name"], r["age"] and int(r["age"]), r["updated_at"]) for r in got.collect()} == {
        ("a, \"b\"", 1, None), (" c\nd ", 2, None), ("e", None, "2024-02-01"), ("f", 3, None)}
    assert target.read("t", limit=2).count() == 2
    assert target.last_cursor("t") == "2024-02-01" and target.last_cursor("t", "nope") is None


@pytest.mark.parametrize("kind", ["csv", "parquet", "text"])
def test_target_upsert(spark, tmp_path, kind):
    target = open_target(spark, kind, str(tmp_path / kind))
    assert target.upsert(rows(spark, ("a", 1), ("b", 2)), "t", ["name"]) == 2
    assert target.upsert(rows(spark, ("b", 3, "x"), ("c", 4, "y"), schema="name string, age int, more string"), "t", ["name"]) == 2
    got = sorted((r["name"], int(r["age"]), r["more"]) for r in target.read("t").collect())
    assert got == [("a", 1, None), ("b", 3, "x"), ("c", 4, "y")]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_repeated_part_does_not_double(spark, tmp_path, kind):
    target = open_target(spark, kind, str(tmp_path))
    for _ in range(2):
        target.append(rows(spark, ("a", 1)), "t", part="p1")
    target.append(rows(spark, ("b", 2)), "t")
    assert sorted(r["name"] for r in target.read("t").collect()) == ["a", "b"]


def test_append_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema("name string, age int").parquet(src)
    for batch in ([("a", 1)], [("a", 1), ("b", 3)]):
        rows(spark, *batch).write.mode("append").parquet(src)
        flows.stream_sync(stream, "csv", out, "t", state).awaitTermination()
    assert sorted(map(tuple, open_target(spark, "csv", out).read("t").collect())) == [("a", "1"), ("a", "1"), ("b", "3")]


def test_nested_values_become_json(spark, tmp_path):
    df = spark.createDataFrame([("n", {"k": 1}, [1, 2])], "name string, meta map<string,int>, tags array<int>")
    for kind in ("csv", "text"):
        target = open_target(spark, kind, str(tmp_path / kind))
        target.append(df, "t")
        row = target.read("t").first()
        assert row["meta"] == '{"k":1}' and row["tags"] == "[1,2]"


def test_factory(spark):
    assert isinstance(open_target(spark, "Postgres", "jdbc:x"), JdbcTarget)
    with pytest.raises(ValueError):
        open_target(spark, "mongodb", "x")


def test_foreign_csv_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("b,a\n1,2\n", encoding="utf-8")
    target = open_target(spark, "csv", str(tmp_path))
    target.append(rows(spark, ("9", "8"), schema="a string, b string"), "t")
    assert sorted((r["a"], r["b"]) for r in target.read("t").collect()) == [("2", "1"), ("9", "8")]


def test_mapping(spark):
    df = rows(spark, (1, 2, 3), schema="a int, b int, c int")
    assert Y.map_fields(df, None) is df and Y.map_fields(df, {}) is df

    def mapped(mapping):
        out = Y.map_fields(df, mapping)
        return list(zip(out.columns, out.first(), strict=True))
    assert mapped({"b": "x", "nope": "y"}) == [("x", 2), ("a", 1), ("c", 3)]
    assert mapped({"a": "x", "b": "x"}) == [("x", 2), ("c", 3)]
    assert mapped({"a": "c"}) == [("c", 3), ("b", 2)]  # the unmapped column wins


def test_table_names(spark):
    urls = ["https://site.example/a/b?x=1", "https://site.example/" + "a" * 200, "https://", "http://x--y__z/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    names = [r[0] for r in df.select(table_name("u")).collect()]
    assert names[0] == "site_example_a_b_x_1" and len(names[1]) == 64 and names[2] == "site_table" and names[3] == "x_y_z"
    assert df.select(table_name("u", "other")).collect()[2][0] == "other"


def test_small_text_functions(spark):
    row = spark.sql("SELECT 'aaaa <li <LI' AS t, timestamp'2024-01-02 03:04:05.006' AS ts").select(
        count_of("t", "aa").alias("n"), count_of("t", "<li").alias("li"), iso_utc("ts").alias("ts")).first()
    assert (row["n"], row["li"], row["ts"]) == (2, 1, "2024-01-02T03:04:05.006000Z")


def test_run_task(spark, tmp_path):
    tasks = Y.register_tasks(spark.createDataFrame(
        [("t1", "s", "https://d.example/list", "parquet", str(tmp_path / "d"), {"Name": "name"}),
         ("t2", "s", "https://d.example/list", "odd", "x", None)],
        "id string, site_id string, source_url string, target_type string, target_path string, field_mapping map<string,string>"))
    data = rows(spark, ("a", 1), ("b", 2), schema="Name string, age int")
    log = str(tmp_path / "log")
    reports = [Y.run_sync(tasks, "t1", data, log), Y.run_sync(tasks, "t1", data, log), Y.run_sync(tasks, "t2", data, log)]
    assert [(r.status, r.rows_written) for r in reports] == [("success", 2), ("success", 2), ("failed", 0)]
    assert "odd" in reports[2].error
    assert open_target(spark, "parquet", str(tmp_path / "d")).read("d_example_list").columns == ["name", "age"]
    booked = {r["id"]: r for r in Y.apply_reports(tasks, Y.report_rows(spark, reports)).collect()}
    assert booked["t1"]["rows_synced"] == 4 and booked["t1"]["status"] == "success" and booked["t1"]["last_synced_at"]
    assert booked["t2"]["status"] == "failed" and booked["t2"]["error_message"] and booked["t2"]["last_synced_at"] is None
    events = spark.read.schema(LOG_LINE).json(log).withColumn("detail", F.to_json("detail")).collect()
    assert sorted(e["outcome"] for e in events) == ["failure", "success", "success"]
    assert '{"rows":2}' in {e["detail"] for e in events}
    with pytest.raises(ValueError):
        Y.run_sync(tasks, "gone", data)


def test_cursor(spark):
    df = rows(spark, ("2024-01-02",), ("",), (None,), ("2024-01-10",), schema="updated_at string")
    assert last_cursor(df) == "2024-01-10"
    assert Y.after_cursor(df, "2024-01-05").count() == 1 and Y.after_cursor(df, None).count() == 4
    plan = Y.after_cursor(spark.range(5).withColumnRenamed("id", "updated_at"), "3")
    assert plan.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    src, state, out = (str(tmp_path / n) for n in ("src", "state", "out"))
    events = spark.range(100).select(F.lit("me").alias("actor"), F.concat(F.lit("a"), F.col("id") % 3).alias("action"),
                                     F.lit("success").alias("outcome"),
                                     F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 200).alias("ts"))
    for part in (events.filter("action <> 'a1'"), events.filter("action = 'a1'")):
        part.withColumn("ts", iso_utc("ts")).write.mode("append").json(src)
    counts = flows.audit_counts(flows.read_audit_stream(spark, src))
    flows.write_counts(counts, out, state).awaitTermination()
    batch = flows.audit_counts(events)
    got = flows.read_counts(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(got.columns).collect()))


def test_page_stream_drops_resent_snapshots(spark, tmp_path):
    src = str(tmp_path / "src")
    snaps = [("s", "u", "<a href=/x>a@b.cd</a>", 1), ("s", "u", "<p>other</p>", 2), ("s", "u", "<a href=/x>a@b.cd</a>", 3),
             ("s", "u", "<p>other</p>", 2)]
    df = spark.createDataFrame(snaps, "site_id string, url string, html string, n int")
    df.withColumn("collected_at", F.timestamp_seconds("n")).drop("n").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    pages, elements = str(tmp_path / "pages"), str(tmp_path / "elements")
    for _ in range(2):
        flows.write_pages(stream, pages, elements, str(tmp_path / "state")).awaitTermination()
    stored = spark.read.parquet(pages)
    assert stored.count() == 3 and stored.filter("html LIKE '%@%'").count() == 0
    assert stored.select("content_hash").distinct().count() == 2
    assert [r["label"] for r in spark.read.parquet(elements).collect()] == ["[REDACTED]"] * 2


def test_sync_stream_is_incremental(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema("name string, age int").parquet(src)
    for batch in ([("a", 1), ("b", 2)], [("b", 3)]):
        rows(spark, *batch).write.mode("append").parquet(src)
        flows.stream_sync(stream, "parquet", out, "t", state, {"name": "who"}, ["who"]).awaitTermination()
    assert sorted(map(tuple, open_target(spark, "parquet", out).read("t").collect())) == [("a", 1), ("b", 3)]


def test_page_stream_reads_a_table_of_part_files(spark, tmp_path):
    from workload.sync_queries import page_stream
    pages = spark.range(6).select(F.col("id").alias("page_id"), F.concat(F.lit("https://x.example/"), "id").alias("url"),
                                  F.concat(F.lit('<a href="/x">'), "id", F.lit("</a>")).alias("html"))
    pages.repartition(3).write.parquet(str(tmp_path / "parts" / "pages.parquet"))
    (tmp_path / "one").mkdir()
    pages.toPandas().to_parquet(tmp_path / "one" / "pages.parquet")
    for place in ("parts", "one"):
        rows = page_stream(spark, str(tmp_path / place)).collect()
        assert sorted((r["url"], r["n_elements"]) for r in rows) == [(f"https://x.example/{i}", 1) for i in range(6)]
