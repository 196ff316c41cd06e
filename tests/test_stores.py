"""Stores that keep what they have: types, versions, late snapshots, cursors."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from sitetable.functions import pii
from sitetable.operators import sync as Y
from sitetable.sources.snapshots import to_pages
from sitetable.sources.targets import open_target
from sitetable.streaming import flows


def test_types_are_aligned_or_refused(spark, tmp_path):
    target = open_target(spark, "parquet", str(tmp_path))
    target.append(spark.sql("SELECT 1L AS n, 'a' AS s"), "t")
    target.append(spark.sql("SELECT 2 AS n, 5 AS s"), "t")
    assert sorted(map(tuple, target.read("t").collect())) == [(1, "a"), (2, "5")]
    for bad in ("SELECT 'x' AS n", "SELECT 1.5D AS n"):
        with pytest.raises(ValueError, match="n: "):
            target.append(spark.sql(bad), "t")
        with pytest.raises(ValueError, match="n: "):
            target.upsert(spark.sql(bad), "t", ["n"])
    assert target.read("t").count() == 2


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_unfinished_writes_are_not_read(spark, tmp_path, kind):
    target = open_target(spark, kind, str(tmp_path))
    target.append(spark.sql("SELECT 'a' AS k, '1' AS `unit.price`"), "t")
    for price in ("2", "3", "4"):
        target.upsert(spark.sql(f"SELECT 'a' AS k, '{price}' AS `unit.price`"), "t", ["k"])
    target.append(spark.sql("SELECT 'b' AS k, '9' AS `unit.price`"), "t")
    for keys in (None, ["k"]):
        target._write(spark.sql("SELECT 'lost' AS k, '0' AS `unit.price`"), "t", "rows", keys, 16)
    assert sorted(map(tuple, target.read("t").collect())) == [("a", "4"), ("b", "9")]
    assert sorted(map(tuple, open_target(spark, kind, str(tmp_path)).read("t").collect())) == [("a", "4"), ("b", "9")]


def test_two_csv_writers_add_columns_at_once(spark, tmp_path):
    target = open_target(spark, "csv", str(tmp_path))
    target.append(spark.sql("SELECT 'a' AS k"), "t")
    together = threading.Barrier(2)
    write = target._write

    def slow(*args, **about):
        out = write(*args, **about)
        together.wait()
        return out

    target._write = slow
    writers = [threading.Thread(target=target.append, args=(spark.sql(f"SELECT 'k{c}' AS k, '{c}' AS {c}"), "t")) for c in ("x", "y")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    rows = {r["k"]: (r["x"], r["y"]) for r in target.read("t").collect()}
    assert rows == {"a": (None, None), "kx": ("x", None), "ky": (None, "y")}


def _task(spark, path, url="https://d.example/list", kind="parquet", name="t1"):
    return Y.register_tasks(spark.createDataFrame(
        [(name, "s", url, kind, path)], "id string, site_id string, source_url string, target_type string, target_path string"))


def test_two_step_increment(spark, tmp_path):
    tasks = _task(spark, str(tmp_path / "d"))
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-02-01")], "id int, updated_at string")
    assert Y.stored_cursor(tasks, "t1") is None
    for part in (rows.filter("id < 3"), rows):
        new = Y.after_cursor(part, Y.stored_cursor(tasks, "t1"))
        report = Y.run_sync(tasks, "t1", new, str(tmp_path / "log"), cursor="updated_at", audit_table=str(tmp_path / "audit"))
        tasks = Y.apply_reports(tasks, Y.report_rows(spark, [report]))
    assert Y.stored_cursor(tasks, "t1") == "2024-02-01"
    assert open_target(spark, "parquet", str(tmp_path / "d")).read("d_example_list").count() == 3
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    nothing = Y.run_sync(tasks, "t1", rows.limit(0), cursor="updated_at")
    assert Y.stored_cursor(Y.apply_reports(tasks, Y.report_rows(spark, [nothing])), "t1") == "2024-02-01"


def test_copies_of_a_key_need_an_order(spark, tmp_path):
    tasks = _task(spark, str(tmp_path / "d"))
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    assert "repeat a key" in Y.run_sync(tasks, "t1", rows, keys=["k"]).error
    assert Y.run_sync(tasks, "t1", rows, keys=["k"], order=["n"]).status == "success"
    assert [tuple(r) for r in open_target(spark, "parquet", str(tmp_path / "d")).read("d_example_list").collect()] == [("a", 2)]


def test_repeated_run_under_a_part(spark, tmp_path):
    tasks = _task(spark, str(tmp_path / "d"))
    for _ in range(2):
        Y.run_sync(tasks, "t1", spark.range(3), part="run-1")
    assert open_target(spark, "parquet", str(tmp_path / "d")).read("d_example_list").count() == 3


def test_long_urls_do_not_share_a_table():
    same = "https://site.example/" + "a" * 80
    names = [Y.task_table(same + end) for end in ("/one", "/two")]
    assert names[0] != names[1] and all(len(n) == 64 for n in names)
    assert Y.task_table("https://") == "site_table" and Y.task_table("http://x--y__z/") == "x_y_z"


def test_runs_side_by_side(spark, tmp_path):
    tasks = _task(spark, str(tmp_path / "a")).union(_task(spark, str(tmp_path / "b"), kind="odd", name="t2"))
    reports = Y.run_syncs(tasks, {"t1": spark.range(2), "t2": spark.range(2)})
    assert [(r.task_id, r.status, r.rows_written) for r in reports] == [("t1", "success", 2), ("t2", "failed", 0)]


def test_late_snapshots_are_kept_whole(spark, tmp_path):
    src, pages, elements = (str(tmp_path / n) for n in ("src", "pages", "elements"))

    def send(*hours):
        spark.createDataFrame([("s", f"u{h}", "<p>a@b.cd</p>", "ann a@b.cd", h) for h in hours],
                              "site_id string, url string, html string, title string, h int").select(
            "site_id", "url", "html", "title", F.timestamp_seconds(F.col("h") * 3600).alias("collected_at"),
            F.parse_json(F.lit('{"token":"abc","note":"a@b.cd","n":1}')).alias("meta"),
            F.parse_json(F.lit('{"name":"a@b.cd"}')).alias("accessibility_tree")).write.mode("append").parquet(src)

    send(1000)
    schema = spark.read.parquet(src).schema
    for hours in ((), (1000, 9), (9, 2000)):
        if hours:
            send(*hours)
        flows.write_pages(spark.readStream.schema(schema).parquet(src), pages, elements, str(tmp_path / "state")).awaitTermination()
    stored = spark.read.parquet(pages)
    assert sorted(r["url"] for r in stored.collect()) == ["u1000", "u2000", "u9"]
    row = stored.select("title", "html", F.to_json("meta").alias("m"), F.to_json("accessibility_tree").alias("t")).first()
    box = pii.PLACEHOLDER
    assert tuple(row) == (f"ann {box}", f"<p>{box}</p>", f'{{"n":1,"note":"{box}","token":"{box}"}}', f'{{"name":"{box}"}}')
    assert not os.listdir(pages + "-parsed")


def test_redacted_pages_hold_no_text_unredacted(spark):
    rows = spark.sql("""SELECT 's' AS site_id, 'https://a.b/c' AS url, 'x a@b.cd' AS title, '<p>a@b.cd</p>' AS html,
        array(named_struct('tag', 'a', 'id', 'i', 'name', 'n', 'text', 'a@b.cd', 'role', 'r', 'aria_label', 'a@b.cd',
                           'x', 1D, 'y', 1D, 'width', 1D, 'height', 1D)) AS bounding_boxes,
        named_struct('requests', array(named_struct('url', 'https://x/?m=a@b.cd', 'method', 'GET', 'resource_type', 'xhr',
                                                    'status', 200))) AS har,
        parse_json('[{"name": "a@b.cd", "password": "p"}, "a@b.cd"]') AS accessibility_tree""")
    row = to_pages(rows, redacted=True).drop("content_hash").select(F.to_json(F.struct("*")).alias("j")).first()["j"]
    assert "a@b.cd" not in row and '"p"' not in row and '"url":"https://a.b/c"' in row and '"status":200' in row


def test_json_of_any_shape_row_by_row(spark):
    texts = ['{"a":{"Password":{"x":1},"deep":[{"token":5,"t":"a@b.cd"},[["a@b.cd"]]]}}', '{"a":"a@b.cd"}',
             '{"a":[1,{"a":"a@b.cd"}],"n":1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    box = pii.PLACEHOLDER
    want = [f'{{"a":{{"Password":"{box}","deep":[{{"token":"{box}","t":"{box}"}},[["a@b.cd"]]]}}}}', f'{{"a":"{box}"}}',
            f'{{"a":[1,{{"a":"{box}"}}],"n":1}}']
    assert [r["t"] for r in pii.redact_json(df, "t").orderBy("i").collect()] == want
