"""Tables under concurrent writers: commits, buckets, deltas, compaction, what is opened and what is not."""

import glob
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from sitetable.operators import sync as Y
from sitetable.session import create_if_absent, read_text
from sitetable.sources import tablelog, targets
from sitetable.sources.targets import open_target


def files(path):
    return {f for f in glob.glob(f"{path}/**/*", recursive=True) if os.path.isfile(f) and "/_log/" not in f}


def rows_of(target, table="t"):
    return sorted((tuple(r.asDict().items()) for r in target.read(table).collect()), key=repr)


def test_a_file_is_created_once(spark, tmp_path):
    path, wins = str(tmp_path / "n" / "0.json"), []
    threads = [threading.Thread(target=lambda i=i: wins.append((create_if_absent(spark, path, str(i)), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [ok for ok, _ in wins].count(True) == 1
    assert read_text(spark, path) == str(next(i for ok, i in wins if ok))
    assert os.listdir(tmp_path / "n") == ["0.json"]


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    target = open_target(spark, "parquet", str(tmp_path))
    target.upsert(spark.range(1000).select("id", F.lit("old").alias("v")), "t", ["id"])
    before = {f: os.stat(f).st_mtime_ns for f in files(tmp_path / "t")}
    few = spark.range(10, 13).select("id", F.lit("new").alias("v"))
    touched = {r[0] for r in few.select(targets.bucket_of(["id"], targets.N_BUCKETS)).collect()}
    target.upsert(few, "t", ["id"])
    after = {f: os.stat(f).st_mtime_ns for f in files(tmp_path / "t")}
    assert before.items() <= after.items()
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in after.keys() - before.keys() if "_bucket" in f} == touched
    assert target.read("t").groupBy("v").count().sort("v").collect() == [("new", 3), ("old", 997)]
    plan = target.read("t").filter("id = 500")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") >= 2  # settled buckets are read without a join


def test_only_full_buckets_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(targets, "MOST_DELTAS", 3)
    target = open_target(spark, "parquet", str(tmp_path))
    target.upsert(spark.range(200).select("id", F.lit(0).alias("n")), "t", ["id"])
    hot = spark.range(1).select("id", targets.bucket_of(["id"], targets.N_BUCKETS)).first()[1]
    for n in range(1, 8):
        target.upsert(spark.range(1).select("id", F.lit(n).alias("n")), "t", ["id"])
    state = target.log("t").state()
    assert sum(hot in p.buckets for p in state.of_kind(tablelog.DELTA)) < 3
    whole = max(state.of_kind(tablelog.DELTA), key=lambda p: p.rows)
    assert whole.rows == 200 and whole.cut and hot not in whole.buckets  # the rest of the first upsert lies where it lay
    assert {r["id"]: r["n"] for r in target.read("t").collect()} == {i: 7 if i == 0 else 0 for i in range(200)}


@pytest.mark.parametrize("kind", ["parquet", "csv"])
@pytest.mark.parametrize("seed", [1, 2])
def test_any_sequence_of_writes_equals_the_model(spark, tmp_path, monkeypatch, kind, seed):
    monkeypatch.setattr(targets, "MOST_DELTAS", 2 + seed)
    rng, model, columns = random.Random(seed), [], []
    target = open_target(spark, kind, str(tmp_path), )
    for step in range(9):
        names = ["k", *rng.sample(["a", "b", "c\n.d"], rng.randint(1, 2))]
        given = [{n: (rng.choice(["x", "y", "z", None, "w w"]) if n == "k" else f"{step}\n{i}" if rng.random() < .8 else None)
                  for n in names} for i in range(rng.randint(1, 4))]
        columns += [n for n in names if n not in columns]
        df = spark.createDataFrame([tuple(r.values()) for r in given], ", ".join(f"`{n}` string" for n in names))
        if rng.random() < .4:
            target.append(df, "t")
            model += [dict(r) for r in given]
        else:
            df = df.withColumn("order", F.lit(0)) if False else df
            best = {r["k"]: r for r in given}
            df = spark.createDataFrame([tuple(r.values()) for r in best.values()], df.schema)
            assert target.upsert(df, "t", ["k"]) == len(best)
            for k, r in best.items():
                same = [m for m in model if m["k"] == k]
                for m in same:
                    m.update(r)
                if not same:
                    model.append(dict(r))
    expected = sorted((tuple((c, m.get(c)) for c in columns) for m in model), key=repr)
    assert rows_of(target) == expected
    assert rows_of(open_target(spark, kind, str(tmp_path))) == expected


@pytest.mark.parametrize("round_", range(3))
def test_writers_that_meet_lose_nothing(spark, tmp_path, round_):
    path, together = str(tmp_path), threading.Barrier(4)
    if round_:
        open_target(spark, "parquet", path).append(spark.range(1000, 1100).select("id", F.lit("old").alias("v")), "t")
    errors = []

    def write(job):
        try:
            target = open_target(spark, "parquet", path)
            together.wait()
            job(target)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    named = lambda low, high, v: spark.range(low, high).select("id", F.lit(v).alias("v"))
    jobs = [lambda t: t.upsert(named(0, 100, "one"), "t", ["id"]), lambda t: t.upsert(named(100, 200, "two"), "t", ["id"]),
            lambda t: t.append(named(200, 300, "three"), "t"),
            lambda t: t.append(named(300, 400, "four").withColumn("more", F.lit(1)), "t", part="p")]
    threads = [threading.Thread(target=write, args=(job,)) for job in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    target = open_target(spark, "parquet", path)
    target.upsert(named(200, 210, "again"), "t", ["id"])
    counts = {r[0]: r[1] for r in target.read("t").groupBy("v").count().collect()}
    assert counts == {"one": 100, "two": 100, "three": 90, "again": 10, "four": 100} | ({"old": 100} if round_ else {})
    assert target.read("t").filter("more = 1").count() == 100


def test_syncs_to_one_table_side_by_side(spark, tmp_path):
    tasks = Y.register_tasks(spark.createDataFrame(
        [(n, "s", "https://d.example/list", "parquet", str(tmp_path)) for n in ("t1", "t2", "t3")],
        "id string, site_id string, source_url string, target_type string, target_path string"))
    rows = {f"t{i}": spark.range(100 * i, 100 * i + 100).select("id", F.lit(i).alias("n")) for i in (1, 2, 3)}
    assert [r.status for r in Y.run_syncs(tasks, rows, keys=["id"])] == ["success"] * 3
    assert open_target(spark, "parquet", str(tmp_path)).read("d_example_list").count() == 300


def test_neither_reads_nor_appends_open_old_files(spark, tmp_path):
    target = open_target(spark, "parquet", str(tmp_path))
    for i in range(5):
        target.append(spark.range(3).select("id", F.lit(i).alias(f"c{i}")), "t")
    for f in files(tmp_path / "t"):
        if f.endswith(".parquet"):
            with open(f, "wb") as broken:
                broken.write(b"no parquet")
    assert target.append(spark.range(2), "t") == 2
    target = open_target(spark, "parquet", str(tmp_path))
    assert target.read("t").columns == ["id", *(f"c{i}" for i in range(5))]
    assert sum(p.rows for p in target.log("t").state().parts.values()) == 17


def test_many_commits_and_checkpoints(spark, tmp_path, monkeypatch):
    log = tablelog.TableLog(spark, str(tmp_path / "t"))
    for i in range(70):
        log.commit(lambda now, i=i: tablelog.Entry((tablelog.Part(f"part={i}", tablelog.ROWS, i, ("a",), name=f"p{i}"),),
                                                   (f"part={i - 1}",) if i % 2 else ()))
    assert any(n.startswith("checkpoint-") for n in os.listdir(tmp_path / "t" / "_log"))
    opened = []
    monkeypatch.setattr(tablelog, "read_text", lambda s, path: opened.append(path) or read_text(s, path))
    again = tablelog.TableLog(spark, str(tmp_path / "t")).state()
    assert again == log.state() and again.version == 69 and len(again.parts) == 35
    assert len(opened) <= 1 + tablelog.CHECKPOINT


def test_parts_that_were_merged_are_not_appended_again(spark, tmp_path):
    target = open_target(spark, "parquet", str(tmp_path))
    target.append(spark.range(3), "t", part="batch-1")
    target.upsert(spark.range(5), "t", ["id"])
    assert target.append(spark.range(3), "t", part="batch-1") == 3
    assert target.read("t").count() == 5


def test_keys_may_change_and_nulls_are_keys(spark, tmp_path):
    target = open_target(spark, "parquet", str(tmp_path))
    target.upsert(spark.sql("SELECT 1 AS a, 'x' AS b UNION ALL SELECT NULL, 'y'"), "t", ["a"])
    target.upsert(spark.sql("SELECT CAST(NULL AS INT) AS a, 'z' AS b"), "t", ["a"])
    assert rows_of(target) == [(("a", 1), ("b", "x")), (("a", None), ("b", "z"))]
    target.upsert(spark.sql("SELECT 5 AS a, 'z' AS b"), "t", ["b"])
    assert rows_of(target) == [(("a", 1), ("b", "x")), (("a", 5), ("b", "z"))]


def test_files_of_others_become_rows(spark, tmp_path):
    spark.range(3).select("id", F.lit("theirs").alias("v")).coalesce(1).write.parquet(str(tmp_path / "t"))
    target = open_target(spark, "parquet", str(tmp_path))
    target.append(spark.range(3, 4), "t")
    assert target.read("t").count() == 4
    target.upsert(spark.sql("SELECT 1L AS id, 'ours' AS v"), "t", ["id"])
    assert rows_of(target) == [(("id", i), ("v", v)) for i, v in ((0, "theirs"), (1, "ours"), (2, "theirs"), (3, None))]
