import json

from pyspark.sql import functions as F

from sitetable.operators import annotate as N
from sitetable.operators import pages as P
from sitetable.operators import steps as S
from sitetable.operators import training as R
from sitetable.schemas import TABLES, conform
from sitetable.sources.audit import LOG_LINE, audit_events, audit_rows, write_audit
from sitetable.sources.snapshots import boxed_elements, boxes, read_pages, requests, to_pages

RUNS = [("p1", "buy", 10.5, 12.0, [(0, "click", "success"), (1, "wait", "failed"), (2, "extract", "success")]),
        ("p1", "look", 11.0, 11.5, [(0, "click", "success")]),
        ("p2", "idle", 12.0, 12.0, [])]


def runs(spark):
    rows = [(page, goal, a, b, [(i, kind, status, 5, 0, None, f"h{i}", f"h{i + 1}", f"#s{i}", None, "") for i, kind, status in steps])
            for page, goal, a, b, steps in RUNS]
    return spark.createDataFrame(rows, S.RUN_LOG)


def test_ingest_and_rates(spark):
    logs = runs(spark)
    trajectories, steps = S.trajectories_from_logs(logs), S.steps_from_logs(logs)
    goals = {r["id"]: r["goal"] for r in trajectories.collect()}
    status = {r["goal"]: (r["status"], r["total_steps"], r["successful_steps"]) for r in trajectories.collect()}
    assert status == {"buy": ("failed", 3, 2), "look": ("success", 1, 1), "idle": ("success", 0, 0)}
    assert trajectories.filter("goal = 'buy'").first()["started_at"].microsecond == 500000
    assert steps.count() == 4 and steps.select("id").distinct().count() == 4
    rates = {goals[r["trajectory_id"]]: r["success_rate"] for r in S.success_rates(steps, trajectories).collect()}
    assert rates == {"buy": 2 / 3, "look": 1.0, "idle": 0.0}
    overall = {goals[r["trajectory_id"]]: r["overall_status"] for r in S.overall_status(steps, trajectories).collect()}
    assert overall == {"buy": "failed", "look": "success", "idle": "success"}  # no steps: success, yet rate 0.0
    totals = {goals[r["trajectory_id"]]: (r["total_steps"], r["successful_steps"])
              for r in S.step_totals(steps, trajectories).collect()}
    assert totals == {"buy": (3, 2), "look": (1, 1), "idle": (0, 0)}
    kept = S.until_first_failure(steps)
    assert sorted((goals[r["trajectory_id"]], r["step_index"]) for r in kept.collect()) == [
        ("buy", 0), ("buy", 1), ("look", 0)]
    assert [r["id"] for r in S.runs_with_status(trajectories, "failed", "p1").collect()] == [
        k for k, v in goals.items() if v == "buy"]


def test_run_logs_from_files(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text(json.dumps({"page_id": "p", "goal": "g", "started_at": 1.5, "finished_at": 2, "steps": [
        {"step_index": 0, "action_type": "click", "status": "success", "duration_ms": 3}]}) + "\n", encoding="utf-8")
    logs = S.read_runs(spark, str(tmp_path))
    step = S.steps_from_logs(logs).first()
    assert step["status"] == "success" and step["retry_count"] == 0
    assert S.trajectories_from_logs(logs).first()["id"] == step["trajectory_id"]


def test_dom_changes(spark):
    steps = spark.createDataFrame([("t", 0, "a", "a"), ("t", 1, "a", "b"), ("t", 2, "b", None), ("t", 5, "b", "c")],
                                  "trajectory_id string, step_index int, before_dom_hash string, after_dom_hash string")
    for chunk in (1, 2, 100):
        got = S.dom_changes(steps, chunk).orderBy("step_index").collect()
        assert [(r["changed_by_step"], r["changed_since_previous"]) for r in got] == [
            (False, None), (True, True), (None, None), (True, None)]


def test_replay_tries_all_selectors(spark, pages_of):
    elements = P.elements_table(pages_of('<a id=x href=/>x</a><button>b</button>'))
    steps = spark.createDataFrame(
        [("s1", "0", "#x", []), ("s2", "0", "#gone", ["#lost", "button"]), ("s3", "0", "#gone", None), ("s4", "0", None, [])],
        "id string, page_id string, selector string, fallback_selectors array<string>")
    got = {r["id"]: (r["resolved"], r["selector_rank"], r["resolved_selector"]) for r in S.replay(steps, elements).collect()}
    assert got == {"s1": (True, 0, "#x"), "s2": (True, 2, "button"), "s3": (False, None, None), "s4": (None, None, None)}


def tasks_and_submissions(spark):
    tasks = conform(spark.createDataFrame(
        [("t1", "p1", None, "page_type", 5, "pending"), ("t2", None, "j2", "preference", 6, "pending"),
         ("t3", None, "j3", "trajectory_failure", 8, "pending"), ("t4", "p4", None, "element_role", 5, "pending"),
         ("t5", "p5", None, "page_type", 9, "completed")],
        "id string, page_id string, trajectory_id string, annotation_type string, priority int, status string")
        .withColumn("created_at", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, int(substr(id, 2)))")), "annotation_tasks")
    rows = [("t1", "page_type", "a", "login", None, None, "[]", 1), ("t1", "page_type", "b", "form", None, None, "[]", 2),
            ("t2", "preference", "a", None, "j2", None, "[]", 1), ("t3", "trajectory_failure", "a", None, None, None, '[{"x":1}]', 1),
            ("t3", "trajectory_failure", "a", None, None, None, "[]", 2), ("t4", "element_role", "a", "field", None, None, "[]", 1),
            ("t9", "page_type", "a", "login", None, None, "[]", 1), ("t5", "page_type", "a", "", None, None, "[]", 1)]
    subs = spark.createDataFrame(rows, "annotation_task_id string, annotation_type string, annotator_id string, corrected_label string, "
                                 "chosen_trajectory_id string, rejected_trajectory_id string, steps string, n int")
    subs = subs.withColumn("corrected_steps", F.from_json("steps", "array<variant>")).withColumn("notes", F.lit(None).cast("string")) \
               .withColumn("submitted_at", F.expr("timestamp'2024-02-01' + make_dt_interval(n)")).drop("steps", "n")
    return tasks, subs


def test_submissions(spark):
    tasks, subs = tasks_and_submissions(spark)
    assert [r["annotation_task_id"] for r in N.unknown_submissions(tasks, subs).collect()] == ["t9"]
    done = {r["id"]: r for r in N.apply_submissions(tasks, subs).collect()}
    assert len(done) == 5 and all(r["status"] == "completed" for r in done.values())
    assert done["t1"]["annotator_id"] == "b" and done["t1"]["result"]["corrected_label"] == "form"
    records = N.records_from_submissions(tasks, subs)
    got = [(r["data_type"], r["trajectory_id"], json.loads(r["i"]), json.loads(r["o"])) for r in records.select(
        "data_type", "trajectory_id", F.to_json("input_payload").alias("i"),
        F.to_json("output_payload").alias("o")).orderBy("data_type", "o").collect()]
    assert got == [
        ("failure", "j3", {"trajectory_id": "j3"}, {"corrected_steps": [{"x": 1}]}),
        ("preference", "j2", {"annotation_task_id": "t2"}, {"chosen": "j2", "rejected": None}),
        ("sft", None, {"page_id": "p1", "annotation_type": "page_type"}, {"corrected_label": "form"}),
        ("sft", None, {"page_id": "p1", "annotation_type": "page_type"}, {"corrected_label": "login"})]
    assert records.select("id").distinct().count() == 4
    assert N.submission_audit(tasks, subs).count() == 7


def test_queues(spark):
    tasks, _ = tasks_and_submissions(spark)
    assert [r["id"] for r in N.pending_tasks(tasks).collect()] == ["t3", "t2", "t1", "t4"]
    assert N.pending_tasks(tasks, 2).count() == 2
    runs = spark.createDataFrame([("j3", "p", "g", "failed", 1), ("j4", "p", "g", "failed", 2), ("j5", "p", "g", "success", 3),
                                  ("j6", "p", "g", "success", 4), ("j7", "q", "g", "failed", 5)],
                                 "id string, page_id string, goal string, status string, n int") \
                .withColumn("finished_at", F.timestamp_seconds("n"))
    queued = N.queue_failures(runs, tasks)
    assert sorted(r["trajectory_id"] for r in queued.collect()) == ["j4", "j7"]
    assert queued.first()["priority"] == 8 and queued.first()["status"] == "pending"
    pairs = N.preference_pairs(runs)
    assert sorted((r["trajectory_id"], r["trajectory_b_id"]) for r in pairs.collect()) == [("j6", "j3"), ("j6", "j4")]
    assert {r["trajectory_b_id"] for r in N.queue_preferences(pairs).collect()} == {"j3", "j4"}


def records(spark, n=10):
    return R.create_records(spark.range(n).select(
        F.format_string("r%03d", "id").alias("id"), F.when(F.col("id") < n - 1, "sft").otherwise("failure").alias("data_type"),
        F.to_variant_object(F.struct(F.col("id").alias("idx"), F.lit("é").alias("text"))).alias("input_payload"),
        F.to_variant_object(F.struct(F.lit("x").alias("label"))).alias("output_payload"),
        F.when(F.col("id") % 4 == 3, "val").otherwise("train").alias("split")))


def test_export_once(spark, tmp_path):
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    first = R.export_records(records(spark), out, ledger, export_id="e1")
    assert sorted(map(tuple, first.collect())) == [("failure", "train", 1), ("sft", "train", 7), ("sft", "val", 2)]
    assert R.export_records(records(spark), out, ledger).count() == 0
    again = R.export_records(records(spark, 12), out, ledger, export_id="e2")
    # r009 was exported as a failure record, r010 and r011 are new
    assert sorted(map(tuple, again.collect())) == [("failure", "val", 1), ("sft", "train", 1)]
    files = [line for f in (tmp_path / "out").rglob("*.json") for line in f.read_text(encoding="utf-8").splitlines()]
    lines = [json.loads(line) for line in files]
    assert len(lines) == 12 and all(list(x) == ["id", "type", "split", "input", "output", "reward"] for x in lines)
    assert lines[0]["reward"] is None and any("é" in line for line in files)
    assert R.load_exported(spark, out, "sft").count() == 10
    assert R.load_exported(spark, out, "sft", "val").count() == 2


def test_repeated_export_id_does_not_double(spark, tmp_path):
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    R.export_records(records(spark), out, ledger, mark=False, export_id="e1")
    R.export_records(records(spark), out, ledger, export_id="e1")
    assert R.load_exported(spark, out).count() == 10
    assert R.unexported(records(spark), ledger=R.read_ledger(spark, ledger)).count() == 0


def test_split(spark):
    for n, f in ((10, 0.2), (10, 0.9), (10, 0.0), (10, 1.0), (1, 0.5), (57, 0.1), (0, 0.1)):
        rows = R.record_lines(records(spark, n)) if n else R.record_lines(records(spark, 1)).limit(0)
        train, val = R.split_train_val(rows, f)
        order = [r["id"] for r in sorted(rows.collect(), key=lambda r: (r["split"] != "train", r["id"]))]
        cut = max(1, int(n * (1 - f)))
        assert sorted(r["id"] for r in train.collect()) == sorted(order[:cut])
        assert sorted(r["id"] for r in val.collect()) == sorted(order[cut:])
    a, b = R.split_train_val(R.record_lines(records(spark, 200)), 0.3, method="hash")
    assert a.count() + b.count() == 200 and 20 < b.count() < 100


def test_jsonl_skips_blank_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id":"1","type":"sft","split":"train","input":{"a":1},"output":{},"reward":null}\n\n\n', encoding="utf-8")
    assert [r["id"] for r in R.read_jsonl(spark, str(path)).collect()] == ["1"]


def test_unexported_filters(spark):
    rows = records(spark)
    assert R.unexported(rows, "failure").count() == 1 and R.unexported(rows, limit=4).count() == 4
    assert R.unexported(rows.withColumn("exported", F.lit(True))).count() == 0


def test_audit(spark, tmp_path):
    events = audit_events(spark.range(2), F.lit("me"), F.lit("x.y"), F.lit("success"),
                          detail=F.when(F.col("id") == 0, F.parse_json(F.lit('{"rows":3}'))),
                          ts=F.expr("timestamp'2024-01-01 10:00:00'"))
    log, table = str(tmp_path / "logs" / "audit"), str(tmp_path / "table")
    write_audit(events, log, table)
    write_audit(events, log)
    lines = [json.loads(x) for f in (tmp_path / "logs" / "audit").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 4 and all(x["ts"] == "2024-01-01T10:00:00.000000Z" and x["ip_address"] is None for x in lines)
    assert sorted(json.dumps(x["detail"]) for x in lines) == ['{"rows": 3}'] * 2 + ["{}"] * 2
    assert spark.read.schema(LOG_LINE).json(log).count() == 4
    assert spark.read.parquet(table).count() == 2 and audit_rows(events).select("id").distinct().count() == 2


def test_to_pages_hashes_raw_html(spark):
    import hashlib
    html = "<p>a.b@c.de</p>"
    rows = spark.createDataFrame([("s", "u", html)], "site_id string, url string, html string")
    row = to_pages(rows, redacted=True).first()
    assert row["html"] == "<p>[REDACTED]</p>" and row["content_hash"] == hashlib.sha256(html.encode()).hexdigest()
    assert row["version"] == 1 and row["page_type"] == "unknown"


def test_read_pages(spark, tmp_path):
    rows = spark.createDataFrame([("s", "u", "<p>x</p>"), ("s", "v", None)], "site_id string, url string, html string")
    rows.write.parquet(str(tmp_path / "snaps"))
    pages = read_pages(spark, str(tmp_path / "snaps"))
    assert pages.count() == 2 and pages.filter("content_hash IS NULL").count() == 1
    assert pages.schema.names == TABLES["pages"].schema.names


def test_requests_and_boxes(spark, pages_of):
    har = "struct<requests:array<struct<url:string,method:string,resource_type:string,status:int>>>"
    page = spark.createDataFrame([("p", ([("u", "GET", "document", None), ("u", None, None, 301), ("u", None, None, 200),
                                          ("v", "GET", "image", None)],))], f"id string, har {har}")
    got = {r["url"]: (r["method"], r["status"], r["n_requests"], r["n_responses"]) for r in requests(page).collect()}
    assert got == {"u": ("GET", 301, 1, 2), "v": ("GET", None, 1, 0)}
    elements = P.elements_table(pages_of('<input id=i name=n><input name=n><a href=/>x</a>'))
    boxed = spark.createDataFrame([("0", [("input", "i", "n", "", None, None, 1., 1., 1., 1.), ("input", None, "n", "", None, None, 2., 1., 1., 1.),
                                          ("input", None, "n", "", None, None, 3., 1., 1., 1.)])],
                                  "id string, bounding_boxes array<struct<tag:string,id:string,name:string,text:string,role:string,"
                                  "aria_label:string,x:double,y:double,width:double,height:double>>")
    got = boxed_elements(elements, boxes(boxed)).orderBy("doc_pos").collect()
    assert [r["bounding_box"] and r["bounding_box"]["x"] for r in got] == [1.0, 2.0, None]


def test_replay_does_not_broadcast_the_elements(spark):
    pages = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("<a href=/x>x</a>").alias("html"))
    steps = pages.select("id", F.col("id").alias("page_id"), F.lit("#gone").alias("selector"), F.array(F.lit("a")).alias("fallback_selectors"))
    found = S.replay(steps, P.elements_table(pages))
    assert sorted(map(tuple, found.collect())) == [(str(i), str(i), True, 1, "a") for i in range(3)]
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
