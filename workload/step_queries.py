"""Queries over runs, annotation and training records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetable.functions.text import iso_utc
from sitetable.operators import annotate as N
from sitetable.operators import metrics as M
from sitetable.operators import steps as S
from sitetable.operators import training as R
from sitetable.session import scratch_dir
from sitetable.sources import audit
from workload.inputs import (RECORDS_SQL, STEPS_SQL, SUBMISSIONS_SQL, TASKS_SQL, TRAJECTORIES_SQL, USER_PAGES_SQL,
                             annotation_tasks, steps, submissions, table, text, training_records, trajectories,
                             user_pages, with_sql)
from workload.registry import query

_TS = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"


# -- run logs ------------------------------------------------------------------

def _run_logs(spark, sf):
    """One log per event: two steps, the second one failing on errors; purchases log no steps at all."""
    def entry(i, kind, status):
        return F.struct(F.lit(i).alias("step_index"), F.lit(kind).alias("action_type"), status.alias("status"),
                        F.col("user_id").cast("int").alias("duration_ms"), F.lit(i).alias("retry_count"),
                        F.lit(None).cast("string").alias("error_message"), F.lit("a").alias("before_dom_hash"),
                        F.lit("b").alias("after_dom_hash"), F.lit("#x").alias("selector"),
                        F.lit(None).cast("string").alias("value"), F.lit("").alias("description"))
    ok = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    log = F.array(entry(0, "click", F.lit("success")), entry(1, "wait", ok))
    return table(spark, sf, "events").select(
        text("event_id").alias("page_id"), F.col("event_type").alias("goal"),
        F.col("event_id").cast("double").alias("started_at"), (F.col("event_id") + 1).cast("double").alias("finished_at"),
        F.when(F.col("event_type") != "purchase", log).otherwise(F.array().cast(S.STEP_LOG)).alias("steps"))


@query("S15 A4", """
SELECT CAST(event_id AS VARCHAR) AS page_id, event_type AS goal,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE 2 END AS INTEGER) AS total_steps,
       CAST(CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS INTEGER) AS successful_steps,
       strftime(TIMESTAMP '1970-01-01' + to_seconds(event_id), '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at FROM events""")
def ingested_trajectories(spark, sf):
    return S.trajectories_from_logs(_run_logs(spark, sf)).select(
        "page_id", "goal", "status", "total_steps", "successful_steps", iso_utc("started_at").alias("started_at"))


@query("S15", """
SELECT action_type, step_index, CASE WHEN event_type = 'error' AND step_index = 1 THEN 'failed' ELSE 'success' END AS status,
       count(*) AS n_steps, CAST(sum(user_id) AS BIGINT) AS duration_ms
FROM (SELECT *, unnest(['click', 'wait']) AS action_type, unnest([0, 1]) AS step_index FROM events WHERE event_type <> 'purchase')
GROUP BY ALL""")
def ingested_steps(spark, sf):
    return S.steps_from_logs(_run_logs(spark, sf)).groupBy("action_type", "step_index", "status").agg(
        F.count("*").alias("n_steps"), F.sum("duration_ms").alias("duration_ms"))


# -- steps -----------------------------------------------------------------------

@query("K3", with_sql(STEPS_SQL, select="SELECT trajectory_id, step_index, action_type FROM steps"))
def ordered_steps(spark, sf):
    return S.in_order(steps(spark, sf)).select("trajectory_id", "step_index", "action_type")


@query("W2", with_sql(STEPS_SQL, select="""
SELECT trajectory_id, step_index, status FROM (
  SELECT *, min(CASE WHEN status = 'failed' THEN step_index END) OVER (PARTITION BY trajectory_id) AS stop FROM steps)
WHERE stop IS NULL OR step_index <= stop"""))
def steps_until_failure(spark, sf):
    return S.until_first_failure(steps(spark, sf)).select("trajectory_id", "step_index", "status")


@query("W6 E12", with_sql(STEPS_SQL, select="""
SELECT trajectory_id, step_index, before_dom_hash <> after_dom_hash AS changed_by_step,
       lag(after_dom_hash) OVER (PARTITION BY trajectory_id ORDER BY step_index) <> after_dom_hash AS changed_since_previous
FROM steps"""))
def dom_changes(spark, sf):
    return S.dom_changes(steps(spark, sf), chunk=3_600_000)


@query("A3", with_sql(STEPS_SQL, select="""
SELECT trajectory_id, round(avg(CASE WHEN status = 'success' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS success_rate
FROM steps GROUP BY 1 UNION ALL SELECT 'idle-' || c_custkey, 0.0 FROM customer"""))
def step_success_rates(spark, sf):
    return S.success_rates(steps(spark, sf), _with_idle(spark, sf)).select(
        "trajectory_id", F.round("success_rate", 6).alias("success_rate"))


def _with_idle(spark, sf):
    """Trajectories, and one per customer that has no steps."""
    idle = table(spark, sf, "customer").select(F.concat(F.lit("idle-"), text("c_custkey")).alias("id"))
    return trajectories(spark, sf).select("id").unionByName(idle)


@query("A4", with_sql(STEPS_SQL, select="""
SELECT trajectory_id, CASE WHEN bool_and(status = 'success') THEN 'success' ELSE 'failed' END AS overall_status
FROM steps GROUP BY 1 UNION ALL SELECT 'idle-' || c_custkey, 'success' FROM customer"""))
def overall_statuses(spark, sf):
    return S.overall_status(steps(spark, sf), _with_idle(spark, sf))


@query("A5", with_sql(STEPS_SQL, select=f"""
SELECT trajectory_id, count(*) AS total_steps, count(*) FILTER (status = 'success') AS successful_steps,
       {_TS.format('min(executed_at)')} AS started_at, {_TS.format('max(executed_at)')} AS finished_at
FROM steps GROUP BY 1"""))
def step_totals(spark, sf):
    return S.step_totals(steps(spark, sf)).select(
        "trajectory_id", "total_steps", "successful_steps", iso_utc("started_at").alias("started_at"),
        iso_utc("finished_at").alias("finished_at"))


@query("A14", with_sql(STEPS_SQL, select="""
SELECT action_type, count(*) AS n_steps, round(avg(retry_count), 6) AS avg_retries, max(retry_count) AS max_retries,
       round(avg(duration_ms), 4) AS avg_duration_ms, max(duration_ms) AS max_duration_ms,
       quantile_disc(duration_ms, 0.5) AS median_duration_ms FROM steps GROUP BY 1"""))
def effort_by_action(spark, sf):
    return S.effort_by_action(steps(spark, sf)).withColumn("avg_retries", F.round("avg_retries", 6)) \
        .withColumn("avg_duration_ms", F.round("avg_duration_ms", 4))


@query("J5", with_sql(STEPS_SQL, TRAJECTORIES_SQL, USER_PAGES_SQL, select="""
SELECT p.url AS url, t.goal AS goal, s.trajectory_id AS trajectory_id, s.step_index AS step_index, s.action_type AS action_type
FROM steps s JOIN trajectories t ON t.id = s.trajectory_id JOIN user_pages p ON p.id = t.page_id"""))
def page_runs(spark, sf):
    runs = S.page_runs(user_pages(spark, sf), trajectories(spark, sf), steps(spark, sf))
    return runs.select("url", "goal", "trajectory_id", "step_index", "action_type")


@query("P5", with_sql(TRAJECTORIES_SQL, select="SELECT page_id, id FROM trajectories WHERE status = 'success'"))
def successful_runs(spark, sf):
    return S.runs_with_status(trajectories(spark, sf), "success").select("page_id", "id")


@query("P6", with_sql(TRAJECTORIES_SQL, select="SELECT page_id, id FROM trajectories WHERE status = 'failed'"))
def failed_runs(spark, sf):
    return S.runs_with_status(trajectories(spark, sf), "failed").select("page_id", "id")


@query("J6", with_sql(TRAJECTORIES_SQL, select="""
SELECT f.page_id AS page_id, f.goal AS goal, ok.id AS trajectory_id, f.id AS trajectory_b_id
FROM trajectories f JOIN (
  SELECT page_id, goal, id FROM trajectories WHERE status = 'success'
  QUALIFY row_number() OVER (PARTITION BY page_id, goal ORDER BY finished_at DESC, id DESC) = 1) ok
  ON ok.page_id = f.page_id AND ok.goal = f.goal WHERE f.status = 'failed'"""))
def preference_pairs(spark, sf):
    return N.preference_pairs(trajectories(spark, sf))


@query("N1 J6", with_sql(TRAJECTORIES_SQL, select="""
SELECT 'preference' AS annotation_type, 6 AS priority, 'pending' AS status, ok.id AS trajectory_id, f.id AS trajectory_b_id,
       'Which trajectory is better?  Mark chosen vs rejected.' AS prompt
FROM trajectories f JOIN (
  SELECT page_id, goal, id FROM trajectories WHERE status = 'success'
  QUALIFY row_number() OVER (PARTITION BY page_id, goal ORDER BY finished_at DESC, id DESC) = 1) ok
  ON ok.page_id = f.page_id AND ok.goal = f.goal WHERE f.status = 'failed'"""))
def preference_tasks(spark, sf):
    return N.queue_preferences(N.preference_pairs(trajectories(spark, sf))).select(
        "annotation_type", "priority", "status", "trajectory_id", "trajectory_b_id", "prompt")


# -- annotation --------------------------------------------------------------------

@query("N1", with_sql(USER_PAGES_SQL, select="""
SELECT id AS page_id, 'page_type' AS annotation_type, 5 AS priority, 'pending' AS status,
       'Please verify or correct the detected page type.' AS prompt FROM user_pages
UNION ALL SELECT id, 'element_role', 9, 'pending', 'Please review element roles on this page.' FROM user_pages"""))
def queued_page_tasks(spark, sf):
    rows = user_pages(spark, sf).select(F.col("id").alias("page_id"))
    tasks = N.queue_tasks(rows, "page_type").unionByName(N.queue_tasks(rows, "element_role", priority=9))
    return tasks.select("page_id", "annotation_type", "priority", "status", "prompt")


@query("N2 N1", with_sql(TRAJECTORIES_SQL, select="""
SELECT id AS trajectory_id, 'trajectory_failure' AS annotation_type, 8 AS priority,
       'A step in this trajectory failed.  Please review and correct.' AS prompt
FROM trajectories WHERE status = 'failed' AND goal <> 'goal-1'"""))
def queued_failures(spark, sf):
    runs = trajectories(spark, sf)
    known = N.queue_tasks(runs.filter(F.col("goal") == "goal-1").select(F.col("id").alias("trajectory_id")),
                          "trajectory_failure")
    return N.queue_failures(runs, known).select("trajectory_id", "annotation_type", "priority", "prompt")


@query("K1", with_sql(TASKS_SQL, select="""
SELECT id, annotation_type, priority FROM tasks WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 20"""))
def pending_queue(spark, sf):
    return N.pending_tasks(annotation_tasks(spark, sf)).select("id", "annotation_type", "priority")


@query("J1", with_sql(TASKS_SQL, SUBMISSIONS_SQL, select="""
SELECT annotation_task_id, annotator_id FROM submissions WHERE annotation_task_id NOT IN (SELECT id FROM tasks)"""))
def rejected_submissions(spark, sf):
    return N.unknown_submissions(annotation_tasks(spark, sf), submissions(spark, sf)).select(
        "annotation_task_id", "annotator_id")


@query("N3 J1", with_sql(TASKS_SQL, SUBMISSIONS_SQL, select=f"""
SELECT t.id AS id, 'completed' AS status, s.annotator_id AS annotator_id, s.corrected_label AS corrected_label,
       s.rejected_trajectory_id AS rejected_trajectory_id, {_TS.format('s.submitted_at')} AS updated_at
FROM tasks t JOIN (SELECT * FROM submissions QUALIFY row_number() OVER (PARTITION BY annotation_task_id ORDER BY submitted_at DESC) = 1) s
  ON s.annotation_task_id = t.id"""))
def completed_tasks(spark, sf):
    return N.apply_submissions(annotation_tasks(spark, sf), submissions(spark, sf)).select(
        "id", "status", "annotator_id", "result.corrected_label", "result.rejected_trajectory_id",
        iso_utc("updated_at").alias("updated_at"))


@query("N4 T1", with_sql(TASKS_SQL, SUBMISSIONS_SQL, select="""
SELECT CASE s.annotation_type WHEN 'page_type' THEN 'sft' WHEN 'preference' THEN 'preference' ELSE 'failure' END AS data_type,
       CASE s.annotation_type WHEN 'preference' THEN s.chosen_trajectory_id ELSE t.trajectory_id END AS trajectory_id,
       CASE s.annotation_type WHEN 'page_type' THEN '{"annotation_type":"page_type","page_id":"' || t.page_id || '"}'
         WHEN 'preference' THEN '{"annotation_task_id":"' || t.id || '"}'
         ELSE '{"trajectory_id":"' || t.trajectory_id || '"}' END AS input,
       CASE s.annotation_type WHEN 'page_type' THEN '{"corrected_label":"' || s.corrected_label || '"}'
         WHEN 'preference' THEN '{"chosen":"' || s.chosen_trajectory_id || '","rejected":' || coalesce('"' || s.rejected_trajectory_id || '"', 'null') || '}'
         ELSE '{"corrected_steps":' || s.corrected_steps || '}' END AS output,
       'train' AS split, FALSE AS exported
FROM submissions s JOIN tasks t ON t.id = s.annotation_task_id
WHERE s.annotation_type <> 'element_role' AND s.corrected_label IS NOT NULL"""))
def routed_records(spark, sf):
    return N.records_from_submissions(annotation_tasks(spark, sf), submissions(spark, sf)).select(
        "data_type", "trajectory_id", F.to_json("input_payload").alias("input"),
        F.to_json("output_payload").alias("output"), "split", "exported")


@query("N5 S12", with_sql(TASKS_SQL, SUBMISSIONS_SQL, select=f"""
SELECT 'annotator' AS actor, 'annotation.submit' AS action, 'success' AS outcome, 'annotation_task' AS resource_type,
       annotation_task_id AS resource_id, '{{}}' AS detail, {_TS.format('submitted_at')} AS created_at
FROM submissions WHERE annotation_task_id IN (SELECT id FROM tasks)"""))
def submission_audit(spark, sf):
    rows = audit.audit_rows(N.submission_audit(annotation_tasks(spark, sf), submissions(spark, sf)))
    return rows.select("actor", "action", "outcome", "resource_type", "resource_id",
                       F.to_json("detail").alias("detail"), iso_utc("created_at").alias("created_at"))


# -- audit log -----------------------------------------------------------------------

def audit_events(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return audit.audit_events(
        events, actor=text("user_id"), action=F.concat(F.lit("event."), F.col("event_type")),
        outcome=F.when(F.col("event_type") == "error", "failure").otherwise("success"), ts=F.col("ts"),
        resource_type=F.lit("event"), resource_id=text("event_id"), detail=F.parse_json("props"))


@query("S11 F6 S12", f"""
SELECT {_TS.format('ts')} AS ts, CAST(user_id AS VARCHAR) AS actor, 'event.' || event_type AS action,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
       CAST(event_id AS VARCHAR) AS resource_id, replace(props, ' ', '') AS detail FROM events""")
def audit_log_lines(spark, sf):
    log, rows = scratch_dir(spark, "audit-log"), scratch_dir(spark, "audit-rows")
    audit.write_audit(audit_events(spark, sf), log, rows)
    lines = spark.read.schema(audit.LOG_LINE).json(log)
    stored = spark.read.parquet(rows).select("resource_id")
    return lines.join(stored, "resource_id", "left_semi").select(
        "ts", "actor", "action", "outcome", "resource_id", F.to_json("detail").alias("detail"))


# -- training records ------------------------------------------------------------------

@query("P7", with_sql(RECORDS_SQL, select="SELECT id, data_type, split FROM records WHERE NOT exported AND data_type = 'sft'"))
def unexported_records(spark, sf):
    return R.unexported(training_records(spark, sf), "sft").select("id", "data_type", "split")


@query("P2", with_sql(RECORDS_SQL, select="""
SELECT id, data_type AS type, split, CAST(json_object('text', text) AS VARCHAR) AS input, CAST(json_object('role', role) AS VARCHAR) AS output, reward FROM records"""))
def record_lines(spark, sf):
    return R.record_lines(training_records(spark, sf)).withColumn("input", F.to_json("input")) \
            .withColumn("output", F.to_json("output"))


@query("A1", with_sql(RECORDS_SQL, select="SELECT data_type, split, count(*) AS n_records FROM records GROUP BY ALL"))
def record_counts(spark, sf):
    return R.record_counts(training_records(spark, sf))


def _export(spark, sf, **options):
    out, ledger = scratch_dir(spark, "training"), scratch_dir(spark, "ledger")
    return out, ledger, R.export_records(training_records(spark, sf), out, ledger, **options)


@query("T2 T3 S10", with_sql(RECORDS_SQL, select="""
SELECT data_type, split, count(*) AS n_records, 1 AS run FROM records WHERE NOT exported AND data_type = 'sft' GROUP BY ALL
UNION ALL SELECT data_type, split, count(*), 2 FROM records WHERE NOT exported AND data_type <> 'sft' GROUP BY ALL"""))
def exported_counts(spark, sf):
    """Export one type, then the rest: the ledger keeps the first from going out twice."""
    out, ledger, first = _export(spark, sf, data_type="sft")
    rest = R.export_records(training_records(spark, sf), out, ledger)
    return first.withColumn("run", F.lit(1)).unionByName(rest.withColumn("run", F.lit(2)))


@query("T4 S9 S10 U2", with_sql(RECORDS_SQL, select="""
SELECT id, data_type AS type, split, CAST(json_object('text', text) AS VARCHAR) AS input, reward FROM records WHERE NOT exported AND data_type = 'reward'"""))
def loaded_export(spark, sf):
    out, _, _ = _export(spark, sf)
    return R.load_exported(spark, out, "reward").select("id", "type", "split", F.to_json("input").alias("input"), "reward")


@query("T5 U2", with_sql(RECORDS_SQL, select="""
SELECT id, CASE WHEN place <= greatest(1, CAST(floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) AS BIGINT)) THEN 'train' ELSE 'val' END AS part
FROM (SELECT id, row_number() OVER (ORDER BY split <> 'train', id) AS place, count(*) OVER () AS n FROM records)"""))
def train_val_parts(spark, sf):
    train, val = R.split_train_val(R.record_lines(training_records(spark, sf)), 0.2)
    return train.select("id", F.lit("train").alias("part")).unionByName(val.select("id", F.lit("val").alias("part")))


@query("T5", with_sql(RECORDS_SQL, select="""
SELECT id, CASE WHEN CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) < 0.2 * 4294967296 THEN 'val' ELSE 'train' END AS part
FROM records"""))
def train_val_parts_by_hash(spark, sf):
    train, val = R.split_train_val(R.record_lines(training_records(spark, sf)), 0.2, method="hash")
    return train.select("id", F.lit("train").alias("part")).unionByName(val.select("id", F.lit("val").alias("part")))


@query("T6 T1", with_sql(STEPS_SQL, TRAJECTORIES_SQL, select="""
SELECT s.trajectory_id AS trajectory_id, 'sft' AS data_type,
       '{"goal":"' || goal || '","page_id":"' || page_id || '","step_index":' || step_index || '}' AS input,
       '{"action_type":"' || action_type || '","selector":"' || selector || '","value":null}' AS output
FROM steps s JOIN trajectories t ON t.id = s.trajectory_id WHERE t.status = 'success'"""))
def step_examples(spark, sf):
    return R.step_examples(trajectories(spark, sf), steps(spark, sf)).select(
        "trajectory_id", "data_type", F.to_json("input_payload").alias("input"),
        F.to_json("output_payload").alias("output"))


@query("T6 A3", with_sql(TRAJECTORIES_SQL, select="""
SELECT id AS trajectory_id, 'reward' AS data_type, '{"status":"' || status || '"}' AS output,
       round(successful_steps / total_steps, 6) AS reward FROM trajectories"""))
def reward_examples(spark, sf):
    return R.reward_examples(trajectories(spark, sf), steps(spark, sf)).select(
        "trajectory_id", "data_type", F.to_json("output_payload").alias("output"), F.round("reward", 6).alias("reward"))


@query("T6", with_sql(STEPS_SQL, select="""
SELECT trajectory_id, '{"failed_step":{"action_type":"error","error_message":null,"selector":"#f' || user_id
  || '","step_index":' || min(step_index) || '}}' AS output FROM steps WHERE status = 'failed' GROUP BY trajectory_id, user_id"""))
def failure_examples(spark, sf):
    return R.failure_examples(trajectories(spark, sf), steps(spark, sf)).select(
        "trajectory_id", F.to_json("output_payload").alias("output"))


# -- evaluation -----------------------------------------------------------------------

@query("A8", with_sql(TRAJECTORIES_SQL, select="""
SELECT goal, count(*) AS n_tasks, count(*) FILTER (status = 'success') AS n_success,
       round(avg(CASE WHEN status = 'success' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS success_rate FROM trajectories GROUP BY 1"""))
def task_success_by_goal(spark, sf):
    return M.task_success(trajectories(spark, sf), ["goal"]).withColumn("success_rate", F.round("success_rate", 6))


@query("A8", with_sql(TRAJECTORIES_SQL, USER_PAGES_SQL, select="""
SELECT site_id, page_type, count(*) AS n_tasks, count(*) FILTER (t.status = 'success') AS n_success,
       round(avg(CASE WHEN t.status = 'success' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS success_rate
FROM trajectories t JOIN user_pages p ON p.id = t.page_id GROUP BY ALL"""))
def task_success_by_site(spark, sf):
    return M.task_success(trajectories(spark, sf), ["site_id", "page_type"], user_pages(spark, sf)) \
            .withColumn("success_rate", F.round("success_rate", 6))


@query("A12", with_sql(TRAJECTORIES_SQL, USER_PAGES_SQL, select="""
SELECT count(DISTINCT site_id) AS n_sites, count(*) AS n_tasks, count(*) FILTER (t.status = 'success') AS n_success,
       round(avg(CASE WHEN t.status = 'success' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS success_rate
FROM trajectories t JOIN user_pages p ON p.id = t.page_id
WHERE CAST('0x' || substr(md5(site_id), 1, 8) AS BIGINT) < 0.4 * 4294967296"""))
def held_out_success(spark, sf):
    return M.held_out_success(trajectories(spark, sf), user_pages(spark, sf), 0.4) \
            .withColumn("success_rate", F.round("success_rate", 6))


def _label_pairs(spark, sf):
    """Predicted against labelled: the document's language group against its quality and toxicity."""
    from sitetable.schemas import ELEMENT_ROLES
    roles = F.array(*[F.lit(r) for r in ELEMENT_ROLES])
    return table(spark, sf, "labels").select(
        F.element_at(roles, (F.col("doc_id") % 4 + 1).cast("int")).alias("predicted"),
        F.element_at(roles, (F.col("doc_id") % 3 + F.col("quality") + 1).cast("int")).alias("actual"))


_PAIRS = """pairs AS (
  SELECT roles[doc_id % 4 + 1] AS predicted, roles[doc_id % 3 + quality + 1] AS actual
  FROM (SELECT *, ['field', 'action', 'navigation', 'status', 'data', 'pagination', 'unknown'] AS roles FROM labels))"""


@query("A11", with_sql(_PAIRS, select="""
SELECT role, CAST(sum(p) AS BIGINT) AS n_predicted, CAST(sum(a) AS BIGINT) AS n_actual, CAST(sum(h) AS BIGINT) AS n_hit,
       round(coalesce(sum(h) / nullif(sum(p), 0), 0), 6) AS precision, round(coalesce(sum(h) / nullif(sum(a), 0), 0), 6) AS recall,
       round(coalesce(2 * sum(h) / nullif(sum(p) + sum(a), 0), 0), 6) AS f1
FROM (SELECT predicted AS role, 1 AS p, 0 AS a, CASE WHEN predicted = actual THEN 1 ELSE 0 END AS h FROM pairs
      UNION ALL SELECT actual, 0, 1, 0 FROM pairs) GROUP BY 1"""))
def role_scores(spark, sf):
    scores = M.role_scores(_label_pairs(spark, sf))
    return scores.select("role", "n_predicted", "n_actual", "n_hit",
                         *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("A10", with_sql(_PAIRS, select="SELECT predicted, actual, count(*) AS n_rows FROM pairs GROUP BY ALL"))
def label_confusion(spark, sf):
    return M.confusion(_label_pairs(spark, sf))


@query("A10", with_sql(TASKS_SQL, SUBMISSIONS_SQL, select="""
SELECT count(*) AS n_rows, count(*) FILTER (guess = corrected_label) AS n_correct,
       round(avg(CASE WHEN guess = corrected_label THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy
FROM (SELECT s.corrected_label, 'label-' || (CAST(t.id AS BIGINT) % 2) AS guess FROM tasks t
      JOIN (SELECT * FROM submissions QUALIFY row_number() OVER (PARTITION BY annotation_task_id ORDER BY submitted_at DESC) = 1) s
        ON s.annotation_task_id = t.id WHERE t.annotation_type = 'page_type' AND s.corrected_label IS NOT NULL)"""))
def page_type_accuracy(spark, sf):
    tasks = annotation_tasks(spark, sf)
    done = N.apply_submissions(tasks, submissions(spark, sf))
    guessed = tasks.select(F.col("page_id").alias("id"),
                           F.concat(F.lit("label-"), text(F.col("id").cast("long") % 2)).alias("page_type"))
    return M.accuracy(M.page_type_pairs(guessed, done)).withColumn("accuracy", F.round("accuracy", 6))


@query("A13", """
WITH v AS (SELECT value AS x, user_id + floor(value) AS y FROM events),
ranked AS (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v)
SELECT count(*) AS n_rows, round(corr(rx, ry), 6) AS rho FROM ranked""")
def reward_rank_correlation(spark, sf):
    events = table(spark, sf, "events").select(F.col("value").alias("x"),
                                               (F.col("user_id") + F.floor("value")).alias("y"))
    return M.spearman(events, "x", "y").withColumn("rho", F.round("rho", 6))
