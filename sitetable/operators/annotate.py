"""Human annotation: queues, submissions and the training records they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetable.functions.text import content_key
from sitetable.operators.tables import one_per_key
from sitetable.schemas import conform
from sitetable.sources.audit import audit_events

# Priority and default prompt per kind of task.
KINDS = {
    "page_type": (5, "Please verify or correct the detected page type."),
    "element_role": (5, "Please review element roles on this page."),
    "trajectory_failure": (8, "A step in this trajectory failed.  Please review and correct."),
    "preference": (6, "Which trajectory is better?  Mark chosen vs rejected."),
}

RESULT = ("corrected_label", "chosen_trajectory_id", "rejected_trajectory_id", "corrected_steps", "notes")


def queue_tasks(rows: DataFrame, kind: str, priority: int | None = None, prompt: str | None = None) -> DataFrame:
    """Annotation tasks for rows with page_id and/or trajectory_id (and trajectory_b_id for pairs)."""
    if kind not in KINDS:
        raise ValueError(f"unknown annotation kind: {kind!r}")
    default_priority, default_prompt = KINDS[kind]
    created = F.col("created_at") if "created_at" in rows.columns else F.current_timestamp()
    named = rows.select(
        *[F.col(c) for c in ("page_id", "trajectory_id", "trajectory_b_id") if c in rows.columns],
        F.lit(kind).alias("annotation_type"),
        F.lit(default_priority if priority is None else priority).alias("priority"),
        F.lit(prompt or default_prompt).alias("prompt"), created.alias("created_at"))
    tasks = conform(named.withColumn("updated_at", F.col("created_at")), "annotation_tasks")
    return tasks.withColumn("id", content_key("annotation_type", "page_id", "trajectory_id", "trajectory_b_id",
                                              "created_at"))


def queue_failures(trajectories: DataFrame, tasks: DataFrame) -> DataFrame:
    """Failure tasks for failed trajectories that have none yet."""
    known = tasks.filter(F.col("annotation_type") == "trajectory_failure").select("trajectory_id")
    failed = trajectories.filter(F.col("status") == "failed").select(F.col("id").alias("trajectory_id"))
    return queue_tasks(failed.join(known, "trajectory_id", "left_anti"), "trajectory_failure")


def preference_pairs(trajectories: DataFrame) -> DataFrame:
    """Each failed trajectory (b) with the latest successful one (a) on the same page with the same goal.

    One partner per failed run, found by a partial aggregate: the result grows
    with the runs, not with their pairs.
    """
    where = F.struct("page_id", "goal")
    best = (trajectories.filter(F.col("status") == "success").groupBy(where.alias("_where"))
            .agg(F.max(F.struct("finished_at", "id")).getField("id").alias("trajectory_id")))
    failed = trajectories.filter(F.col("status") == "failed").select(
        where.alias("_where"), "page_id", "goal", F.col("id").alias("trajectory_b_id"))
    return failed.join(best, "_where").select("page_id", "goal", "trajectory_id", "trajectory_b_id")


def queue_preferences(pairs: DataFrame, priority: int | None = None) -> DataFrame:
    """Preference tasks for given pairs; the second trajectory is kept in ``trajectory_b_id``."""
    rows = pairs.select(*[c for c in ("trajectory_id", "trajectory_b_id", "created_at") if c in pairs.columns])
    return queue_tasks(rows, "preference", priority)


def pending_tasks(tasks: DataFrame, limit: int | None = 20) -> DataFrame:
    """The work queue: pending tasks, highest priority first, then oldest."""
    queue = tasks.filter(F.col("status") == "pending").orderBy(F.desc("priority"), "created_at", "id")
    return queue if limit is None else queue.limit(limit)


def unknown_submissions(tasks: DataFrame, submissions: DataFrame) -> DataFrame:
    """Submissions for tasks that do not exist: rejected, they complete nothing."""
    ids = tasks.select(F.col("id").alias("annotation_task_id"))
    return submissions.join(ids, "annotation_task_id", "left_anti")


def apply_submissions(tasks: DataFrame, submissions: DataFrame) -> DataFrame:
    """Tasks with their latest submission applied: completed, annotator and result set."""
    slim = submissions.select("annotation_task_id", "annotator_id", "submitted_at", F.struct(*RESULT).alias("result"))
    last = one_per_key(slim, ["annotation_task_id"], ["submitted_at", "annotator_id"]).select(
        F.col("annotation_task_id").alias("id"),
        F.struct("annotator_id", "submitted_at", "result").alias("_s"))
    done = F.col("_s").isNotNull()
    columns = tasks.columns
    return (tasks.join(last, "id", "left")
            .withColumn("status", F.when(done, "completed").otherwise(F.col("status")))
            .withColumn("annotator_id", F.when(done, F.col("_s.annotator_id")).otherwise(F.col("annotator_id")))
            .withColumn("result", F.when(done, F.col("_s.result")).otherwise(F.col("result")))
            .withColumn("updated_at", F.when(done, F.col("_s.submitted_at")).otherwise(F.col("updated_at")))
            .select(*columns))


def _truthy(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def records_from_submissions(tasks: DataFrame, submissions: DataFrame) -> DataFrame:
    """Training records, at most one per submission, routed by the submission's own annotation type.

    A corrected page type gives ``sft``, a chosen trajectory ``preference``,
    corrected steps ``failure``; other kinds and empty payloads give none.
    """
    known = tasks.select(F.col("id").alias("annotation_task_id"), "page_id",
                         F.col("trajectory_id").alias("_trajectory"))
    s = submissions.join(known, "annotation_task_id")
    kind = F.col("annotation_type")
    sft = (kind == "page_type") & _truthy(F.col("corrected_label"))
    preference = (kind == "preference") & _truthy(F.col("chosen_trajectory_id"))
    failure = (kind == "trajectory_failure") & (F.coalesce(F.size("corrected_steps"), F.lit(0)) > 0)

    def payload(**fields: Column) -> Column:
        return F.to_variant_object(F.struct(*[c.alias(n) for n, c in fields.items()]))

    routed = (s.withColumn("data_type", F.when(sft, "sft").when(preference, "preference").when(failure, "failure"))
               .filter(F.col("data_type").isNotNull()))
    by_type = F.col("data_type")
    records = routed.select(
        content_key("annotation_task_id", "annotator_id", "submitted_at", "data_type").alias("id"),
        F.when(by_type == "preference", F.col("chosen_trajectory_id")).otherwise(F.col("_trajectory"))
         .alias("trajectory_id"),
        "data_type",
        F.when(by_type == "sft", payload(page_id=F.col("page_id"), annotation_type=kind))
         .when(by_type == "preference", payload(annotation_task_id=F.col("annotation_task_id")))
         .otherwise(payload(trajectory_id=F.col("_trajectory"))).alias("input_payload"),
        F.when(by_type == "sft", payload(corrected_label=F.col("corrected_label")))
         .when(by_type == "preference", payload(chosen=F.col("chosen_trajectory_id"),
                                                rejected=F.col("rejected_trajectory_id")))
         .otherwise(payload(corrected_steps=F.col("corrected_steps"))).alias("output_payload"),
        F.col("submitted_at").alias("created_at"))
    return conform(records, "training_records")


def submission_audit(tasks: DataFrame, submissions: DataFrame, actor: str = "annotator") -> DataFrame:
    """One audit row per accepted submission."""
    known = submissions.join(tasks.select(F.col("id").alias("annotation_task_id")), "annotation_task_id", "left_semi")
    return audit_events(known, actor=F.lit(actor), action=F.lit("annotation.submit"), outcome=F.lit("success"),
                        resource_type=F.lit("annotation_task"), resource_id=F.col("annotation_task_id"),
                        ts=F.col("submitted_at"))
