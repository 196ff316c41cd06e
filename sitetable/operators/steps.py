"""Executed steps and trajectories: ingest of run logs, truncation, rates, replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetable.functions.text import content_key
from sitetable.operators.chunks import changes, medians
from sitetable.schemas import conform

STEP_LOG = ("array<struct<step_index:int,action_type:string,status:string,duration_ms:int,retry_count:int,"
            "error_message:string,before_dom_hash:string,after_dom_hash:string,selector:string,value:string,"
            "description:string>>")
RUN_LOG = f"page_id string, goal string, started_at double, finished_at double, steps {STEP_LOG}"


def _ok() -> Column:
    return F.coalesce(F.col("status") == "success", F.lit(False))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs as JSON lines, one run with its steps per line."""
    return spark.read.schema(RUN_LOG).json(path)


def run_id() -> Column:
    return content_key("page_id", "goal", "started_at")


def trajectories_from_logs(runs: DataFrame) -> DataFrame:
    """One trajectory per run log: success only if every step succeeded, also with no steps at all."""
    steps = F.coalesce(F.col("steps"), F.array().cast(STEP_LOG))
    succeeded = F.size(F.filter(steps, lambda s: F.coalesce(s.status == "success", F.lit(False))))
    return conform(runs.select(
        run_id().alias("id"), "page_id", "goal",
        F.when(succeeded == F.size(steps), "success").otherwise("failed").alias("status"),
        F.size(steps).alias("total_steps"), succeeded.alias("successful_steps"),
        F.timestamp_micros((F.col("started_at") * 1000000).cast("long")).alias("started_at"),
        F.timestamp_micros((F.col("finished_at") * 1000000).cast("long")).alias("finished_at"),
        F.timestamp_micros((F.col("finished_at") * 1000000).cast("long")).alias("created_at")), "trajectories")


def steps_from_logs(runs: DataFrame) -> DataFrame:
    """One action step per logged step, with the table's defaults."""
    rows = runs.select(run_id().alias("trajectory_id"), F.col("started_at").alias("_started"),
                       F.posexplode("steps").alias("_pos", "s"))
    started = F.timestamp_micros((F.col("_started") * 1000000).cast("long"))
    return conform(rows.select("trajectory_id", "_pos", started.alias("created_at"), "s.*")
                       .withColumn("step_index", F.coalesce("step_index", "_pos"))
                       .withColumn("id", content_key("trajectory_id", "step_index")), "action_steps")


def runs_with_status(trajectories: DataFrame, status: str, page_id: str | None = None) -> DataFrame:
    """Trajectories with a status (``success``, ``failed`` ...), of one page or of all."""
    found = trajectories.filter(F.col("status") == status)
    return found if page_id is None else found.filter(F.col("page_id") == page_id)


def in_order(steps: DataFrame) -> DataFrame:
    return steps.orderBy("trajectory_id", "step_index")


def until_first_failure(steps: DataFrame) -> DataFrame:
    """Steps up to and including the first failed one of their trajectory.

    The first failure is a partially aggregated minimum joined back, not a window:
    one very long trajectory is then split like any skewed join side.
    """
    first = (steps.filter(F.col("status") == "failed")
                  .groupBy("trajectory_id").agg(F.min("step_index").alias("_first_failed")))
    return (steps.join(first, "trajectory_id", "left")
                 .filter(F.col("_first_failed").isNull() | (F.col("step_index") <= F.col("_first_failed")))
                 .drop("_first_failed"))


def dom_changes(steps: DataFrame, chunk: int = 1000) -> DataFrame:
    """Did a step change the DOM, and did the DOM change since the step before? Null where a hash is missing."""
    slim = steps.select("trajectory_id", "step_index", "after_dom_hash",
                        (F.col("before_dom_hash") != F.col("after_dom_hash")).alias("changed_by_step"))
    # ordering by the flag too changes nothing, but lets both uses of the shuffled rows share it
    seen = changes(slim, ["trajectory_id"], ["step_index", "changed_by_step"], "after_dom_hash",
                   F.floor(F.col("step_index") / F.lit(chunk)))
    return seen.select("trajectory_id", "step_index", "changed_by_step",
                       (F.col("previous") != F.col("after_dom_hash")).alias("changed_since_previous"))


def success_rates(steps: DataFrame, trajectories: DataFrame | None = None) -> DataFrame:
    """Share of successful steps per trajectory; 0.0 for a trajectory without steps."""
    rates = steps.groupBy("trajectory_id").agg(F.avg(_ok().cast("double")).alias("success_rate"))
    return _for_all(rates, trajectories, {"success_rate": F.lit(0.0)})


def overall_status(steps: DataFrame, trajectories: DataFrame | None = None) -> DataFrame:
    """``success`` if and only if all steps succeeded, so also for a trajectory without steps."""
    status = steps.groupBy("trajectory_id").agg(
        F.when(F.bool_and(_ok()), "success").otherwise("failed").alias("overall_status"))
    return _for_all(status, trajectories, {"overall_status": F.lit("success")})


def step_totals(steps: DataFrame, trajectories: DataFrame | None = None) -> DataFrame:
    """total_steps, successful_steps, started_at and finished_at per trajectory."""
    totals = steps.groupBy("trajectory_id").agg(
        F.count("*").alias("total_steps"), F.count_if(_ok()).alias("successful_steps"),
        F.min("executed_at").alias("started_at"), F.max("executed_at").alias("finished_at"))
    return _for_all(totals, trajectories, {"total_steps": F.lit(0), "successful_steps": F.lit(0)})


def _for_all(per_trajectory: DataFrame, trajectories: DataFrame | None, empty: dict[str, Column]) -> DataFrame:
    if trajectories is None:
        return per_trajectory
    out = trajectories.select(F.col("id").alias("trajectory_id")).join(per_trajectory, "trajectory_id", "left")
    for name, value in empty.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


def effort_by_action(steps: DataFrame) -> DataFrame:
    """Retries and durations by action type; the median is the exact lower one."""
    totals = steps.groupBy("action_type").agg(
        F.count("*").alias("n_steps"), F.avg("retry_count").alias("avg_retries"),
        F.max("retry_count").alias("max_retries"), F.avg("duration_ms").alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"))
    middle = medians(steps, "action_type", "duration_ms").withColumnRenamed("median", "median_duration_ms")
    # null-safe: an unnamed action type is a group too
    return totals.join(middle.withColumnRenamed("action_type", "_type"), F.col("action_type").eqNullSafe(F.col("_type")), "left") \
                 .drop("_type")


def page_runs(pages: DataFrame, trajectories: DataFrame, steps: DataFrame,
              page_cols: Sequence[str] = ("url",)) -> DataFrame:
    """Page -> trajectory -> step, one row per step; sort with ``in_order`` where the order is shown."""
    return (steps.join(trajectories.select(F.col("id").alias("trajectory_id"), "page_id", "goal"), "trajectory_id")
                 .join(pages.select(F.col("id").alias("page_id"), *page_cols), "page_id"))


def replay(steps: DataFrame, elements: DataFrame) -> DataFrame:
    """Offline check: which selector of a step still exists in the saved page?

    ``steps`` has page_id, id, selector and optionally fallback_selectors. All
    selectors are tried in order; ``selector_rank`` is 0 for the step's own one.
    Steps without any selector are kept, with ``resolved`` null.
    """
    own = F.array(F.col("selector"))
    if "fallback_selectors" in steps.columns:
        own = F.concat(own, F.coalesce(F.col("fallback_selectors"), F.array().cast("array<string>")))
    tried = steps.select("id", "page_id", F.posexplode_outer(own).alias("_rank", "_selector"))
    saved = elements.select(F.col("page_id"), F.col("selector").alias("_selector")).distinct() \
                    .withColumn("_hit", F.lit(True))
    # merged: from the size of the scan Spark cannot tell how many elements its pages hold, and would broadcast them
    found = (tried.join(saved.hint("merge"), ["page_id", "_selector"], "left")
                  .groupBy("id", "page_id")
                  .agg(F.min(F.when(F.col("_hit"), F.struct("_rank", "_selector"))).alias("_best"),
                       F.max(F.col("_selector").isNotNull()).alias("_any")))
    return found.select("id", "page_id",
                        F.when(F.col("_any"), F.col("_best").isNotNull()).alias("resolved"),
                        F.col("_best._rank").alias("selector_rank"),
                        F.col("_best._selector").alias("resolved_selector"))
