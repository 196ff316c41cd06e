"""Sync of extracted rows to targets: mapping, tasks, runs and increments."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitetable.functions.text import content_key
from sitetable.operators.tables import upsert
from sitetable.schemas import conform
from sitetable.sources.audit import audit_events, write_audit
from sitetable.sources.targets import open_target


@dataclass(frozen=True)
class SyncReport:
    task_id: str
    status: str
    rows_written: int
    duration_s: float
    error: str | None = None
    last_cursor: str | None = None


REPORT = ("seq int, task_id string, status string, rows_written long, duration_s double, error string, "
          "last_cursor string")


def map_fields(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """Rename columns: mapped ones first in mapping order, then the others.

    The last source of a shared target name wins, and an unmapped column wins
    over a mapped one of the same name.
    """
    if not mapping:
        return df
    source = {new: old for old, new in mapping.items() if old in df.columns}
    source |= {c: c for c in df.columns if c not in mapping}
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in source.items()])


def register_tasks(rows: DataFrame) -> DataFrame:
    """New sync tasks with defaults and ids; append them to ``sync_tasks``."""
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.current_timestamp())
    tasks = conform(rows, "sync_tasks")
    return tasks.withColumn("id", F.coalesce(F.col("id"), content_key(
        "site_id", "source_url", "target_type", "target_path", "created_at")))


def task_table(url: str, default: str = "site_table", limit: int = 64) -> str:
    """The ``table_name`` of one URL; a name that had to be cut ends in a hash, so that no two URLs share a table."""
    name = re.sub(r"[^a-zA-Z0-9_]+", "_", re.sub(r"https?://", "", url))
    name = re.sub(r"_+", "_", name).strip("_")
    if len(name) > limit:
        mark = hashlib.sha256(url.encode()).hexdigest()[:12]
        return f"{name[:limit - len(mark) - 1]}_{mark}"
    return name or default


def _refuse_copies(rows: DataFrame, keys: Sequence[str]) -> None:
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    if rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("rows repeat a key: say by which order the last one is found")


def run_sync(tasks: DataFrame, task_id: str, rows: DataFrame, audit_path: str | None = None,
             keys: Sequence[str] | None = None, order: Sequence[str] = (), part: str | None = None,
             cursor: str | None = None, audit_table: str | None = None) -> SyncReport:
    """Write the rows of one task to its target; errors are reported and audited, not raised.

    Rows are counted while they are written, and the greatest value of the mapped ``cursor`` column is noted for
    ``apply_reports``. With ``keys`` the target is upserted: of rows that repeat a key the last by ``order`` stays,
    and without an order such rows are an error. Otherwise rows are appended, under the name ``part`` if given, so
    that a run that is repeated replaces itself. An unknown task is an error of the caller.
    """
    spark = tasks.sparkSession
    task = tasks.filter(F.col("id") == task_id).select(
        "source_url", "target_type", "target_path", "field_mapping").first()
    if task is None:
        raise ValueError(f"sync task {task_id!r} not found")
    start = time.time()
    try:
        target = open_target(spark, task["target_type"], task["target_path"])
        mapped = map_fields(rows, task["field_mapping"])
        if keys and not order:
            _refuse_copies(mapped, keys)
        seen = None
        if cursor is not None:
            seen, value = Observation(), F.col(f"`{cursor}`").cast("string")
            mapped = mapped.observe(seen, F.max(F.when(value != "", value)).alias("last"))
        table = task_table(task["source_url"])
        written = target.upsert(mapped, table, keys, order) if keys else target.append(mapped, table, part)
        report = SyncReport(task_id, "success", written, time.time() - start, None, seen.get["last"] if seen else None)
    except Exception as error:
        report = SyncReport(task_id, "failed", 0, time.time() - start, str(error))
    if audit_path:
        ok = report.status == "success"
        detail = F.struct(F.lit(report.rows_written).alias("rows")) if ok else F.struct(
            F.lit(report.error).alias("error"))
        write_audit(audit_events(
            spark.range(1), actor=F.lit("sync_manager"), action=F.lit("sync.run"),
            outcome=F.lit("success" if ok else "failure"), resource_type=F.lit("sync_task"),
            resource_id=F.lit(task_id), detail=F.to_variant_object(detail)), audit_path, audit_table)
    return report


def run_syncs(tasks: DataFrame, rows: Mapping[str, DataFrame], at_once: int = 8, **options) -> list[SyncReport]:
    """``run_sync`` for several tasks (id -> rows) side by side; reports come in the order of ``rows``."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda item: run_sync(tasks, *item, **options), rows.items()))


def report_rows(spark, reports: Sequence[SyncReport]) -> DataFrame:
    """Reports as a table, one row per run, numbered in the given order."""
    return spark.createDataFrame([(n, *asdict(r).values()) for n, r in enumerate(reports)], REPORT)


def apply_reports(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """Tasks with their runs booked: status, error, time of the last success, cumulated row count and cursor.

    The cursor rises to the greatest value that a successful run has seen, and never falls.
    """
    runs = reports.groupBy(F.col("task_id").alias("id")).agg(
        F.sum("rows_written").alias("_rows"), F.max_by("status", "seq").alias("_status"),
        F.max_by("error", "seq").alias("_error"), F.max("last_cursor").alias("_cursor"))
    ok = F.col("_status") == "success"
    updates = tasks.join(runs, "id").select(
        "id", F.col("_status").alias("status"),
        F.when(ok, F.col("error_message")).otherwise(F.col("_error")).alias("error_message"),
        F.when(ok, F.current_timestamp()).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
        (F.coalesce(F.col("rows_synced"), F.lit(0)) + F.col("_rows")).alias("rows_synced"),
        F.greatest("last_cursor", "_cursor").alias("last_cursor"))
    return upsert(tasks, updates, ["id"], ["status", "error_message", "last_synced_at", "rows_synced", "last_cursor"])


def stored_cursor(tasks: DataFrame, task_id: str) -> str | None:
    """The cursor booked for a task, where the next increment starts."""
    row = tasks.filter(F.col("id") == task_id).select("last_cursor").first()
    return None if row is None else row[0]


def after_cursor(df: DataFrame, cursor: str | None, column: str = "updated_at") -> DataFrame:
    """Rows beyond the cursor, all rows without one; the literal is typed so that the filter is pushed down."""
    if cursor is None:
        return df
    return df.filter(F.col(column) > F.lit(cursor).cast(df.schema[column].dataType))
