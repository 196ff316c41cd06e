"""Audit trail: event rows, an append-only JSON-lines log and the audit table."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetable.functions.text import content_key, iso_utc
from sitetable.schemas import conform

_log = logging.getLogger(__name__)

EVENT_FIELDS = ("ts", "actor", "action", "outcome", "resource_type", "resource_id", "ip_address", "detail")
LOG_LINE = ("ts string, actor string, action string, outcome string, resource_type string, resource_id string, "
            "ip_address string, detail variant")


def audit_events(df: DataFrame, actor: Column, action: Column, outcome: Column, resource_type: Column | None = None,
                 resource_id: Column | None = None, detail: Column | None = None, ip_address: Column | None = None,
                 ts: Column | None = None) -> DataFrame:
    """One event per row of ``df``; ``detail`` is a variant, an empty object where absent."""
    def text(value: Column | None) -> Column:
        return (F.lit(None) if value is None else value).cast("string")
    empty = F.parse_json(F.lit("{}"))
    values = {
        "ts": ts if ts is not None else F.current_timestamp(), "actor": text(actor), "action": text(action),
        "outcome": text(outcome), "resource_type": text(resource_type), "resource_id": text(resource_id),
        "ip_address": text(ip_address), "detail": empty if detail is None else F.coalesce(detail, empty)}
    return df.select(*[values[name].alias(name) for name in EVENT_FIELDS])


def log_lines(events: DataFrame) -> DataFrame:
    """Events as they are written: the timestamp as ISO text with a Z."""
    return events.select(iso_utc(F.col("ts").cast("timestamp")).alias("ts"), *EVENT_FIELDS[1:])


def append_log(events: DataFrame, path: str) -> None:
    """Append to the JSON-lines log, nulls written out; the folder is created if missing."""
    log_lines(events).write.mode("append").option("ignoreNullFields", "false").json(path)


def audit_rows(events: DataFrame) -> DataFrame:
    """Events as rows of the ``audit_logs`` table."""
    return conform(events.withColumn("created_at", F.col("ts")).withColumn("id", content_key(
        "ts", "actor", "action", "outcome", "resource_type", "resource_id", F.to_json("detail"))), "audit_logs")


def write_audit(events: DataFrame, log_path: str, table_path: str | None = None) -> None:
    """Write the log and, if asked, the table; a failing table never fails the caller."""
    append_log(events, log_path)
    if table_path is not None:
        try:
            audit_rows(events).write.mode("append").parquet(table_path)
        except Exception as error:  # the log above is the record of truth
            _log.warning("audit table not written: %s", error)
