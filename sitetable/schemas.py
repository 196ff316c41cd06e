"""Declared tables: types, defaults, domains, required columns, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The value domains.
PAGE_TYPES = ("login", "list", "detail", "form", "dashboard", "search", "download", "unknown")
ELEMENT_ROLES = ("field", "action", "navigation", "status", "data", "pagination", "unknown")
ACTION_TYPES = ("click", "fill", "select", "submit", "download", "wait", "navigate", "scroll", "hover",
                "extract", "sync")
ACTION_STATUSES = ("pending", "running", "success", "failed", "retrying", "skipped")
ANNOTATION_STATUSES = ("pending", "in_progress", "completed", "rejected")
SYNC_STATUSES = ("pending", "running", "success", "failed", "partial")
TRAINING_TYPES = ("sft", "preference", "reward", "failure")

CASCADE, SET_NULL = "cascade", "set null"

_REQUESTS = "array<struct<url:string,method:string,resource_type:string,status:int>>"
_BOXES = ("array<struct<tag:string,id:string,name:string,text:string,role:string,aria_label:string,"
          "x:double,y:double,width:double,height:double>>")


@dataclass(frozen=True)
class Table:
    ddl: str
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = (("id",),)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (parent table, on delete)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


TABLES: dict[str, Table] = {
    "sites": Table(
        "id string, origin string, name string, description string, login_url string, meta variant, "
        "created_at timestamp, updated_at timestamp",
        required=("id", "origin"), unique=(("id",), ("origin",))),
    "pages": Table(
        "id string, site_id string, url string, title string, page_type string, html string, rendered_dom string, "
        f"screenshot_path string, accessibility_tree variant, har struct<requests:{_REQUESTS}>, "
        f"bounding_boxes {_BOXES}, meta variant, content_hash string, version int, collected_at timestamp, "
        "created_at timestamp, updated_at timestamp",
        required=("id", "site_id", "url"), references={"site_id": ("sites", CASCADE)},
        domains={"page_type": PAGE_TYPES}, defaults={"page_type": "unknown", "version": 1}),
    "elements": Table(
        "id string, page_id string, role string, tag string, label string, selector string, xpath string, "
        "aria_label string, bounding_box struct<x:double,y:double,width:double,height:double>, "
        "attributes map<string,string>, confidence double, is_interactive boolean, doc_pos int, created_at timestamp",
        required=("id", "page_id"), references={"page_id": ("pages", CASCADE)},
        domains={"role": ELEMENT_ROLES}, defaults={"role": "unknown", "confidence": 0.0, "is_interactive": False}),
    "trajectories": Table(
        "id string, page_id string, goal string, status string, total_steps int, successful_steps int, meta variant, "
        "started_at timestamp, finished_at timestamp, created_at timestamp",
        required=("id", "page_id"), references={"page_id": ("pages", CASCADE)},
        domains={"status": ACTION_STATUSES}, defaults={"status": "pending", "total_steps": 0, "successful_steps": 0}),
    "action_steps": Table(
        "id string, trajectory_id string, step_index int, action_type string, selector string, value string, "
        "description string, status string, retry_count int, error_message string, before_screenshot_path string, "
        "after_screenshot_path string, before_dom_hash string, after_dom_hash string, duration_ms int, meta variant, "
        "executed_at timestamp, created_at timestamp",
        required=("id", "trajectory_id", "step_index", "action_type"),
        references={"trajectory_id": ("trajectories", CASCADE)},
        domains={"action_type": ACTION_TYPES, "status": ACTION_STATUSES},
        defaults={"status": "pending", "retry_count": 0}),
    "sync_tasks": Table(
        "id string, site_id string, source_url string, target_type string, target_path string, "
        "field_mapping map<string,string>, status string, last_synced_at timestamp, last_cursor string, "
        "rows_synced long, error_message string, created_at timestamp, updated_at timestamp",
        required=("id", "site_id", "source_url", "target_type", "target_path"),
        references={"site_id": ("sites", CASCADE)}, domains={"status": SYNC_STATUSES},
        defaults={"status": "pending", "rows_synced": 0}),
    "annotation_tasks": Table(
        "id string, page_id string, trajectory_id string, trajectory_b_id string, annotation_type string, "
        "priority int, status string, prompt string, result struct<corrected_label:string,"
        "chosen_trajectory_id:string,rejected_trajectory_id:string,corrected_steps:array<variant>,notes:string>, "
        "annotator_id string, created_at timestamp, updated_at timestamp",
        required=("id", "annotation_type"),
        references={"page_id": ("pages", SET_NULL), "trajectory_id": ("trajectories", SET_NULL)},
        domains={"status": ANNOTATION_STATUSES}, defaults={"priority": 5, "status": "pending"}),
    "training_records": Table(
        "id string, trajectory_id string, data_type string, input_payload variant, output_payload variant, "
        "reward double, split string, exported boolean, created_at timestamp",
        required=("id", "data_type", "input_payload", "output_payload"),
        references={"trajectory_id": ("trajectories", SET_NULL)},
        domains={"data_type": TRAINING_TYPES}, defaults={"split": "train", "exported": False}),
    "audit_logs": Table(
        "id string, actor string, action string, resource_type string, resource_id string, outcome string, "
        "detail variant, ip_address string, created_at timestamp",
        required=("id", "actor", "action", "outcome")),
    "credentials": Table(
        "id string, site_id string, username string, encrypted_secret binary, credential_type string, "
        "created_at timestamp, updated_at timestamp",
        required=("id", "site_id", "username", "encrypted_secret"), unique=(("id",), ("site_id", "username")),
        references={"site_id": ("sites", CASCADE)}, defaults={"credential_type": "password"}),
}


# The longest text, in characters, that a column is declared for (ids are content keys, of any length).
LENGTHS: dict[str, dict[str, int]] = {
    "sites": {"origin": 2048, "name": 255, "login_url": 2048},
    "pages": {"url": 2048, "title": 512, "screenshot_path": 1024, "content_hash": 64},
    "elements": {"tag": 64, "label": 512, "aria_label": 512},
    "action_steps": {"before_screenshot_path": 1024, "after_screenshot_path": 1024, "before_dom_hash": 64, "after_dom_hash": 64},
    "sync_tasks": {"source_url": 2048, "target_type": 32, "target_path": 1024},
    "annotation_tasks": {"annotation_type": 32, "annotator_id": 256},
    "training_records": {"split": 16},
    "audit_logs": {"actor": 256, "action": 128, "resource_type": 64, "outcome": 16, "ip_address": 45},
    "credentials": {"username": 512, "credential_type": 32},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the table's columns and types: defaults fill gaps, other columns are dropped."""
    spec = TABLES[table]
    out = []
    for f in spec.schema.fields:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in spec.defaults:
            value = F.coalesce(value, F.lit(spec.defaults[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out)
