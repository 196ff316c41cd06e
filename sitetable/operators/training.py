"""Training records: create, export once, load back, split."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitetable.functions.text import content_key, in_share
from sitetable.operators.chunks import in_slices
from sitetable.operators.steps import success_rates
from sitetable.schemas import conform
from sitetable.session import read_or_none

LINE = "id string, type string, split string, input variant, output variant, reward double"


def create_records(rows: DataFrame) -> DataFrame:
    """Rows with data_type and payloads as ``training_records``, defaults and ids filled in."""
    records = conform(rows, "training_records")
    made = content_key("data_type", "trajectory_id", F.to_json("input_payload"), F.to_json("output_payload"),
                       "created_at")
    return records.withColumn("id", F.coalesce(F.col("id"), made))


def unexported(records: DataFrame, data_type: str | None = None, limit: int | None = None,
               ledger: DataFrame | None = None) -> DataFrame:
    """Records not exported yet, by their flag and by the ledger of exported ids; oldest first under a limit."""
    out = records.filter(~F.coalesce(F.col("exported"), F.lit(False)))
    if data_type is not None:
        out = out.filter(F.col("data_type") == data_type)
    if ledger is not None:
        if "p_range" in ledger.columns:  # at most LEDGER_RANGES numbers
            hit = [r[0] for r in out.select(ledger_range(F.col("id")).alias("r")).distinct().collect()]
            ledger = ledger.filter(F.col("p_range").isin(*hit)) if hit else ledger.limit(0)
        out = out.join(ledger.select("id"), "id", "left_anti").select(*records.columns)
    return out if limit is None else out.orderBy("created_at", "id").limit(limit)


def record_lines(records: DataFrame) -> DataFrame:
    """The exported form of a record."""
    return records.select("id", F.col("data_type").alias("type"), "split", F.col("input_payload").alias("input"),
                          F.col("output_payload").alias("output"), "reward")


def record_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("data_type", "split").agg(F.count("*").alias("n_records"))


LEDGER_RANGES = 64


def ledger_range(record_id: Column) -> Column:
    """The part of every export's ledger that an id is in; a null id is in the last."""
    return F.coalesce(F.pmod(F.xxhash64(record_id), F.lit(LEDGER_RANGES - 1)).cast("int"), F.lit(LEDGER_RANGES - 1))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """Exported ids by export and range of their hash: a look-up reads the ranges it asks for."""
    return read_or_none(lambda: spark.read.schema("id string, p_export string, p_range int").parquet(path))


def export_records(records: DataFrame, out_dir: str, ledger_path: str, data_type: str | None = None,
                   mark: bool = True, limit: int | None = None, export_id: str | None = None) -> DataFrame:
    """Write pending records as JSON lines per (type, split); returns the counts, empty if none were pending.

    Records go to ``p_export=<id>/p_type=…/p_split=…`` without a shuffle. Of the ledger only the hash ranges of the
    pending ids are read, so a small export does not read the ids of all time. Counts and the ledger entry are read from the written files, and both steps
    overwrite their own export id only. The ledger's entries of the same id do not
    count as exported, so an export can be repeated under its id, after a failure
    or a success, and writes the same lines again.
    """
    spark = records.sparkSession
    export_id = export_id or uuid.uuid4().hex
    ledger = read_ledger(spark, ledger_path)
    if ledger is not None:
        ledger = ledger.filter(F.col("p_export") != export_id)
    pending = unexported(records, data_type, limit, ledger)
    lines = record_lines(pending).withColumn("p_type", F.col("type")).withColumn("p_split", F.col("split"))
    target = f"{out_dir}/p_export={export_id}"
    (lines.write.mode("overwrite").option("ignoreNullFields", "false")
          .partitionBy("p_type", "p_split").json(target))
    written = spark.read.schema("id string, p_type string, p_split string").json(target)
    if mark:
        ids = written.select("id", ledger_range(F.col("id")).alias("p_range"))
        ids.repartition("p_range").write.mode("overwrite").partitionBy("p_range").parquet(f"{ledger_path}/p_export={export_id}")
    return written.groupBy(F.col("p_type").alias("data_type"), F.col("p_split").alias("split")) \
                  .agg(F.count("*").alias("n_records"))


def read_jsonl(spark: SparkSession, path: str, schema: str = LINE) -> DataFrame:
    """JSON-lines files; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def load_exported(spark: SparkSession, out_dir: str, data_type: str | None = None,
                  split: str | None = None) -> DataFrame:
    """Exported lines, by type and split folder (pruned), train and val together by default."""
    rows = read_jsonl(spark, out_dir, LINE + ", p_export string, p_type string, p_split string")
    if data_type is not None:
        rows = rows.filter(F.col("p_type") == data_type)
    rows = rows.filter(F.col("p_split").isin("train", "val") if split is None else F.col("p_split") == split)
    return rows.drop("p_export", "p_type", "p_split")


def split_train_val(rows: DataFrame, val_fraction: float = 0.1, method: str = "ordinal",
                    key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(train, val) by position: recorded train rows first, then by key, cut at max(1, n * (1 - f)).

    Only (recorded split, key) is ordered, in range slices; the cut is found as
    one key value, and the full rows are then merely filtered by it. Copies of a
    key stay on one side. ``method='hash'`` cuts by a hash of the key instead,
    which does not move rows when others are added.
    """
    if method == "hash":
        return rows.filter(~in_share(key, val_fraction)), rows.filter(in_share(key, val_fraction))
    if method != "ordinal":
        raise ValueError(f"unknown method: {method!r}")
    rank = F.when(F.col("split") == "train", 0).otherwise(1)
    sliced = in_slices(rows.select(rank.alias("_rank"), F.col(key).alias("_key")), ["_rank", "_key"])
    counts = sorted(sliced.groupBy("_slice").count().collect())  # one row per slice
    total = sum(n for _, n in counts)
    left = max(1, int(total * (1 - val_fraction)))
    for number, n in counts:
        if left <= n:
            along = W.Window.partitionBy("_slice").orderBy("_rank", "_key")
            cut = (sliced.filter(F.col("_slice") == number).withColumn("_n", F.row_number().over(along))
                         .filter(F.col("_n") == left).first())
            # structs compare null keys too (first), so every row is on one side
            last = F.struct(F.lit(cut["_rank"]), F.lit(cut["_key"]).cast(rows.schema[key].dataType))
            before = F.struct(rank, F.col(key)) <= last
            return rows.filter(before), rows.filter(~before)
        left -= n
    return rows, rows.limit(0)


def _payload(*columns: str | Column) -> Column:
    return F.to_variant_object(F.struct(*columns))


def step_examples(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """``sft`` records: one per step of a successful trajectory, the situation in, the action out."""
    good = trajectories.filter(F.col("status") == "success").select(
        F.col("id").alias("trajectory_id"), "page_id", "goal")
    rows = steps.join(good, "trajectory_id")
    return create_records(rows.select(
        content_key(F.lit("sft"), "trajectory_id", "step_index", "executed_at").alias("id"),
        "trajectory_id", F.lit("sft").alias("data_type"),
        _payload("page_id", "goal", "step_index").alias("input_payload"),
        _payload("action_type", "selector", "value").alias("output_payload"), F.col("executed_at").alias("created_at")))


def reward_examples(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """``reward`` records: one per trajectory, rewarded with its share of successful steps."""
    rates = success_rates(steps, trajectories).select(F.col("trajectory_id").alias("id"), "success_rate")
    rows = trajectories.join(rates, "id")
    return create_records(rows.select(
        content_key(F.lit("reward"), "id", "finished_at").alias("id"),
        F.col("id").alias("trajectory_id"), F.lit("reward").alias("data_type"),
        _payload("page_id", "goal").alias("input_payload"), _payload("status").alias("output_payload"),
        F.col("success_rate").alias("reward"), F.col("finished_at").alias("created_at")))


def failure_examples(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """``failure`` records: a failed trajectory with its first failed step."""
    first = (steps.filter(F.col("status") == "failed").groupBy("trajectory_id")
             .agg(F.min_by(F.struct("step_index", "action_type", "selector", "error_message"), "step_index")
                  .alias("failed_step")))
    rows = trajectories.filter(F.col("status") == "failed").withColumnRenamed("id", "trajectory_id") \
                       .join(first, "trajectory_id", "left")
    return create_records(rows.select(
        content_key(F.lit("failure"), "trajectory_id", "finished_at").alias("id"),
        "trajectory_id", F.lit("failure").alias("data_type"),
        _payload("trajectory_id", "page_id", "goal").alias("input_payload"),
        _payload("failed_step").alias("output_payload"), F.col("finished_at").alias("created_at")))
