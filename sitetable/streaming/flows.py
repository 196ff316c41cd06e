"""Streams: audit counts, page ingest and incremental sync, each with its batch operators inside."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitetable.functions.pii import redact_record
from sitetable.functions.text import content_hash, content_key
from sitetable.operators.pages import classify_parsed, elements_table, parse_pages
from sitetable.operators.sync import map_fields
from sitetable.schemas import conform
from sitetable.session import checkpointed, read_or_none, remove
from sitetable.sources.audit import LOG_LINE
from sitetable.sources.snapshots import PAGE_TEXTS
from sitetable.sources.targets import open_target


def read_audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """The audit log as a stream; ``ts`` becomes a timestamp."""
    return spark.readStream.schema(LOG_LINE).json(path).withColumn("ts", F.to_timestamp("ts"))


def audit_counts(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events by tumbling window, action and outcome; works on a stream and on a table alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    return (events.groupBy(F.window("ts", width).alias("w"), "action", "outcome")
                  .agg(F.count("*").alias("n_events"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "action", "outcome", "n_events"))


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep changing counts as one folder per micro-batch, each written whole; read them with ``read_counts``."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).foreachBatch(save).start())


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The latest count per window, action and outcome."""
    rows = spark.read.parquet(path)
    keys = ["window_start", "window_end", "action", "outcome"]
    return rows.groupBy(*keys).agg(F.max_by("n_events", "batch").alias("n_events"))


ASIDE_IDS = 1_000_000  # ids of 64 characters: about 100 MB in a broadcast


def fresh_snapshots(pages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Snapshots with content hash, id and day; those sent again, here or in ``stored`` (id, day), are dropped.

    The id covers url, content and time of collection, so a page that changes and changes back is a new snapshot
    each time, and however late a snapshot comes it is kept. Of ``stored`` only the days at hand are read.
    Ids are compared on their own. Only those that were sent before, or twice here, meet the pages: by broadcast up
    to ``ASIDE_IDS`` of them, by shuffle beyond; the html of pages sent once does not move before that.
    """
    keyed = pages.withColumn("content_hash", content_hash("html"))
    keyed = keyed.withColumn("id", content_key("url", "content_hash", "collected_at")) \
                 .withColumn("day", F.coalesce(F.date_format("collected_at", "yyyy-MM-dd"), F.lit("none")))
    ids = checkpointed(keyed.groupBy("id", "day").agg(F.count("*").alias("n")))
    if stored is None:
        aside = ids.select("id", F.lit(False).alias("known"), "n")
    else:
        days = [r[0] for r in ids.select("day").distinct().collect()]  # one row per day of collection
        before = stored.filter(F.col("day").isin(*days)).select("id").distinct() if days else stored.select("id").limit(0)
        aside = ids.join(before.withColumn("_known", F.lit(True)), "id", "left").select(
            "id", F.col("_known").isNotNull().alias("known"), "n")
    aside = checkpointed(aside.filter(F.col("known") | (F.col("n") > 1)))
    n_aside, n_twice = aside.agg(F.count("*"), F.count_if(~F.col("known"))).first()
    if not n_aside:
        return keyed
    near = F.broadcast if n_aside <= ASIDE_IDS else (lambda df: df)
    once = keyed.join(near(aside.select("id")), "id", "left_anti")
    if not n_twice:
        return once
    twice = keyed.join(near(aside.filter(~F.col("known")).select("id")), "id", "left_semi").dropDuplicates(["id"])
    return once.unionByName(twice)


def understand(snapshots: DataFrame, redacted: bool = True) -> DataFrame:
    """Redact, parse and classify: stateless, one parse per page. Keeps ``parsed`` for the elements."""
    columns = [c for c in PAGE_TEXTS if c in snapshots.columns]
    rows = redact_record(snapshots, columns) if redacted else snapshots
    return classify_parsed(parse_pages(rows, ("title", "elements", "signals")))


def write_pages(snapshots: DataFrame, pages_path: str, elements_path: str, checkpoint: str,
                redacted: bool = True) -> StreamingQuery:
    """Stream of snapshots -> ``pages`` (batch=…/day=…) and ``elements`` (batch=…) folders.

    Snapshots that other batches have stored are left out by their id, in the sink: there is no state that grows and
    no lateness after which a snapshot is lost. A batch that runs again replaces its own folders.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = read_or_none(lambda: spark.read.schema("id string, batch long, day string").parquet(pages_path))
        known = None if known is None else known.filter(F.col("batch") != batch_id)
        staged = f"{pages_path}-parsed/batch={batch_id}"
        understand(fresh_snapshots(batch, known), redacted).write.mode("overwrite").parquet(staged)
        parsed = spark.read.parquet(staged)
        conform(parsed, "pages").withColumn("day", F.coalesce(F.date_format("collected_at", "yyyy-MM-dd"), F.lit("none"))) \
            .write.mode("overwrite").partitionBy("day").parquet(f"{pages_path}/batch={batch_id}")
        elements_table(parsed, parsed=F.col("parsed")) \
            .write.mode("overwrite").parquet(f"{elements_path}/batch={batch_id}")
        remove(spark, staged)
    return (snapshots.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(save).start())


def stream_sync(rows: DataFrame, kind: str, path: str, table: str, checkpoint: str,
                mapping: dict[str, str] | None = None, keys: Sequence[str] | None = None,
                order: Sequence[str] = ()) -> StreamingQuery:
    """Incremental sync: new source files are mapped and appended, or upserted by key; the checkpoint is the cursor.

    A batch that is run again replaces its own part of the table, or upserts the same rows.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def save(batch: DataFrame, batch_id: int) -> None:
        target = open_target(batch.sparkSession, kind, path)
        mapped = map_fields(batch, mapping)
        if keys:
            target.upsert(mapped, table, keys, order)
        else:
            target.append(mapped, table, part=f"{stream}-{batch_id}")
    return (rows.writeStream.option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).foreachBatch(save).start())
