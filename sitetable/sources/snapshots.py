"""Collected pages: snapshot ingest, request logs and bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetable.functions.pii import redact_record
from sitetable.functions.text import content_hash, content_key
from sitetable.schemas import conform

# what a page says; its keys, times and url are not texts of the page
PAGE_TEXTS = ("title", "html", "rendered_dom", "accessibility_tree", "har", "bounding_boxes", "meta")


def to_pages(df: DataFrame, redacted: bool = False) -> DataFrame:
    """Snapshots as rows of ``pages``; the content hash is that of the raw html, also when it is redacted.

    ``redacted`` covers every column that holds texts of the page (``PAGE_TEXTS``).
    """
    rows = df
    if "content_hash" not in rows.columns:
        rows = rows.withColumn("content_hash", content_hash("html"))
    if "id" not in rows.columns:
        when = [c for c in ("collected_at",) if c in rows.columns]
        rows = rows.withColumn("id", content_key("url", "content_hash", *when))
    if "created_at" not in rows.columns and "collected_at" in rows.columns:
        rows = rows.withColumn("created_at", F.col("collected_at")).withColumn("updated_at", F.col("collected_at"))
    pages = conform(rows, "pages")
    return redact_record(pages, PAGE_TEXTS) if redacted else pages


def read_pages(spark: SparkSession, path: str, redacted: bool = False) -> DataFrame:
    """Pages from a folder of Parquet snapshots."""
    return to_pages(spark.read.parquet(path), redacted)


IN_ROW = 500  # entries of a page's log that are paired within the row


def requests(pages: DataFrame, key: str = "id", in_row: int = IN_ROW) -> DataFrame:
    """One row per (page, requested URL): request and response entries of the log are paired.

    A page's log lies in its row, and is folded there; only logs of more than ``in_row`` entries, where looking
    up each URL would cost the square of their length, are grouped by a shuffle.
    """
    log = pages.select(F.col(key).alias("page_id"), F.col("har.requests").alias("r"))

    def paired(url: Column) -> Column:
        own = F.filter("r", lambda r: r["url"].eqNullSafe(url))
        return F.struct(
            url.alias("url"), F.array_min(F.transform(own, lambda r: r["method"])).alias("method"),
            F.array_min(F.transform(own, lambda r: r["resource_type"])).alias("resource_type"),
            F.array_max(F.transform(own, lambda r: r["status"])).alias("status"),
            F.size(F.filter(own, lambda r: r["method"].isNotNull())).cast("long").alias("n_requests"),
            F.size(F.filter(own, lambda r: r["status"].isNotNull())).cast("long").alias("n_responses"))

    urls = F.array_distinct(F.transform("r", lambda r: r["url"]))
    short = log.filter(F.size("r") <= in_row).select("page_id", F.inline(F.transform(urls, paired)))
    long = log.filter(F.size("r") > in_row).select("page_id", F.explode("r").alias("r"))
    return short.unionByName(long.groupBy("page_id", F.col("r.url").alias("url")).agg(
        F.min("r.method").alias("method"), F.min("r.resource_type").alias("resource_type"),
        F.max("r.status").alias("status"),
        F.count_if(F.col("r.method").isNotNull()).alias("n_requests"),
        F.count_if(F.col("r.status").isNotNull()).alias("n_responses")))


def boxes(pages: DataFrame, key: str = "id") -> DataFrame:
    """One row per recorded bounding box, in recorded order."""
    return (pages.select(F.col(key).alias("page_id"), F.posexplode("bounding_boxes").alias("box_pos", "b"))
                 .select("page_id", "box_pos", "b.*"))


def boxed_elements(elements: DataFrame, page_boxes: DataFrame) -> DataFrame:
    """Elements with their bounding box, matched within the page by tag and id, or by tag and name without an id.

    Of several boxes under one name the first applies, as in a document lookup.
    """
    def mark(tag, ident, name):
        return F.when(F.coalesce(ident, F.lit("")) != "", F.concat(tag, F.lit("#"), ident)) \
                .when(F.coalesce(name, F.lit("")) != "", F.concat(tag, F.lit("@"), name))

    box = F.struct("x", "y", "width", "height")
    first = (page_boxes.withColumn("_mark", mark(F.col("tag"), F.col("id"), F.col("name")))
             .filter(F.col("_mark").isNotNull())
             .groupBy("page_id", "_mark").agg(F.min_by(box, "box_pos").alias("bounding_box")))
    marked = elements.withColumn("_mark", mark(F.col("tag"), F.col("attributes").getItem("id"),
                                               F.col("attributes").getItem("name")))
    if "bounding_box" in marked.columns:
        marked = marked.drop("bounding_box")
    return marked.join(first, ["page_id", "_mark"], "left").drop("_mark")


def boxed_in_row(pages: DataFrame, elements: Column, key: str = "id") -> DataFrame:
    """``boxed_elements`` for pages that carry their element array: elements and boxes meet in the row, without a shuffle.

    The first box of a name is found in a map per page, so it is linear in both.
    """
    def mark(tag: Column, ident: Column, name: Column) -> Column:
        return F.when(F.coalesce(ident, F.lit("")) != "", F.concat(tag, F.lit("#"), ident)) \
                .when(F.coalesce(name, F.lit("")) != "", F.concat(tag, F.lit("@"), name))

    boxes_ = F.filter(F.transform(F.coalesce("bounding_boxes", F.array()), lambda b, i: F.struct(
        mark(b["tag"], b["id"], b["name"]).alias("mark"), i.alias("pos"),
        F.struct(*[b[c].alias(c) for c in ("x", "y", "width", "height")]).alias("box"))), lambda b: b["mark"].isNotNull())
    # in the order of mark and place the first of equal marks is the one that applies
    ordered = F.array_sort(boxes_)
    rows = pages.withColumn("_boxes", ordered).withColumn("_first", F.map_from_entries(F.transform(F.filter(
        F.transform("_boxes", lambda b, i: F.struct(b.alias("b"), F.get("_boxes", i - 1)["mark"].alias("before"))),
        lambda p: ~p["b"]["mark"].eqNullSafe(p["before"])), lambda p: F.struct(p["b"]["mark"].alias("k"), p["b"]["box"].alias("v")))))
    rows = rows.select(F.col(key).alias("page_id"), "_first", F.explode(elements).alias("e"))
    own = mark(F.col("e.tag"), F.try_element_at(F.col("e.attributes"), F.lit("id")), F.try_element_at(F.col("e.attributes"), F.lit("name")))
    return rows.select("page_id", "e.*", F.try_element_at("_first", F.coalesce(own, F.lit(""))).alias("bounding_box"))
