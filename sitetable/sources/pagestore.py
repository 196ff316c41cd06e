"""Pages in two parts: slim rows, and each distinct html once, in buckets by its content hash.

The slim rows (everything but the html) are a logged table (``targets``). The html table is an external
Parquet table clustered by content hash, so that a join by hash reads it where it lies: only slim rows are shuffled to
find the latest pages, whatever their html weighs. Its bucket layout is kept in a small file beside it, and the
session's catalog learns of it when the store is opened.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetable.functions.text import content_hash
from sitetable.operators.pages import latest_pages
from sitetable.session import create_if_absent, read_text
from sitetable.sources.targets import ParquetTarget

N_BUCKETS = 64


class PageStore:
    def __init__(self, spark: SparkSession, path: str, n_buckets: int = N_BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.slim = ParquetTarget(spark, self.path)
        layout = f"{self.path}/layout.json"
        create_if_absent(spark, layout, json.dumps({"n_buckets": n_buckets}))  # the first to open it decides
        self.n_buckets = json.loads(read_text(spark, layout))["n_buckets"]
        self.table = "pagestore_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        place = f"{self.path}/html".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (content_hash STRING, html STRING) USING parquet "
                  f"CLUSTERED BY (content_hash) SORTED BY (content_hash) INTO {self.n_buckets} BUCKETS LOCATION '{place}'")

    def html(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def add(self, pages: DataFrame, part: str | None = None) -> int:
        """Add pages; returns how many. Html that is stored already is not written again.

        New html goes to its buckets (the one time it moves) before the slim rows are committed, so a page never lacks
        its html. A run that is repeated, or two at once, may write an html twice: reads take it once.
        """
        if "content_hash" not in pages.columns:
            pages = pages.withColumn("content_hash", content_hash("html"))
        known = self.html().select("content_hash")
        new = (pages.filter(F.col("html").isNotNull()).select("content_hash", "html")
               .join(known, "content_hash", "left_anti").dropDuplicates(["content_hash"]))
        (new.repartition(self.n_buckets, "content_hash").sortWithinPartitions("content_hash").write.mode("append")
            .format("parquet").bucketBy(self.n_buckets, "content_hash").sortBy("content_hash").saveAsTable(self.table))
        return self.slim.append(pages.drop("html"), "pages", part)

    def with_html(self, slim: DataFrame) -> DataFrame:
        """Slim rows with their html, which is read bucket by bucket; null where the page had none."""
        once = self.html().groupBy("content_hash").agg(F.first("html").alias("html"))  # in place: no exchange
        return slim.join(once, "content_hash", "left")

    def pages(self) -> DataFrame | None:
        return self.slim.read("pages")

    def latest(self, url: str | None = None, key: str = "id") -> DataFrame:
        """The latest version of every URL (or of one), with html."""
        return self.with_html(latest_pages(self.pages(), url, key))
