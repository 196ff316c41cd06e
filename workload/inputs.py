"""Inputs derived from the given tables, each in Spark and (``*_SQL``) as the same rows in SQL.

The given tables hold no run logs, annotation tasks, form pages and so on, so
these are made from whole tables by rule: every row of the source takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetable.schemas import conform

START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def later(seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + seconds)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# -- pages as they were collected -------------------------------------------

def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``pages`` with id, site_id (the origin) and collected_at."""
    return table(spark, sf, "pages").select(
        text("page_id").alias("id"), F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("site_id"), "url", "html",
        later(F.col("page_id")).alias("collected_at"))


SITE_PAGES_SQL = f"""site_pages AS (
  SELECT CAST(page_id AS VARCHAR) AS id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site_id, url, html,
         TIMESTAMP '{START}' + to_seconds(page_id) AS collected_at
  FROM pages)"""


def page_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Three snapshots of every page, a day apart, with a revision comment that changes or not."""
    rows = table(spark, sf, "pages").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return rows.select(
        F.concat_ws("-", "page_id", "v").alias("id"), "url", F.col("v").alias("version"),
        F.concat(F.col("html"), F.lit("<!-- "), (F.col("page_id") % F.col("v")).cast("string"), F.lit(" -->"))
         .alias("html"),
        later(F.col("page_id") + F.col("v") * 86400).alias("collected_at"))


PAGE_SNAPSHOTS_SQL = f"""page_snapshots AS (
  SELECT page_id || '-' || v AS id, url, CAST(v AS INTEGER) AS version, html || '<!-- ' || (page_id % v) || ' -->' AS html,
         TIMESTAMP '{START}' + to_seconds(page_id + v * 86400) AS collected_at
  FROM (SELECT *, unnest([1, 2, 3]) AS v FROM pages))"""


# -- one form page per customer ---------------------------------------------

def _bit(n: int) -> Column:
    return F.floor(F.col("c_custkey") / F.lit(2 ** n)) % 2 == 1


def dealt(rows: DataFrame) -> DataFrame:
    """Slim rows of a scan with fewer tasks than cores, dealt to all cores before they grow into pages."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def account_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page per customer with a form, links and a table; parts come and go with the bits of the key."""
    key = text("c_custkey")

    def opt(n: int, *parts: Column | str) -> Column:
        return F.when(_bit(n), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")

    html = [
        "<html><head><title>Account ", F.col("c_name"), "</title></head><body>",
        '<form action="/save/', key, '" method="POST"><input type="text"',
        opt(0, ' id="f', key, '"'), opt(1, ' name="user"'), opt(2, ' role="textbox"'), opt(3, ' aria-label="Holder"'),
        ">", opt(1, '<input type="password" name="pw" required>'),
        opt(2, '<input type="search" name="q" placeholder="Find">'),
        '<button type="submit">', F.when(_bit(3), "Sign in").otherwise("Go"), "</button></form>",
        opt(0, '<a class="next" href="/list?page=2">Next page</a>'), '<a href="/export.csv">Export</a>',
        "<table><tr><th>key</th><th>name</th><th>segment</th></tr><tr><td>", key, "</td><td>", F.col("c_name"),
        "</td><td>", F.col("c_mktsegment"), "</td></tr><tr><td>nation</td><td>", text("c_nationkey"),
        "</td><td></td></tr></table></body></html>"]
    return dealt(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).select(
        key.alias("id"), F.concat(F.lit("site-"), text("c_nationkey")).alias("site_id"),
        F.concat(F.lit("https://shop.example/account/"), key).alias("url"),
        F.concat(*[F.lit(p) if isinstance(p, str) else p for p in html]).alias("html"))


# the bits of a customer's page, and its selectors
ACCOUNT_SQL = """account AS (
  SELECT *, CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN b0 THEN '#f' || c_custkey WHEN b1 OR b2 THEN 'form > input:nth-of-type(1)'
              ELSE 'form > input' END AS text_selector,
         'form > input:nth-of-type(' || (CASE WHEN b1 THEN 3 ELSE 2 END) || ')' AS search_selector,
         CASE WHEN b0 THEN 'a:nth-of-type(2)' ELSE 'a' END AS export_selector
  FROM (SELECT *, c_custkey % 2 = 1 AS b0, (c_custkey // 2) % 2 = 1 AS b1,
               (c_custkey // 4) % 2 = 1 AS b2, (c_custkey // 8) % 2 = 1 AS b3 FROM customer))"""


# -- runs of steps ----------------------------------------------------------

def steps(spark: SparkSession, sf: str) -> DataFrame:
    """``action_steps`` from events: a trajectory per user and day, errors are failed steps.

    A step's index is its time of day in milliseconds: it orders the steps without numbering them.
    """
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("trajectory_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")))
    return conform(rows.select(
        text("event_id").alias("id"), "trajectory_id", (F.unix_millis("ts") % 86400000).alias("step_index"),
        F.col("event_type").alias("action_type"),
        F.concat(F.lit("#f"), F.col("user_id").cast("string")).alias("selector"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"),
        F.floor(F.col("value") * F.lit(100.0)).cast("int").alias("duration_ms"),
        F.md5(F.floor(F.col("event_id") / F.lit(4)).cast("string")).alias("before_dom_hash"),
        F.md5(F.floor((F.col("event_id") + 1) / F.lit(4)).cast("string")).alias("after_dom_hash"),
        F.col("ts").alias("executed_at"), F.col("ts").alias("created_at")), "action_steps")


STEPS_SQL = """steps AS (
  SELECT CAST(event_id AS VARCHAR) AS id, user_id || '-' || strftime(ts, '%Y%m%d') AS trajectory_id, user_id,
         CAST(epoch_us(ts) // 1000 % 86400000 AS INTEGER) AS step_index,
         event_type AS action_type, '#f' || user_id AS selector,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CAST(event_id % 4 AS INTEGER) AS retry_count, CAST(floor(value * 100.0::DOUBLE) AS INTEGER) AS duration_ms,
         md5(CAST(event_id // 4 AS VARCHAR)) AS before_dom_hash,
         md5(CAST((event_id + 1) // 4 AS VARCHAR)) AS after_dom_hash, ts AS executed_at
  FROM events)"""


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """``trajectories`` of those steps; page = user, goal by the day."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return conform(rows.groupBy("user_id", F.date_format("ts", "yyyyMMdd").alias("day")).agg(
        F.count("*").alias("total_steps"), F.count_if(F.col("event_type") != "error").alias("successful_steps"),
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")).select(
        F.concat_ws("-", "user_id", "day").alias("id"), text("user_id").alias("page_id"),
        F.concat(F.lit("goal-"), (F.col("day").cast("int") % 3).cast("string")).alias("goal"),
        F.when(F.col("total_steps") == F.col("successful_steps"), "success").otherwise("failed").alias("status"),
        "total_steps", "successful_steps", "started_at", "finished_at",
        F.col("finished_at").alias("created_at")), "trajectories")


TRAJECTORIES_SQL = """trajectories AS (
  SELECT user_id || '-' || day AS id, CAST(user_id AS VARCHAR) AS page_id, 'goal-' || (CAST(day AS INTEGER) % 3) AS goal,
         CASE WHEN n = ok THEN 'success' ELSE 'failed' END AS status, n AS total_steps, ok AS successful_steps,
         started_at, finished_at
  FROM (SELECT user_id, strftime(ts, '%Y%m%d') AS day, count(*) AS n,
               count(*) FILTER (event_type <> 'error') AS ok, min(ts) AS started_at, max(ts) AS finished_at
        FROM events GROUP BY 1, 2))"""


def user_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages those runs happened on: one per user, on one of twenty sites."""
    return table(spark, sf, "events").select("user_id").distinct().select(
        text("user_id").alias("id"), F.concat(F.lit("site-"), (F.col("user_id") % 20).cast("string")).alias("site_id"),
        F.concat(F.lit("https://app.example/user/"), text("user_id")).alias("url"),
        F.when(F.col("user_id") % 3 == 0, "list").otherwise("form").alias("page_type"))


USER_PAGES_SQL = """user_pages AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS id, 'site-' || (user_id % 20) AS site_id,
         'https://app.example/user/' || user_id AS url,
         CASE WHEN user_id % 3 = 0 THEN 'list' ELSE 'form' END AS page_type
  FROM events)"""


# -- annotation -------------------------------------------------------------

_KIND = ("page_type", "element_role", "trajectory_failure", "preference")


def _kind() -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in _KIND]), (F.col("doc_id") % 4 + 1).cast("int"))


def annotation_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """``annotation_tasks`` from labels: good documents are pending, others completed."""
    return conform(table(spark, sf, "labels").select(
        text("doc_id").alias("id"), F.concat(F.lit("p"), text("doc_id")).alias("page_id"),
        F.concat(F.lit("t"), text("doc_id")).alias("trajectory_id"), _kind().alias("annotation_type"),
        (F.col("doc_id") % 10 + 1).cast("int").alias("priority"),
        F.when(F.col("quality") == 1, "pending").otherwise("completed").alias("status"),
        later(F.col("doc_id")).alias("created_at"), later(F.col("doc_id")).alias("updated_at")), "annotation_tasks")


_KIND_SQL = "['page_type', 'element_role', 'trajectory_failure', 'preference'][1 + doc_id % 4]"
TASKS_SQL = f"""tasks AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'p' || doc_id AS page_id, 't' || doc_id AS trajectory_id,
         {_KIND_SQL} AS annotation_type, CAST(doc_id % 10 + 1 AS INTEGER) AS priority,
         CASE WHEN quality = 1 THEN 'pending' ELSE 'completed' END AS status,
         TIMESTAMP '{START}' + to_seconds(doc_id) AS created_at
  FROM labels)"""


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Two submissions per label and one for a task that does not exist; toxic labels carry no payload."""
    rows = table(spark, sf, "labels").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    given = F.col("toxic") == 0
    step = F.concat(F.lit('[{"action":"click","n":'), text("n"), F.lit("}]"))
    return rows.select(
        F.when(F.col("n") == 2, F.concat(F.lit("gone-"), text("doc_id"))).otherwise(text("doc_id"))
         .alias("annotation_task_id"),
        _kind().alias("annotation_type"), F.concat(F.lit("ann-"), text(F.col("doc_id") % 7)).alias("annotator_id"),
        F.when(given, F.concat(F.lit("label-"), text("n"))).alias("corrected_label"),
        F.when(given, F.concat(F.lit("c"), text("doc_id"))).alias("chosen_trajectory_id"),
        F.when(F.col("n") == 1, F.concat(F.lit("r"), text("doc_id"))).alias("rejected_trajectory_id"),
        F.from_json(F.when(given, step).otherwise("[]"), "array<variant>").alias("corrected_steps"),
        F.lit(None).cast("string").alias("notes"),
        later(F.col("doc_id") + F.col("n") * 1000).alias("submitted_at"))


SUBMISSIONS_SQL = f"""submissions AS (
  SELECT CASE WHEN n = 2 THEN 'gone-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS annotation_task_id,
         {_KIND_SQL} AS annotation_type, 'ann-' || (doc_id % 7) AS annotator_id, n,
         CASE WHEN toxic = 0 THEN 'label-' || n END AS corrected_label,
         CASE WHEN toxic = 0 THEN 'c' || doc_id END AS chosen_trajectory_id,
         CASE WHEN n = 1 THEN 'r' || doc_id END AS rejected_trajectory_id,
         CASE WHEN toxic = 0 THEN '[{{"action":"click","n":' || n || '}}]' ELSE '[]' END AS corrected_steps,
         TIMESTAMP '{START}' + to_seconds(doc_id + n * 1000) AS submitted_at
  FROM (SELECT *, unnest([0, 1, 2]) AS n FROM labels))"""


# -- training records -------------------------------------------------------

_TYPES = ("sft", "preference", "reward", "failure")


def training_records(spark: SparkSession, sf: str) -> DataFrame:
    """``training_records`` from conversations: a record per turn, every tenth conversation is validation."""
    payload = F.to_variant_object(F.struct(F.col("text").alias("text")))
    return conform(table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("conv_id") % 4 + 1).cast("int")).alias("data_type"),
        payload.alias("input_payload"), F.to_variant_object(F.struct(F.col("role").alias("role"))).alias("output_payload"),
        F.when(F.col("conv_id") % 4 == 2, (F.col("conv_id") % 5) / F.lit(4.0)).alias("reward"),
        F.when(F.col("conv_id") % 10 == 0, "val").otherwise("train").alias("split"),
        (F.col("turn") % 3 == 0).alias("exported"), later(F.col("conv_id")).alias("created_at")), "training_records")


RECORDS_SQL = """records AS (
  SELECT conv_id || '-' || turn AS id, ['sft', 'preference', 'reward', 'failure'][1 + conv_id % 4] AS data_type,
         CASE WHEN conv_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, turn % 3 = 0 AS exported,
         CASE WHEN conv_id % 4 = 2 THEN (conv_id % 5) / 4.0::DOUBLE END AS reward, text, role
  FROM conversations)"""


# -- sync rows --------------------------------------------------------------

MAPPING = {"o_orderkey": "order_id", "o_orderdate": "updated_at"}


def sync_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted rows: orders, with the date as ISO text."""
    return table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


SYNC_ROWS_SQL = """sync_rows AS (
  SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders)"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
