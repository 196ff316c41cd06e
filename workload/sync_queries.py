"""Queries over tables and sync: mapping, targets, upserts, checks, reconciliation, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetable.functions.text import as_text, iso_utc
from sitetable.operators import metrics as M
from sitetable.operators import sync as Y
from sitetable.operators import tables as K
from sitetable.operators.pages import table_rows
from sitetable.schemas import conform
from sitetable.session import scratch_dir
from sitetable.sources.audit import LOG_LINE, append_log
from sitetable.sources.targets import all_text, append_union, last_cursor, open_target
from sitetable.streaming import flows
from workload.inputs import (MAPPING, STEPS_SQL, SYNC_ROWS_SQL, TRAJECTORIES_SQL, USER_PAGES_SQL, account_pages, steps,
                             sync_rows, table, text, trajectories, user_pages, with_sql)
from workload.pii_queries import _all_types
from workload.registry import query
from workload.step_queries import audit_events

_MAPPED = """o_orderkey AS order_id, o_orderdate AS updated_at, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"""


@query("P1", with_sql(SYNC_ROWS_SQL, select=f"SELECT {_MAPPED} FROM sync_rows"))
def mapped_orders(spark, sf):
    return Y.map_fields(sync_rows(spark, sf), MAPPING)


@query("P1", "SELECT o_totalprice AS o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def mapped_with_collisions(spark, sf):
    """Two sources share a target: the later one wins."""
    rows = table(spark, sf, "orders").drop("o_orderdate")
    return Y.map_fields(rows, {"o_custkey": "o_custkey", "o_totalprice": "o_custkey"})


@query("A2", with_sql(SYNC_ROWS_SQL, select="SELECT max(o_orderdate) AS last_cursor, CAST(NULL AS VARCHAR) AS missing FROM sync_rows"))
def sync_cursor(spark, sf):
    target = open_target(spark, "parquet", scratch_dir(spark, "cursor"))
    missing = target.last_cursor("orders")
    target.append(Y.map_fields(sync_rows(spark, sf), MAPPING), "orders")
    return spark.createDataFrame([(target.last_cursor("orders"), missing)], "last_cursor string, missing string")


@query("Y3 A2", with_sql(SYNC_ROWS_SQL, select="""
SELECT o_orderkey AS order_id, o_orderdate AS updated_at FROM sync_rows
WHERE o_orderdate > (SELECT max(o_orderdate) FROM sync_rows WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AND o_totalprice < 2000)
   OR (SELECT max(o_orderdate) FROM sync_rows WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AND o_totalprice < 2000) IS NULL"""))
def increment_after_cursor(spark, sf):
    rows = Y.map_fields(sync_rows(spark, sf), MAPPING)
    done = rows.filter("o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AND o_totalprice < 2000")
    return Y.after_cursor(rows, last_cursor(done)).select("order_id", "updated_at")


@query("Y3 Y2 A2 A6", with_sql(SYNC_ROWS_SQL, select="""
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_orders, max(o_orderdate) AS last_cursor,
       CAST(count(*) AS BIGINT) AS rows_synced FROM sync_rows WHERE o_orderdate IS NOT NULL AND o_orderdate <> ''"""))
def two_step_increment(spark, sf):
    """Finished and other orders up to a day, then all of them: the stored cursor lets only the later ones through."""
    base = scratch_dir(spark, "increment")
    tasks = Y.register_tasks(spark.sql(f"SELECT 't' AS id, 's' AS site_id, 'https://d.example/orders' AS source_url, "
                                       f"'parquet' AS target_type, '{base}' AS target_path"))
    rows = sync_rows(spark, sf).filter("o_orderdate IS NOT NULL AND o_orderdate <> ''")
    for part in (rows.filter("o_orderdate < '1996-01-01'"), rows):
        new = Y.after_cursor(part, Y.stored_cursor(tasks, "t"), "o_orderdate")
        tasks = Y.apply_reports(tasks, Y.report_rows(spark, [Y.run_sync(tasks, "t", new, cursor="o_orderdate")]))
    synced = open_target(spark, "parquet", base).read("d_example_orders")
    cursor, n = tasks.select("last_cursor", "rows_synced").first()
    return synced.agg(F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_orders")) \
                 .withColumns({"last_cursor": F.lit(cursor), "rows_synced": F.lit(n).cast("long")})


def _round_trip(spark, sf, kind):
    """Sync finished orders, then the open ones with one more column, and read all of them back."""
    target = open_target(spark, kind, scratch_dir(spark, f"sync-{kind}"))
    rows = Y.map_fields(sync_rows(spark, sf), MAPPING)
    target.append(rows.filter("o_orderstatus = 'F'").drop("o_orderpriority"), "orders")
    target.append(rows.filter("o_orderstatus <> 'F'").withColumn(
        "meta", F.struct(F.col("o_custkey").alias("cust"))), "orders")
    return target.read("orders")


_ROUND = """
SELECT {id} AS order_id, o_orderdate AS updated_at, o_orderstatus,
       CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority, {meta} AS meta FROM sync_rows"""


@query("S2 S3 S8 U1 F5", with_sql(SYNC_ROWS_SQL, select=_ROUND.format(
    id="CAST(o_orderkey AS VARCHAR)", meta="""CASE WHEN o_orderstatus <> 'F' THEN '{"cust":' || o_custkey || '}' END""")))
def csv_round_trip(spark, sf):
    return _round_trip(spark, sf, "CSV").select("order_id", "updated_at", "o_orderstatus", "o_orderpriority", "meta")


@query("S4 S5 S8 U1", with_sql(SYNC_ROWS_SQL, select=_ROUND.format(
    id="o_orderkey", meta="CASE WHEN o_orderstatus <> 'F' THEN o_custkey END")))
def parquet_round_trip(spark, sf):
    return _round_trip(spark, sf, "Parquet").select(
        "order_id", "updated_at", "o_orderstatus", "o_orderpriority", F.col("meta.cust").alias("meta"))


@query("S6 S7 S8 U1 F5", with_sql(SYNC_ROWS_SQL, select=_ROUND.format(
    id="CAST(o_orderkey AS VARCHAR)", meta="""CASE WHEN o_orderstatus <> 'F' THEN '{"cust":' || o_custkey || '}' END""")))
def text_table_round_trip(spark, sf):
    return _round_trip(spark, sf, "sqlite").select("order_id", "updated_at", "o_orderstatus", "o_orderpriority", "meta")


@query("F5", """SELECT c_custkey, '{"name":"' || c_name || '","nation":' || c_nationkey || '}' AS meta,
  '["' || c_mktsegment || '"]' AS tags, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def nested_as_json(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("meta"),
        F.array("c_mktsegment").alias("tags"), F.col("c_nationkey").alias("nation"))
    return all_text(rows).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("U1", """SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS name, c_mktsegment AS segment, NULL AS acctbal FROM customer
  UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def union_by_name(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                                    F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"),
                                                    F.col("s_suppkey").alias("key"))
    return append_union(customers, suppliers)


def _task_rows(spark, sf):
    """A sync task per region: regions 0 and 1 go to Parquet, 2 to CSV, 3 to text, 4 to a type that is refused."""
    kinds = F.array(*[F.lit(k) for k in ("parquet", "PARQUET", "csv", "sqlite", "mystery")])
    return table(spark, sf, "region").select(
        text("r_regionkey").alias("id"), F.concat(F.lit("site-"), text("r_regionkey")).alias("site_id"),
        F.concat(F.lit("https://data.example/"), F.col("r_name"), F.lit("?q=")).alias("source_url"),
        F.element_at(kinds, (F.col("r_regionkey") % 5 + 1).cast("int")).alias("target_type"),
        F.lit("unset").alias("target_path"),
        F.create_map(F.lit("c_custkey"), F.lit("customer")).alias("field_mapping"))


@query("Y1", """SELECT CAST(r_regionkey AS VARCHAR) AS id, 'site-' || r_regionkey AS site_id, 'pending' AS status,
  CAST(0 AS BIGINT) AS rows_synced, ['parquet', 'PARQUET', 'csv', 'sqlite', 'mystery'][r_regionkey % 5 + 1] AS target_type FROM region""")
def registered_tasks(spark, sf):
    return Y.register_tasks(_task_rows(spark, sf)).select("id", "site_id", "status", "rows_synced", "target_type")


@query("Y2 A6 S8 P1 S12", """
SELECT CAST(r_regionkey AS VARCHAR) AS id, CASE WHEN r_regionkey = 4 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN r_regionkey = 4 THEN 0 ELSE 2 * n END AS rows_synced,
       CASE WHEN r_regionkey = 4 THEN 'failure' ELSE 'success' END AS outcome, CAST(2 AS BIGINT) AS n_audited
FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
  ON n_regionkey = r_regionkey""")
def sync_runs(spark, sf):
    """Every region's customers are synced twice by the region's task; counts add up, failures are booked."""
    base, log = scratch_dir(spark, "sync-runs"), scratch_dir(spark, "sync-audit")
    tasks = Y.register_tasks(_task_rows(spark, sf).withColumn(
        "target_path", F.concat(F.lit(base + "/"), F.col("id"))))
    nations = table(spark, sf, "nation")
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    reports = [Y.run_sync(tasks, str(r), customers.filter(F.col("n_regionkey") == r), log)
               for _ in range(2) for r in range(5)]
    booked = Y.apply_reports(tasks, Y.report_rows(spark, reports))
    audited = spark.read.schema(LOG_LINE).json(log).groupBy(F.col("resource_id").alias("id"), "outcome") \
                   .agg(F.count("*").alias("n_audited"))
    return booked.join(audited, "id").select("id", "status", "rows_synced", "outcome", "n_audited")


@query("J2", """SELECT 'https://' || lower(c_mktsegment) || '.example' AS origin,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'kept' ELSE min(c_name) END AS name FROM customer GROUP BY c_mktsegment""")
def sites_get_or_create(spark, sf):
    """Two of the sites exist; of many new rows for an origin the first by key is inserted."""
    seen = table(spark, sf, "customer").select(
        F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example")).alias("origin"),
        F.col("c_name").alias("name"), "c_custkey")
    old = seen.filter(F.col("origin").rlike("building|machinery")).select("origin", F.lit("kept").alias("name")).distinct()
    return K.get_or_create(old, seen, ["origin"], ["name"]).select("origin", "name")


@query("J3 Y4", """
SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'old' ELSE 'new' END AS made_by,
       round(CASE WHEN c_acctbal > 3000 OR c_mktsegment = 'BUILDING' THEN c_acctbal + 2 ELSE c_acctbal END, 2) AS c_acctbal
FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 3000 OR c_mktsegment = 'BUILDING'""")
def upserted_customers(spark, sf):
    """Rich customers and a whole segment are updated, twice each; only the later update counts."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.lit("old").alias("made_by"))
    old = rows.filter("c_mktsegment <> 'BUILDING'")
    fresh = rows.filter("c_acctbal > 3000 OR c_mktsegment = 'BUILDING'").withColumn("made_by", F.lit("new"))
    updates = fresh.withColumn("n", F.explode(F.array(F.lit(2), F.lit(1)))) \
                   .withColumn("c_acctbal", F.col("c_acctbal") + F.col("n"))
    out = K.upsert(old, updates, ["c_custkey"], ["c_acctbal"], order=["n"])
    return out.select("c_custkey", "made_by", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("Y4 S5", """SELECT o_orderkey AS order_id, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 'seen twice' ELSE 'seen once' END AS note
FROM orders""")
def upserted_target(spark, sf):
    """All orders are synced by key, then the open ones again with a new column value."""
    target = open_target(spark, "parquet", scratch_dir(spark, "upsert-target"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus",
                                             F.lit("seen once").alias("note"))
    target.upsert(rows, "orders", ["order_id"])
    target.upsert(rows.filter("o_orderstatus = 'O'").withColumn("note", F.lit("seen twice")), "orders", ["order_id"])
    return target.read("orders")


@query("Y4 R3", """SELECT o_orderkey AS order_id, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN 9 WHEN o_orderkey % 50 = 0 THEN 8 ELSE 0 END AS n,
  CASE WHEN o_orderkey % 7 = 0 THEN 'seven' END AS note FROM orders""")
def compacted_target(spark, sf):
    """Ten upserts by key: whole rows, then eight of a column of some rows, then another column: deltas and rewrites."""
    target = open_target(spark, "parquet", scratch_dir(spark, "compacted"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus", F.lit(0).alias("n"))
    target.upsert(rows, "orders", ["order_id"])
    for n in range(1, 9):
        target.upsert(rows.filter("order_id % 50 = 0").select("order_id", F.lit(n).alias("n")), "orders", ["order_id"])
    target.upsert(rows.filter("order_id % 7 = 0").select("order_id", F.lit(9).alias("n"), F.lit("seven").alias("note")),
                  "orders", ["order_id"])
    return target.read("orders")


@query("Y2 Y4", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 2 ELSE 1 END AS n_rows,
  CAST(c_custkey % 4 AS INTEGER) AS task FROM customer""")
def side_by_side_syncs(spark, sf):
    """Four tasks sync their customers into one table at once, one of them by appending twice: nothing is lost or doubled."""
    path, customers = scratch_dir(spark, "side-by-side"), table(spark, sf, "customer")
    ids = spark.range(4).select(text("id").alias("id"))
    tasks = Y.register_tasks(ids.select("id", F.lit("s").alias("site_id"), F.lit("https://d.example/list").alias("source_url"),
                                        F.lit("parquet").alias("target_type"), F.lit(path).alias("target_path")))
    part = lambda i: customers.filter(F.col("c_custkey") % 4 == i).select("c_custkey", F.lit(i).alias("task"))
    first = Y.run_syncs(tasks, {str(i): part(i) for i in range(3)}, keys=["c_custkey"])
    both = Y.run_syncs(tasks, {"3": part(3)}) + Y.run_syncs(tasks, {"3": part(3)})
    assert all(r.status == "success" for r in first + both), [r.error for r in first + both]
    return open_target(spark, "parquet", path).read("d_example_list").groupBy("c_custkey", "task").agg(F.count("*").cast("int").alias("n_rows"))


@query("S2 S3", """SELECT doc_id::VARCHAR AS doc_id, md5(replace(text, '  ', ' "' || chr(10))) AS text_md5, lang FROM documents""")
def csv_with_line_breaks(spark, sf):
    """Texts with line breaks and quotes, written as CSV and read back in byte ranges."""
    target = open_target(spark, "csv", scratch_dir(spark, "csv-breaks"))
    target.append(table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("  "), F.lit(' "\n')).alias("text"), "lang"), "docs")
    return target.read("docs").select("doc_id", F.md5("text").alias("text_md5"), "lang")


def _site_tables(spark, sf):
    pages = user_pages(spark, sf)
    return {
        "sites": pages.select(F.col("site_id").alias("id"), F.col("site_id").alias("origin")).distinct(),
        "pages": pages, "trajectories": trajectories(spark, sf).drop("meta"), "action_steps": steps(spark, sf).drop("meta"),
        "annotation_tasks": pages.select(F.col("id"), F.col("id").alias("page_id"),
                                         F.lit("page_type").alias("annotation_type"), F.lit("pending").alias("status"))}


@query("J4", with_sql(STEPS_SQL, TRAJECTORIES_SQL, USER_PAGES_SQL, select="""
SELECT 'sites' AS table_name, count(DISTINCT site_id) AS n_rows, 0 AS n_unlinked FROM user_pages WHERE site_id NOT IN ('site-3', 'site-7')
UNION ALL SELECT 'pages', count(*), 0 FROM user_pages WHERE site_id NOT IN ('site-3', 'site-7')
UNION ALL SELECT 'trajectories', count(*), 0 FROM trajectories t JOIN user_pages p ON p.id = t.page_id WHERE site_id NOT IN ('site-3', 'site-7')
UNION ALL SELECT 'action_steps', count(*), 0 FROM steps s JOIN user_pages p ON p.id = CAST(s.user_id AS VARCHAR) WHERE site_id NOT IN ('site-3', 'site-7')
UNION ALL SELECT 'annotation_tasks', count(*), count(*) FILTER (site_id IN ('site-3', 'site-7')) FROM user_pages"""))
def cascaded_delete(spark, sf):
    tables = _site_tables(spark, sf)
    gone = tables["sites"].filter(F.col("id").isin("site-3", "site-7"))
    left = K.delete_cascade(tables, "sites", gone)
    out = None
    for name, df in left.items():
        unlinked = F.count_if(F.col("page_id").isNull()) if name == "annotation_tasks" else F.lit(0).cast("long")
        row = df.agg(F.count("*").alias("n_rows"), unlinked.alias("n_unlinked")).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("P12", with_sql(STEPS_SQL, TRAJECTORIES_SQL, select="""
SELECT 'action_steps' AS table_name, 'domain' AS rule, 'action_type' AS column_name, action_type AS key, count(*) AS n_rows
FROM steps WHERE action_type NOT IN ('click', 'fill', 'select', 'submit', 'download', 'wait', 'navigate', 'scroll', 'hover', 'extract', 'sync') GROUP BY 4
UNION ALL SELECT 'action_steps', 'reference', 'trajectory_id', trajectory_id, count(*) FROM steps
  WHERE trajectory_id IN (SELECT id FROM trajectories WHERE goal = 'goal-1') GROUP BY 4
UNION ALL SELECT 'annotation_tasks', 'required', 'annotation_type', NULL, count(DISTINCT user_id) FROM events
UNION ALL SELECT 'annotation_tasks', 'unique', 'id', 'same', count(DISTINCT user_id) FROM events"""))
def rule_violations(spark, sf):
    tables = _site_tables(spark, sf)
    tables["trajectories"] = tables["trajectories"].filter("goal <> 'goal-1'")
    tables["annotation_tasks"] = tables["annotation_tasks"].withColumn("id", F.lit("same")) \
        .withColumn("annotation_type", F.lit(None).cast("string"))
    return K.violations(tables)


@query("P12", """
SELECT 'pages' AS table_name, 'length' AS rule, c AS column_name, n::VARCHAR AS key, count(*) AS n_rows
FROM (SELECT 'url' AS c, length(text) + 18 AS n FROM documents WHERE length(text) + 18 > 2048
      UNION ALL SELECT 'title', length(text) FROM documents WHERE length(text) > 512) GROUP BY ALL""")
def length_violations(spark, sf):
    """Urls and titles that are longer than declared."""
    docs = table(spark, sf, "documents")
    pages = docs.select(text("doc_id").alias("id"), F.lit("s").alias("site_id"), F.concat(F.lit("https://d.example/"), F.col("text")).alias("url"),
                        F.col("text").alias("title"), F.lit("list").alias("page_type"))
    return K.violations({"pages": pages})


@query("J8", "SELECT CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END) AS BIGINT) AS n_source, count(*) AS n_target, "
       "count(*) FILTER (o_totalprice <= 400000) AS n_matched, "
       "round(count(*) FILTER (o_totalprice <= 400000) / sum(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END), 6) AS fidelity FROM orders")
def sync_fidelity(spark, sf):
    """The source repeats some rows, the target has other prices for some: copies and changes both count."""
    rows = table(spark, sf, "orders")
    source = rows.unionByName(rows.filter("o_orderstatus = 'P'"))
    target = rows.withColumn("o_totalprice", F.when(F.col("o_totalprice") > 400000, -F.col("o_totalprice"))
                             .otherwise(F.col("o_totalprice")))
    return M.fidelity(source, target).withColumn("fidelity", F.round("fidelity", 6))


@query("A9 E13", """SELECT CAST(c_nationkey AS VARCHAR) AS site, CAST(3 * count(*) AS BIGINT) AS n_expected,
  2 * count(*) AS n_extracted, round(2 / 3.0, 6) AS completeness FROM customer GROUP BY 1""")
def extraction_completeness(spark, sf):
    """Two of the three table rows of an account page are data, the third one is its header."""
    sites = table(spark, sf, "customer").select(text("c_custkey").alias("page_id"), text("c_nationkey").alias("site"))
    rows = table_rows(account_pages(spark, sf)).join(sites, "page_id")
    expected = sites.groupBy("site").agg((F.count("*") * 3).alias("n_expected"))
    return M.completeness(rows, expected, ["site"]).withColumn("completeness", F.round("completeness", 6))


@query("K4", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)), 6) AS similarity
FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) DESC, vec_id LIMIT 10""")
def most_similar_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    query_vector = vectors.orderBy("vec_id").select("embedding").first()[0]
    return M.most_similar(vectors, query_vector, 10, key="vec_id").select(
        "vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("K4", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id AS query, v AS w FROM v ORDER BY vec_id LIMIT 5)
SELECT query, vec_id, round(list_cosine_similarity(v, w), 6) AS similarity,
       CAST(row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(v, w) DESC, vec_id) AS INTEGER) AS rank
FROM v, q QUALIFY rank <= 10""")
def most_similar_to_each(spark, sf):
    """A batch of five query vectors over all vectors."""
    vectors = table(spark, sf, "embeddings")
    batch = {r["vec_id"]: r["embedding"] for r in vectors.orderBy("vec_id").select("vec_id", "embedding").limit(5).collect()}
    return M.most_similar_each(vectors, batch, 10, key="vec_id").withColumn("similarity", F.round("similarity", 6))


# -- streams ---------------------------------------------------------------------

_HOURS = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS window_start, 'event.' || event_type AS action,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, count(*) AS n_events FROM events GROUP BY ALL"""


@query("R1", _HOURS)
def audit_stream_counts(spark, sf):
    log, out = scratch_dir(spark, "audit-stream"), scratch_dir(spark, "audit-counts")
    append_log(audit_events(spark, sf), log)
    counts = flows.audit_counts(flows.read_audit_stream(spark, log))
    flows.write_counts(counts, out, scratch_dir(spark, "audit-state")).awaitTermination()
    return flows.read_counts(spark, out).select(iso_utc("window_start").alias("window_start"), "action", "outcome",
                                                "n_events")


@query("R1", _HOURS)
def audit_table_counts(spark, sf):
    return flows.audit_counts(audit_events(spark, sf)).select(
        iso_utc("window_start").alias("window_start"), "action", "outcome", "n_events")


def _page_stream(spark, sf):
    """The pages file as a stream, each page sent twice."""
    schema = table(spark, sf, "pages").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/pages.parque[t]")  # one file, or a folder of part files
    return rows.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("site_id"), "url", "html",
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("collected_at"))


@query("R2 E1 E10 F1", rf"""
SELECT url, md5({_all_types('html')}) AS html_md5,
       sha256(html) AS content_hash, len(regexp_extract_all(html, '<a href="[^"]*">')) AS n_elements FROM pages""")
def page_stream(spark, sf):
    pages, elements = scratch_dir(spark, "pages"), scratch_dir(spark, "elements")
    flows.write_pages(_page_stream(spark, sf), pages, elements, scratch_dir(spark, "pages-state")).awaitTermination()
    counted = spark.read.parquet(elements).groupBy("page_id").agg(F.count("*").alias("n_elements"))
    return spark.read.parquet(pages).join(counted, F.col("id") == F.col("page_id"), "left").select(
        "url", F.md5("html").alias("html_md5"), "content_hash",
        F.coalesce("n_elements", F.lit(0)).alias("n_elements"))


@query("R3 Y4 Y2", f"SELECT {_MAPPED} FROM orders")
def sync_stream(spark, sf):
    schema = table(spark, sf, "orders").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    path = scratch_dir(spark, "stream-sync")
    for _ in range(2):  # the second run finds nothing new: the checkpoint is the cursor
        flows.stream_sync(rows, "parquet", path, "orders", f"{path}-state", MAPPING, ["order_id"]).awaitTermination()
    return open_target(spark, "parquet", path).read("orders")
