"""Html that stays where it lies; page streams and versions that move slim rows only."""

from pyspark.sql import functions as F

from sitetable.operators.pages import page_versions
from sitetable.sources.pagestore import PageStore
from sitetable.streaming import flows


def pages(spark, *rows):
    df = spark.createDataFrame(list(rows), "id string, url string, version int, n int, html string")
    return df.withColumn("collected_at", F.timestamp_seconds("n")).drop("n")


def exchanges_with(df, column):
    """Shuffles of a plan that carry a column."""
    plan = df._jdf.queryExecution().executedPlan()
    found, left = [], [plan]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.inputPlan())
            continue
        if node.nodeName() in ("Exchange", "BroadcastExchange") and f"{column}#" in node.output().toString():
            found.append(node.nodeName())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_latest_pages_without_moving_html(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "store"), n_buckets=4)
    store.add(pages(spark, ("1", "u", 1, 5, "<p>a"), ("2", "u", 2, 6, "<p>b"), ("3", "v", 1, 5, "<p>a"), ("4", "w", 1, 5, None)))
    store.add(pages(spark, ("5", "v", 2, 9, "<p>b"), ("6", "x", 1, 1, "<p>c")), part="second")
    store.add(pages(spark, ("5", "v", 2, 9, "<p>b"), ("6", "x", 1, 1, "<p>c")), part="second")
    assert store.html().count() == 3  # every html once
    again = PageStore(spark, str(tmp_path / "store"), n_buckets=8)
    assert again.n_buckets == 4 and again.pages().count() == 6
    latest = again.latest()
    assert {(r["url"], r["id"], r["html"]) for r in latest.collect()} == {
        ("u", "2", "<p>b"), ("v", "5", "<p>b"), ("w", "4", None), ("x", "6", "<p>c")}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges_with(again.latest().select("id", "html"), "html") == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [r["id"] for r in again.latest("v").collect()] == ["5"]


def test_snapshots_sent_once_do_not_move(spark):
    rows = pages(spark, *[(str(i), f"u{i}", 1, i, f"<p>{i}") for i in range(20)]).drop("id")
    stored = flows.fresh_snapshots(rows.filter("url IN ('u1', 'u2')")).select("id", "day")
    fresh = flows.fresh_snapshots(rows, stored)
    assert fresh.count() == 18 and "Exchange" not in exchanges_with(fresh, "html")
    twice = flows.fresh_snapshots(rows.union(rows.filter("url > 'u5'")), stored)
    assert sorted(r["url"] for r in twice.collect()) == sorted(r["url"] for r in fresh.collect())


def test_few_ids_or_many_give_the_same(spark, monkeypatch):
    rows = pages(spark, *[(str(i), f"u{i % 7}", 1, i % 7, f"<p>{i % 7}") for i in range(20)]).drop("id")
    stored = flows.fresh_snapshots(rows.filter("url = 'u1'")).select("id", "day")
    few = sorted(r["url"] for r in flows.fresh_snapshots(rows, stored).collect())
    monkeypatch.setattr(flows, "ASIDE_IDS", 1)
    assert few == sorted(r["url"] for r in flows.fresh_snapshots(rows, stored).collect()) == ["u0", "u2", "u3", "u4", "u5", "u6"]


def test_a_url_with_one_time_is_many_slices(spark):
    rows = spark.range(2000).select(F.format_string("%06d", "id").alias("id"), F.lit("u").alias("url"),
                                    F.lit(None).cast("timestamp").alias("collected_at"), F.floor(F.col("id") / 3).cast("string").alias("html"))
    seen = page_versions(rows, slices=8)
    got = [(r["version"], r["changed"]) for r in seen.orderBy("id").collect()]
    assert got == [(i // 3 + 1, i % 3 == 0 and i > 0) for i in range(2000)]
    from sitetable.operators.chunks import in_slices
    sizes = in_slices(rows.drop("html"), ["url", "collected_at", "id"], 8).groupBy("_slice").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 600
