import json

from pyspark.sql import functions as F

from sitetable.plans import actions as A


def plans(pages_of, build, *htmls):
    rows = build(A.page_elements(pages_of(*htmls))).orderBy("page_id", "step_index").collect()
    return [(r["action_type"], r["selector"]) for r in rows]


def login(pages):
    return A.plan_login(pages, F.lit("jo"), F.lit("vault/7"))


def test_login_plan(pages_of):
    html = ('<form><input type=text name=nick><input type=email id=mail><input type=password id=pw>'
            '<button>Cancel</button><button>Log me in</button><input type=submit id=go></form>')
    assert plans(pages_of, login, html) == [
        ("fill", "#mail"), ("fill", "#pw"), ("click", "#go"), ("wait", None)]


def test_login_plan_without_elements_still_waits(pages_of):
    assert plans(pages_of, login, "<p>x</p>") == [("wait", None)]


def test_earlier_keyword_beats_earlier_element(pages_of):
    # 'login' comes last in the list, 'account' before it
    html = '<input type=text id=a name=login><input type=text id=b name=account>'
    assert plans(pages_of, login, html)[0] == ("fill", "#b")


def test_no_match_falls_back_to_the_first_candidate_and_says_so(pages_of):
    pages = A.page_elements(pages_of('<a id=x href=/>a</a><a id=y href=/>b</a>'))
    row = A.plan_download(pages).first()
    assert row["selector"] == "#x" and row["matched"] is False


def test_attribute_names_match_too(pages_of):
    assert plans(pages_of, A.plan_download, '<a id=x href=/>a</a><a id=y href=/ download>b</a>') == [("download", "#y")]


def test_pagination(pages_of):
    html = '<a href="?p=2" id=n>Next</a>'
    assert plans(pages_of, lambda p: A.plan_paginate(p, 3), html) == [
        ("extract", None)] + [("click", "#n"), ("wait", None), ("extract", None)] * 2
    for n in (0, 1):
        assert plans(pages_of, lambda p, n=n: A.plan_paginate(p, n), html) == [("extract", None)]
    assert plans(pages_of, A.plan_paginate, "<p>x</p>") == [("extract", None)]
    assert len(plans(pages_of, A.plan_paginate, html)) == 1 + 3 * 49


def test_search_and_download_without_elements(pages_of):
    def search(pages):
        return A.plan_search(pages, F.lit("cats"))
    assert plans(pages_of, search, "<p>x</p>") == []
    assert plans(pages_of, A.plan_download, "<p>x</p>") == []
    assert plans(pages_of, search, "<input type=search id=s>") == [("fill", "#s"), ("submit", "#s"), ("wait", None)]


def test_extract_strategy_and_json(pages_of):
    pages = A.page_elements(pages_of("<table><tr><td>1</table>", "<p>x</p>"))
    rows = A.action_json(A.plan_extract(pages)).orderBy("page_id").collect()
    assert [r["meta"]["strategy"] for r in rows] == ["table", "dom"]
    assert json.loads(rows[0]["action"]) == {
        "action_type": "extract", "selector": None, "value": None, "description": "Extract all data rows from page",
        "timeout_ms": None, "fallback_selectors": [], "meta": {"strategy": "table"}}


def test_plan_lengths(pages_of):
    pages = A.page_elements(pages_of("<p>x</p>"))
    assert A.plan_lengths(A.plan_extract(pages)).first()["n_steps"] == 1


def test_replayed_plans_do_not_broadcast_the_plans(spark, tmp_path):
    from workload.page_queries import replayed_plans
    customers = spark.range(4).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"),
                                      F.lit("s").alias("c_mktsegment"))
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = replayed_plans(spark, str(tmp_path))
    rows = sorted((r["page_id"], r["description"], r["resolved"]) for r in found.collect() if r["page_id"] in "02")
    fill, click, wait, password = ("Fill username / email", "Click login / submit", "Wait for navigation after login", "Fill password")
    assert rows == sorted([(p, d, r) for p in "02" for d, r in ((fill, True), (click, False), (wait, None))] + [("2", password, True)],
                          key=lambda row: row[:2])
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
