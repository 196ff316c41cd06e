"""Selectors as people write them, on pages worked out by hand."""

import time

import pytest
from pyspark.sql import functions as F

from sitetable.functions.html import parse_page
from sitetable.operators.selectors import found_by_selector, replay_on_pages

PAGE = ('<html><body><nav class="top  main"><ul><li><a href="/x" class="on">X</a></li><li><a href="/y">Y</a></li></ul></nav>'
        '<form id="f1" action="/s"><input name="q" type="search"><div><input name=pw type=password class="a b-c"></div>'
        '<button data-x="a > b, c]">Go</button></form><p id="a.b">t</p></body></html>')

FOUND = {
    "input[name=q]": 1, 'input[name="pw"]': 1, "input": 2, "form input": 2, "form > input": 1, "form > div > input": 1,
    "nav a": 2, "nav > a": 0, "nav.top.main a.on": 1, ".on": 1, "a.off": 0, "li:nth-of-type(2) > a": 1, "#f1 button": 1,
    "ul li a[href^='/']": 2, "a[href$=y]": 1, "a[href*=x]": 1, "[href]": 2, "input.b-c[type=password]": 1, "nav[class~=main]": 1,
    "*": 14, "ul *": 4, "button[data-x='a > b, c]']": 1, "p, button": 2, "P": 1, r"#a\.b": 1, "nav input": 0, "form  >  div   input": 1,
    "input:hover": None, "a + b": None, "": None, "a >": None, "a, ": None, "a[": None,
}


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([("p", PAGE), ("empty", ""), ("null", None)], "id string, html string")
    asked = spark.createDataFrame([(p, s) for s in FOUND for p in ("p", "empty")] + [("gone", "a"), ("null", "a"), ("p", None)],
                                  "page_id string, selector string")
    return {(r["page_id"], r["selector"]): r for r in found_by_selector(pages, asked).collect()}


@pytest.mark.parametrize("selector", list(FOUND))
def test_elements_found(found, selector):
    row = found["p", selector]
    assert (row["n_found"] if row["known"] else None) == FOUND[selector]
    assert found["empty", selector]["n_found"] == 0


def test_pages_that_are_not_there(found):
    assert ("gone", "a") not in found and found["null", "a"]["n_found"] == 0


def test_replay_tries_selectors_in_order(spark):
    pages = spark.createDataFrame([("p", PAGE)], "id string, html string")
    steps = spark.createDataFrame([(1, "p", "#gone", ["form input[type=password]", "nav a"]), (2, "p", None, None), (3, "p", "b", []),
                                   (4, "gone", "a", None)], "id int, page_id string, selector string, fallback_selectors array<string>")
    rows = {r["id"]: tuple(r)[2:] for r in replay_on_pages(steps, pages).collect()}
    assert rows == {1: (True, 1, "form input[type=password]"), 2: (None, None, None), 3: (False, None, None), 4: (False, None, None)}


def test_nested_forms_and_links_in_linear_time():
    deep = '<div><form action="x">' * 8000 + '<input type="text">'
    start = time.time()
    signals = parse_page(deep, ("signals",))["signals"]
    assert signals == {"inputs": 1, "submit": False, "form_inputs": ["text"]}
    forms = parse_page(deep, ("forms",))["forms"]
    assert len(forms) == 8000 and all(len(f["inputs"]) == 1 for f in forms)
    texts = parse_page('<div><a href="x"><b>t' * 8000, ("links",))["links"]
    assert len(texts) == 8000 and len(texts[0]["text"]) == 8000
    assert time.time() - start < 2


def test_parts_of_forms_stay_apart():
    page = parse_page("<input type=a><form><input type=b><select type=c></select></form><input type=d><form></form>", ("forms", "signals"))
    assert [[i["type"] for i in f["inputs"]] for f in page["forms"]] == [["b", "c"], []]
    assert page["signals"]["form_inputs"] == ["b", "c"]


def test_medians_by_counting(spark):
    import statistics

    from sitetable.operators.chunks import medians
    rows = [("a", v) for v in (-70000, -3, 5, 5, 1 << 30)] + [("b", 7), ("b", -9), (None, 1), ("c", None)] + [("d", i * 65537) for i in range(300)]
    for kind in ("int", "long"):
        df = spark.createDataFrame(rows, f"k string, v {kind}")
        expected = {k: statistics.median_low([v for q, v in rows if q == k and v is not None]) for k in ("a", "b", None, "d")}
        assert {r["k"]: r["median"] for r in medians(df, "k", "v").collect()} == expected
    with pytest.raises(ValueError):
        medians(df.select("k", F.lit(1.5).alias("v")), "k", "v")


def _no_broadcast(df):
    """Rows of a frame, none of which went to the driver for a join."""
    rows = df.collect()
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    return rows


def test_nodes_of_pages_are_not_broadcast(spark):
    pages = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("<p>x</p><p>y</p>").alias("html"))
    asked = spark.range(4).select(F.col("id").cast("string").alias("page_id"), F.lit("p").alias("selector"))
    rows = _no_broadcast(found_by_selector(pages, asked))
    assert sorted((r["page_id"], r["n_found"]) for r in rows) == [("0", 2), ("1", 2), ("2", 2)]


def test_found_selectors_of_steps_are_not_broadcast(spark):
    pages = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("<p>x</p>").alias("html"))
    steps = pages.select("id", F.col("id").alias("page_id"), F.lit("b").alias("selector"), F.array(F.lit("p")).alias("fallback_selectors"))
    assert sorted(map(tuple, _no_broadcast(replay_on_pages(steps, pages)))) == [(str(i), str(i), True, 1, "p") for i in range(3)]
