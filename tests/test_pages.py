from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitetable.functions.html import ELEMENT_TAGS, parse_page
from sitetable.functions.page_types import SIGNALS
from sitetable.operators import pages as P

LOGIN = """<html><head><title>Member Login</title></head><body>
<form action="/do-login" method="POST"><input type="text" name="account" id="acc">
<input type="password" name="pw" required><input type="submit" value="Go"></form></body></html>"""
LISTING = """<html><head><title>Stock</title></head><body><table><tr><th>Part<th>Count
<tr><td>bolt<td>7<tr><td>nut<td>9</table><div class="pagination"><a href="?page=2">Next</a></div></body></html>"""
FORM = """<html><head><title>Sign up</title></head><body><form method="post">""" + \
    "".join(f'<input type="text" name="f{i}">' for i in range(4)) + '<input type="submit"></form></body></html>'
PLAIN = "<html><body><p>Nothing here</p></body></html>"


def classified(pages_of, *htmls, **options):
    rows = P.classify_pages(pages_of(*htmls), **options).orderBy("id").collect()
    return rows


def test_page_types(pages_of):
    rows = classified(pages_of, LOGIN, LISTING, FORM, PLAIN)
    assert [r["page_type"] for r in rows] == ["login", "list", "form", "unknown"]
    assert rows[3]["confidence"] == 0.0
    assert all(0.0 <= r["confidence"] <= 1.0 for r in rows)
    assert set(rows[0]["signals"].asDict()) == set(SIGNALS)
    assert rows[0]["signals"]["has_password_field"] and rows[0]["signals"]["has_login_keyword"]
    assert rows[1]["signals"]["has_table"] and rows[1]["signals"]["has_pagination"]
    assert rows[2]["signals"]["has_many_inputs"] and rows[2]["signals"]["has_submit_button"]


def test_tie_goes_to_the_type_scored_first(pages_of):
    # dashboard (charts 0.7) and search (0.7) tie
    (row,) = classified(pages_of, "<body>search <canvas></canvas></body>")
    assert row["page_type"] == "search" and abs(row["confidence"] - 0.5) < 1e-12


def test_link_tags_count_as_items_unless_strict(pages_of):
    html = "<head>" + "<link rel='x'>" * 6 + "</head><body>x</body>"
    assert classified(pages_of, html)[0]["signals"]["has_list_items"]
    assert not classified(pages_of, html, strict=True)[0]["signals"]["has_list_items"]
    link = '<a href="/x">x</a>'
    assert classified(pages_of, link)[0]["signals"]["has_download_link"]
    assert not classified(pages_of, link, strict=True)[0]["signals"]["has_download_link"]


def test_own_scores_replace_rules(pages_of):
    scored = P.classify_pages(pages_of(LOGIN).withColumn("model_score", F.lit(9.0)),
                              score_cols={"dashboard": "model_score"})
    assert scored.first()["page_type"] == "dashboard"


def test_password_outside_a_form_is_no_login(pages_of):
    (row,) = classified(pages_of, '<input type="password">')
    assert not row["signals"]["has_password_field"]


def test_null_html_stays_in_the_result(pages_of):
    pages = pages_of(LOGIN, PLAIN).withColumn("html", F.when(F.col("id") == "0", F.col("html")))
    rows = P.classify_pages(pages).orderBy("id").collect()
    assert [r["page_type"] for r in rows] == ["login", "unknown"]
    assert P.elements_table(pages).select("page_id").distinct().count() == 1


def test_text_title_and_entities():
    page = parse_page("<title> A &amp; B </title><body>Sign <b>In</b><!-- c -->now"
                      "<script>var x = '</p>';</script><style>p{}</style></body>", ("title", "text"))
    assert page == {"title": "A & B", "text": "A & B Sign In now"}


def test_element_text_joins_without_separator_and_is_cut():
    (link,) = parse_page("<a href=x>Sign <b>In</b> <i>" + "y" * 400 + "</i></a>", ("elements",))["elements"]
    assert link["text"] == ("SignIn" + "y" * 400)[:300]


def test_selectors():
    html = ('<body><div id="top"><p>a<p><a href="1">x</a></div><ul><li><a href="2">y</a><li><a href="3">z</a></ul>'
            '<a id="me" href="4">w</a></body>')
    found = [e["selector"] for e in parse_page(html, ("elements",), ("a",))["elements"]]
    assert found == ["#top > p:nth-of-type(2) > a", "ul > li:nth-of-type(1) > a", "ul > li:nth-of-type(2) > a", "#me"]


def test_tree_repairs():
    def selectors(html, *tags):
        return [e["selector"] for e in parse_page(html, ("elements",), tags)["elements"]]
    assert selectors("hello <a href=x>t</a>", "a") == ["p > a"]  # bare text opens a paragraph
    assert selectors("<table><tr><td>1<td>2<tr><td>3</table>", "td") == [
        "table > tr:nth-of-type(1) > td:nth-of-type(1)", "table > tr:nth-of-type(1) > td:nth-of-type(2)",
        "table > tr:nth-of-type(2) > td"]
    assert selectors("<div><b>x</div></b><button>b</button>", "button") == ["button"]
    assert selectors("<td><span></table></td><a href=x>", "a") == ["a"]  # no cell end crosses nothing
    assert selectors("<p>a</div><p>b<select><option>1<option>2</select>", "select") == ["p:nth-of-type(2) > select"]
    assert selectors("<body>x</p><p><a href=1>l</a>", "a") == ["p:nth-of-type(2) > a"]  # a stray end makes an empty p


TOKENS = ["<", ">", "</", "/>", "<!--", "-->", "<![", "]]>", "<!", "<?", "&", "&#", ";", '"', "'", "=", " ", "x", "\x00", "é",
          "<p>", "</p>", "<td>", "<tr>", "<table>", "</table>", "<a href=x>", "</a>", "<div id=d>", "</div>", "<script>",
          "</script>", "<body>", "</body>", "</html>", "<html>", "<head>", "<title>", "<form>", "<input type=text>", "<li>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TOKENS), max_size=40))
def test_no_source_breaks_the_parser(tokens):
    page = parse_page("".join(tokens))
    positions = [e["doc_pos"] for e in page["elements"]]
    assert positions == sorted(set(positions))
    assert all(e["selector"] for e in page["elements"])
    assert len(page["links"]) == sum(e["tag"] == "a" and "href" in dict(e["attributes"]) for e in page["elements"])


def test_marked_sections_are_skipped():
    assert parse_page("<body>a<![if IE]>b<![endif]>c<![odd x]>d", ("text",)) == {"text": "a b c d"}


def test_broken_pages_take_linear_time():
    import time
    start = time.time()
    for piece in ("<!--", "<a ", "<a b='", '<a b="', "<p a", "<![", "<?", "</", "<", "&", "<b></i>", "<script>", "<b><div><i></b>"):
        parse_page(piece * 5000 + ">", ("title", "text", "links", "forms", "tables"))
        parse_page(piece * 5000, ("title", "text", "links", "forms", "tables"))
    # paths in the output are as long as the nesting is deep: bounded on request
    assert parse_page("<td><table>" * 5000, max_depth=512)["tables"]
    assert time.time() - start < 20


def test_deep_pages_keep_all_elements():
    source = "<div>" * 2000 + "<a href=x>y</a>"
    page = parse_page(source, ("elements", "links", "cut"))
    assert page["links"] == [{"href": "x", "text": "y"}] and not page["cut"]
    assert page["elements"][0]["selector"] == " > ".join(["div"] * 2000 + ["a"])
    bounded = parse_page(source, ("elements", "links", "cut"), max_depth=512)
    assert bounded["links"] == page["links"] and bounded["cut"]
    assert bounded["elements"][0]["selector"].count(">") < 512


def test_end_tags_stop_at_higher_ranks():
    page = parse_page("<b>one<div>two</b>three</div>four</b>five", ("text", "links"))
    assert page["text"] == "one twothree four five"
    page = parse_page("<table><tr><td><b>x</table></b><a href=u>y</a>", ("elements",), ("a",))
    assert page["elements"][0]["selector"] == "a"


def test_text_limit_is_an_argument():
    source = "<a href=x>" + "y" * 1000 + "</a>"
    for limit, size in ((300, 300), (10, 10), (None, 1000)):
        assert len(parse_page(source, ("elements",), text_limit=limit)["elements"][0]["text"]) == size


def test_quotes_only_delimit_values():
    page = parse_page("""<p title=it's>one</p><a href='x"y'>two</a><a href="p>q" id=b/>three<br/>four</x>five""",
                      ("text", "links", "elements"))
    assert page["text"] == "one two three fourfive"
    assert [x["href"] for x in page["links"]] == ['x"y', "p>q"]
    assert page["elements"][1]["selector"] == "#b/"  # an unquoted value takes the slash


def test_entities_in_values_and_raw_text():
    page = parse_page("<script>if (a < b) { x('<p>') }</SCRIPT ><style>p > a {}</style><a href='?a=1&amp;b=2'>&lt;x&gt;</a>",
                      ("text", "links"))
    assert page == {"text": "<x>", "links": [{"href": "?a=1&b=2", "text": "<x>"}]}


def test_cut_off_source():
    page = parse_page('<p>one <a href="/x">two</a> three <a href="/y', ("text", "links"))
    assert page["text"] == "one two three" and len(page["links"]) == 1


def test_attributes_first_value_wins_and_lists_are_flat():
    (e,) = parse_page('<input CLASS="a  b" type=text type=email disabled>', ("elements",))["elements"]
    assert dict(e["attributes"]) == {"class": "a b", "type": "text", "disabled": ""}


def test_forms():
    (form,) = parse_page(LOGIN, ("forms",))["forms"]
    assert (form["action"], form["method"]) == ("/do-login", "POST")
    assert [(i["type"], i["required"]) for i in form["inputs"]] == [
        ("text", False), ("password", True), ("submit", False)]
    assert parse_page("<form></form>", ("forms",))["forms"] == [{"action": None, "method": "get", "inputs": []}]


def test_nested_tables_keep_their_rows():
    html = "<table><tr><th>A<th>B<tr><td>1<td>2<table><tr><td>in</table></table>"
    outer, inner = parse_page(html, ("tables",))["tables"]
    assert outer == {"header": ["A", "B"], "rows": [["1", "2in"]]}
    assert inner == {"header": [], "rows": [["in"]]}


def test_table_rows(pages_of):
    rows = P.table_rows(pages_of(LISTING, "<table><tr><th>A<th>A<tr><td>1<td>2<td>3</table>")).collect()
    by_page = {(r["page_id"], r["row_pos"]): r["fields"] for r in rows}
    assert by_page[("0", 0)] == {"Part": "bolt", "Count": "7"}
    assert by_page[("1", 0)] == {"A": "1", "A_2": "2", "c2": "3"}


def test_roles_and_confidence(pages_of):
    html = ('<input><input type=NUMBER class="btn-next"><input type=Email id=e name=e role=x aria-label=z>'
            '<a class=pagination href=x>n</a><label role=link>r</label><form class="PREV">f</form><table></table>')
    rows = P.elements_table(pages_of(html)).orderBy("doc_pos").collect()
    assert [(r["tag"], r["role"]) for r in rows] == [
        ("input", "unknown"), ("input", "pagination"), ("input", "field"), ("a", "navigation"),
        ("label", "navigation"), ("form", "pagination"), ("table", "data")]
    assert rows[0]["confidence"] == 0.5
    assert rows[2]["confidence"] == 1.0 and rows[2]["aria_label"] == "z"
    assert [r["is_interactive"] for r in rows] == [True] * 6 + [False]
    assert len({r["id"] for r in rows}) == len(rows)


def test_link_and_tag_filters(pages_of):
    elements = P.elements_table(pages_of('<a>no href</a><a href="">empty</a><td>x</td>'))
    assert [r["label"] for r in P.link_elements(elements).collect()] == ["empty"]
    assert P.with_tags(elements, ["td"]).count() == 1
    assert P.interactive(elements).count() == 2
    assert set(ELEMENT_TAGS) >= {r["tag"] for r in elements.collect()}


def test_latest_pages_with_ties_and_nulls(spark):
    rows = [("a", "u", 1, "2024-01-01"), ("b", "u", 2, "2024-01-01"), ("c", "u", 2, "2024-01-02"),
            ("d", "u", 2, "2024-01-02"), ("e", "v", None, None)]
    pages = spark.createDataFrame(rows, "id string, url string, version int, collected_at string") \
                 .withColumn("collected_at", F.to_timestamp("collected_at"))
    assert sorted(r["id"] for r in P.latest_pages(pages).collect()) == ["c", "e"]
    assert [r["id"] for r in P.latest_pages(pages, "u").collect()] == ["c"]
    assert P.latest_pages(pages, "missing").count() == 0


def test_similar_pages_limit(spark):
    pages = spark.createDataFrame([(str(i), "list" if i % 2 else "form") for i in range(40)], "id string, page_type string")
    assert P.pages_of_type(pages, "list").count() == 10
    assert P.pages_of_type(pages, "list", None).count() == 20


def test_one_python_stage_only(pages_of):
    plan = P.classify_pages(pages_of(LOGIN)).groupBy("page_type").count()._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in physical
    elements = P.elements_table(pages_of(LOGIN)).filter("role = 'field'")._jdf.queryExecution().toString()
    assert elements.split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1
