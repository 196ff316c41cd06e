"""Queries over pages: parsing, roles, classification, versions, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetable.functions import text as T
from sitetable.functions.html import ELEMENT_TAGS, INTERACTIVE_TAGS
from sitetable.functions.page_types import SIGNALS
from sitetable.operators import pages as P
from sitetable.operators.selectors import found_by_selector, replay_on_pages
from sitetable.operators.steps import replay
from sitetable.plans import actions as A
from sitetable.session import scratch_dir
from sitetable.sources.pagestore import PageStore
from sitetable.sources.snapshots import boxed_elements, boxed_in_row, boxes, requests, to_pages
from workload.inputs import (ACCOUNT_SQL, PAGE_SNAPSHOTS_SQL, SITE_PAGES_SQL, account_pages, page_snapshots,
                             site_pages, table, text, with_sql)
from workload.registry import query

# text of a piece of html: entities decoded, outer space dropped
_DECODE = "regexp_replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"


def _decoded(sql: str) -> str:
    return f"trim({_DECODE.format(sql)}, ' \t\n\r')"


_TITLE = _decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")


@query("S1 E11", with_sql(SITE_PAGES_SQL, select="""
SELECT id, site_id, url, sha256(html) AS content_hash, 1 AS version, 'unknown' AS page_type,
       strftime(collected_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS collected_at FROM site_pages"""))
def page_ingest(spark, sf):
    pages = to_pages(site_pages(spark, sf))
    return pages.select("id", "site_id", "url", "content_hash", "version", "page_type",
                        T.iso_utc("collected_at").alias("collected_at"))


@query("S1 F1", with_sql(SITE_PAGES_SQL, select=r"""
SELECT id, sha256(html) AS content_hash,
       md5(regexp_replace(html, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b', '[REDACTED]', 'g')) AS email_free
FROM site_pages"""))
def page_ingest_email_free(spark, sf):
    from sitetable.functions.pii import redact
    pages = to_pages(site_pages(spark, sf).withColumn("content_hash", T.content_hash("html"))
                     .withColumn("html", redact("html", ["email"])))
    return pages.select("id", "content_hash", F.md5("html").alias("email_free"))


@query("E11 E12", "SELECT page_id, sha256(html) AS content_hash, md5(html) AS dom_hash FROM pages")
def page_hashes(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.content_hash("html").alias("content_hash"),
                                            T.dom_hash("html").alias("dom_hash"))


@query("E2", f"SELECT CAST(page_id AS VARCHAR) AS id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf):
    return P.titles(site_pages(spark, sf))


@query("E3", f"""
SELECT id, array_to_string(list_filter(list_transform(parts, lambda p: {_decoded('p')}), lambda p: p <> ''), ' ') AS text
FROM (SELECT CAST(page_id AS VARCHAR) AS id, string_split_regex(regexp_replace(regexp_replace(
        html, '<(script|style)>.*?</(script|style)>', '<x>', 'gs'), '<[A-Za-z/!][^>]*$', ''), '<[^>]*>') AS parts FROM pages)""")
def page_visible_text(spark, sf):
    return P.page_texts(site_pages(spark, sf))


_LINKS = f"""links AS (
  SELECT id, link_pos, regexp_extract(link, 'href="([^"]*)"', 1) AS href,
         {_decoded("regexp_extract(link, '>([^<]*)', 1)")} AS text
  FROM (SELECT CAST(page_id AS VARCHAR) AS id, unnest(found) AS link, unnest(range(len(found))) AS link_pos
        FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*') AS found FROM pages)))"""


@query("E4 F9", with_sql(_LINKS, select=f"SELECT id AS page_id, CAST(link_pos AS INTEGER) AS link_pos, {_DECODE.format('href')} AS href, text FROM links"))
def page_links(spark, sf):
    return P.links(site_pages(spark, sf))


@query("E1 P9 P10 P11 E6 E7 E8", with_sql(_LINKS, select=f"""
SELECT id AS page_id, 'a' AS tag, text AS label, {_DECODE.format('href')} AS href, 'navigation' AS role,
       0.6::DOUBLE AS confidence, TRUE AS is_interactive FROM links"""))
def page_elements(spark, sf):
    elements = P.link_elements(P.with_tags(P.elements_table(site_pages(spark, sf))))
    return elements.select("page_id", "tag", "label", F.col("attributes")["href"].alias("href"), "role",
                           F.round("confidence", 6).alias("confidence"), "is_interactive")


# elements of the account pages: (tag, label, selector, role, id, name, role attribute, aria label)
_ACCOUNT_ELEMENTS = ACCOUNT_SQL + """,
cells AS (
  SELECT id, unnest([
    {tag: 'form', label: CASE WHEN b3 THEN 'Sign in' ELSE 'Go' END, selector: 'form', role: 'unknown', extra: 0.0, shown: TRUE},
    {tag: 'input', label: '', selector: text_selector, role: 'field',
     extra: 0.1 + (CASE WHEN b0 THEN 0.1 ELSE 0 END) + (CASE WHEN b1 THEN 0.1 ELSE 0 END) + (CASE WHEN b2 THEN 0.15 ELSE 0 END)
            + (CASE WHEN b3 THEN 0.15 ELSE 0 END), shown: TRUE},
    {tag: 'input', label: '', selector: 'form > input:nth-of-type(2)', role: 'field', extra: 0.2, shown: b1},
    {tag: 'input', label: '', selector: search_selector, role: 'field', extra: 0.2, shown: b2},
    {tag: 'button', label: CASE WHEN b3 THEN 'Sign in' ELSE 'Go' END, selector: 'form > button', role: 'action', extra: 0.1, shown: TRUE},
    {tag: 'a', label: 'Next page', selector: 'a:nth-of-type(1)', role: 'navigation', extra: 0.1, shown: b0},
    {tag: 'a', label: 'Export', selector: export_selector, role: 'navigation', extra: 0.1, shown: TRUE},
    {tag: 'table', label: 'keynamesegment' || id || c_name || c_mktsegment || 'nation' || c_nationkey, selector: 'table', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'tr', label: 'keynamesegment', selector: 'table > tr:nth-of-type(1)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'th', label: 'key', selector: 'table > tr:nth-of-type(1) > th:nth-of-type(1)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'th', label: 'name', selector: 'table > tr:nth-of-type(1) > th:nth-of-type(2)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'th', label: 'segment', selector: 'table > tr:nth-of-type(1) > th:nth-of-type(3)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'tr', label: id || c_name || c_mktsegment, selector: 'table > tr:nth-of-type(2)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'td', label: id, selector: 'table > tr:nth-of-type(2) > td:nth-of-type(1)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'td', label: c_name, selector: 'table > tr:nth-of-type(2) > td:nth-of-type(2)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'td', label: c_mktsegment, selector: 'table > tr:nth-of-type(2) > td:nth-of-type(3)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'tr', label: 'nation' || c_nationkey, selector: 'table > tr:nth-of-type(3)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'td', label: 'nation', selector: 'table > tr:nth-of-type(3) > td:nth-of-type(1)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'td', label: CAST(c_nationkey AS VARCHAR), selector: 'table > tr:nth-of-type(3) > td:nth-of-type(2)', role: 'data', extra: 0.1, shown: TRUE},
    {tag: 'td', label: '', selector: 'table > tr:nth-of-type(3) > td:nth-of-type(3)', role: 'data', extra: 0.1, shown: TRUE}
  ]) AS e FROM account),
elements AS (
  SELECT id AS page_id, e.tag AS tag, e.label AS label, e.selector AS selector, e.role AS role,
         round(least(0.5::DOUBLE + e.extra::DOUBLE, 1.0), 6) AS confidence,
         e.tag IN ('a', 'button', 'input', 'form') AS is_interactive
  FROM cells WHERE e.shown)"""


@query("E1 E6 E7 E8 W5 P10 P11", with_sql(_ACCOUNT_ELEMENTS, select="SELECT * FROM elements"))
def account_elements(spark, sf):
    return P.elements_table(account_pages(spark, sf), tags=ELEMENT_TAGS).select(
        "page_id", "tag", "label", "selector", "role", F.round("confidence", 6).alias("confidence"), "is_interactive")


@query("P11 E7", with_sql(_ACCOUNT_ELEMENTS, select="""
SELECT role, tag, count(*) AS n_elements, round(avg(confidence), 6) AS avg_confidence
FROM elements WHERE is_interactive GROUP BY ALL"""))
def interactive_roles(spark, sf):
    return (P.interactive(P.elements_table(account_pages(spark, sf))).groupBy("role", "tag")
            .agg(F.count("*").alias("n_elements"), F.round(F.avg("confidence"), 6).alias("avg_confidence")))


@query("E5", with_sql(ACCOUNT_SQL, select="""
SELECT id AS page_id, 0 AS form_pos, '/save/' || id AS action, 'POST' AS method, i.input_pos AS input_pos, 'input' AS tag,
       i.name AS name, i.type AS type, i.placeholder AS placeholder, i.required AS required
FROM (SELECT id, unnest([
        {input_pos: 0, name: CASE WHEN b1 THEN 'user' END, type: 'text', placeholder: NULL, required: FALSE, shown: TRUE},
        {input_pos: 1, name: 'pw', type: 'password', placeholder: NULL, required: TRUE, shown: b1},
        {input_pos: CASE WHEN b1 THEN 2 ELSE 1 END, name: 'q', type: 'search', placeholder: 'Find', required: FALSE, shown: b2}
      ]) AS i FROM account) WHERE i.shown"""))
def account_form_inputs(spark, sf):
    return P.form_inputs(account_pages(spark, sf))


@query("E13", with_sql(ACCOUNT_SQL, select="""
SELECT id AS page_id, 0 AS row_pos, id AS key, c_name AS name, c_mktsegment AS segment FROM account
UNION ALL SELECT id, 1, 'nation', CAST(c_nationkey AS VARCHAR), '' FROM account"""))
def account_table_rows(spark, sf):
    rows = P.table_rows(account_pages(spark, sf))
    return rows.select("page_id", "row_pos", *[F.col("fields")[c].alias(c) for c in ("key", "name", "segment")])


_SIGNALS = f"""named AS (SELECT *, lower(html) AS h, lower({_TITLE} || ' ' || url) AS t FROM site_pages),
signals AS (
  SELECT id, site_id, FALSE AS has_password_field,
    contains(t, 'login') OR contains(t, 'sign in') OR contains(t, 'signin') OR contains(t, 'log in') AS has_login_keyword,
    contains(h, 'search') AS has_search_field, contains(h, '<table') AS has_table,
    (length(h) - length(replace(h, '<li', ''))) // 3 > 5 AS has_list_items,
    contains(h, 'pagination') OR contains(h, 'page-next') OR contains(h, 'pager') OR contains(h, '?page=')
      OR contains(h, '&page=') AS has_pagination,
    FALSE AS has_many_inputs, FALSE AS has_submit_button,
    contains(h, 'chart') OR contains(h, 'echarts') OR contains(h, 'highcharts') OR contains(h, 'd3.js')
      OR contains(h, 'canvas') AS has_charts,
    contains(t, 'dashboard') OR contains(t, 'overview') OR contains(t, 'summary') AS has_dashboard_keyword,
    contains(h, 'href="') OR contains(h, 'download') OR contains(h, '.csv') OR contains(h, '.xlsx')
      OR contains(h, '.zip') AS has_download_link,
    contains(t, 'detail') OR contains(t, 'profile') OR contains(t, 'view') OR contains(t, 'show')
      OR contains(t, 'record') AS has_detail_keyword
  FROM named)"""
_TYPES = """scores AS (
  SELECT id, site_id, w(has_password_field, 0.9) + w(has_login_keyword, 0.6) AS login, w(has_search_field, 0.7) AS search,
         w(has_table, 0.6) + w(has_list_items, 0.4) + w(has_pagination, 0.5) AS list,
         w(has_many_inputs, 0.6) + w(has_submit_button, 0.3) AS form,
         w(has_charts, 0.7) + w(has_dashboard_keyword, 0.5) AS dashboard,
         w(has_download_link, 0.8) AS download, w(has_detail_keyword, 0.4) AS detail
  FROM signals),
best AS (SELECT *, greatest(login, search, list, form, dashboard, download, detail) AS top,
                login + search + list + form + dashboard + download + detail AS total FROM scores),
typed AS (
  SELECT id, site_id, CASE WHEN total = 0 THEN 'unknown' WHEN login = top THEN 'login' WHEN search = top THEN 'search'
              WHEN list = top THEN 'list' WHEN form = top THEN 'form' WHEN dashboard = top THEN 'dashboard'
              WHEN download = top THEN 'download' ELSE 'detail' END AS page_type,
         CASE WHEN total = 0 THEN 0.0 ELSE top / total END AS share, round(share, 6) AS confidence
  FROM best)"""


def _weights(sql: str) -> str:
    """Spell the w(flag, weight) shorthand out."""
    import re
    return re.sub(r"w\((\w+), ([\d.]+)\)", r"(CASE WHEN \1 THEN \2::DOUBLE ELSE 0.0::DOUBLE END)", sql)


_TYPES = _weights(_TYPES)


@query("E9 F7 F8", with_sql(SITE_PAGES_SQL, _SIGNALS, select=f"SELECT id, {', '.join(SIGNALS)} FROM signals"))
def page_signals(spark, sf):
    return P.classify_pages(site_pages(spark, sf)).select("id", "signals.*")


@query("E10 A7", with_sql(SITE_PAGES_SQL, _SIGNALS, _TYPES, select="SELECT id, page_type, confidence FROM typed"))
def page_types(spark, sf):
    return P.classify_pages(site_pages(spark, sf)).select(
        "id", "page_type", F.round("confidence", 6).alias("confidence"))


_ACCOUNT_SIGNALS = ACCOUNT_SQL + """,
signals AS (
  SELECT id, CAST(c_nationkey AS VARCHAR) AS site_id, b1 AS has_password_field, FALSE AS has_login_keyword,
         b2 AS has_search_field, TRUE AS has_table, FALSE AS has_list_items, b0 AS has_pagination,
         FALSE AS has_many_inputs, TRUE AS has_submit_button, FALSE AS has_charts, FALSE AS has_dashboard_keyword,
         TRUE AS has_download_link, FALSE AS has_detail_keyword
  FROM account)"""


@query("E2 E9 E10", with_sql(
    SITE_PAGES_SQL, _SIGNALS.replace("signals AS (", "site_signals AS ("), _ACCOUNT_SIGNALS.replace("signals AS (", "account_signals AS ("),
    "signals AS (SELECT * FROM site_signals UNION ALL BY NAME SELECT * FROM account_signals)", _TYPES, select="""
SELECT page_type, count(*) AS n_pages, count(DISTINCT site_id) AS n_sites, round(avg(share), 6) AS avg_confidence
FROM typed GROUP BY 1"""))
def page_type_summary(spark, sf):
    """All pages, collected and of accounts, by their type."""
    columns = ("id", "site_id", "url", "html")
    pages = site_pages(spark, sf).select(*columns).unionByName(account_pages(spark, sf).select(*columns))
    return (P.classify_pages(pages).groupBy("page_type")
            .agg(F.count("*").alias("n_pages"), F.countDistinct("site_id").alias("n_sites"),
                 F.round(F.avg("confidence"), 6).alias("avg_confidence")))


@query("E9 E10 A7", with_sql(_ACCOUNT_SIGNALS, _TYPES, select=f"""
SELECT typed.id AS id, page_type, confidence, {', '.join(SIGNALS)} FROM typed JOIN signals ON typed.id = signals.id"""))
def account_page_types(spark, sf):
    return P.classify_pages(account_pages(spark, sf)).select(
        "id", "page_type", F.round("confidence", 6).alias("confidence"), "signals.*")


@query("P4 K2", with_sql(_ACCOUNT_SIGNALS, _TYPES, select="""
SELECT id, page_type FROM typed WHERE page_type = 'list' ORDER BY id LIMIT 10"""))
def similar_pages(spark, sf):
    return P.pages_of_type(P.classify_pages(account_pages(spark, sf)), "list").select("id", "page_type")


@query("W1", with_sql(PAGE_SNAPSHOTS_SQL, select="""
SELECT id, url, version, sha256(html) AS content_hash FROM page_snapshots
QUALIFY row_number() OVER (PARTITION BY url ORDER BY version DESC, collected_at DESC, id) = 1"""))
def latest_pages(spark, sf):
    return P.latest_pages(page_snapshots(spark, sf)).select(
        "id", "url", "version", T.content_hash("html").alias("content_hash"))


@query("W1 S4", with_sql(PAGE_SNAPSHOTS_SQL, select="""
SELECT id, url, version, sha256(html) AS content_hash, md5(html) AS html_md5 FROM page_snapshots
QUALIFY row_number() OVER (PARTITION BY url ORDER BY version DESC, collected_at DESC, id) = 1"""))
def latest_stored_pages(spark, sf):
    """Snapshots stored in two batches, every html once in buckets; the latest of each URL, html included."""
    store, pages = PageStore(spark, scratch_dir(spark, "page-store")), page_snapshots(spark, sf)
    store.add(pages.filter("version < 3"))
    store.add(pages.filter("version > 1"))  # the second version comes twice
    return store.latest().select("id", "url", "version", "content_hash", F.md5("html").alias("html_md5"))


@query("W3 E11", with_sql(PAGE_SNAPSHOTS_SQL, select="""
SELECT id, url, content_hash, previous_hash, coalesce(previous_hash <> content_hash, FALSE) AS changed,
       CAST(1 + sum(CASE WHEN previous_hash <> content_hash THEN 1 ELSE 0 END)
            OVER (PARTITION BY url ORDER BY collected_at, id) AS INTEGER) AS version
FROM (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY collected_at, id) AS previous_hash
      FROM (SELECT id, url, collected_at, sha256(html) AS content_hash FROM page_snapshots))"""))
def page_versions(spark, sf):
    return P.page_versions(page_snapshots(spark, sf)).drop("collected_at")


@query("F4", """
SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(
  url, 'https?://', '', 'g'), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'), 1, 64), ''), 'site_table') AS table_name
FROM pages""")
def url_table_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.table_name("url").alias("table_name"))


@query("F10 F9 F8", """
SELECT doc_id, array_to_string(regexp_extract_all(lang || ' ' || source, '\\S+'), ' ') AS flat, substr(text, 1, 300) AS head,
       (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS n_the FROM documents""")
def text_shapes(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.flat_list(F.split(F.concat_ws(" ", "lang", "source"), " ")).alias("flat"),
                       T.clip("text", 300).alias("head"), T.count_of(F.lower("text"), "the").alias("n_the"))


@query("F10", """SELECT c_custkey, lower(c_mktsegment) || ' n-' || c_nationkey AS classes, '  as  it  is ' AS title FROM customer""")
def flat_attribute_lists(spark, sf):
    """An attribute that is a list of names is one text, one blank between names; other attributes stay as they are."""
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("id"), F.concat(
        F.lit('<a href="/x" title="  as  it  is " class="  '), F.lower("c_mktsegment"), F.lit("\t \n n-"), text("c_nationkey"),
        F.lit(' ">x</a>')).alias("html"))
    found = P.elements_table(rows).select(F.col("page_id").cast("long").alias("c_custkey"), F.col("attributes")["class"].alias("classes"),
                                          F.col("attributes")["title"].alias("title"))
    return found


# -- request logs and boxes --------------------------------------------------

def _with_har(spark, sf):
    """Pages with a request log: the page itself and a style sheet, whose response may be missing."""
    def entry(url, method=None, kind=None, status=None):
        return F.struct(url.alias("url"), F.lit(method).cast("string").alias("method"),
                        F.lit(kind).cast("string").alias("resource_type"),
                        (status if status is not None else F.lit(None)).cast("int").alias("status"))
    css = F.concat(F.col("site_id"), F.lit("/style.css"))
    ok = F.when(F.col("id").cast("long") % 5 == 0, 404).otherwise(200)
    log = F.array(entry(F.col("url"), "GET", "document"), entry(css, "GET", "stylesheet"),
                  entry(F.col("url"), status=ok))
    return site_pages(spark, sf).withColumn("har", F.struct(log.alias("requests")))


@query("S13", with_sql(SITE_PAGES_SQL, select="""
SELECT id AS page_id, url, 'GET' AS method, 'document' AS resource_type,
       CAST(CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status,
       CAST(1 AS BIGINT) AS n_requests, CAST(1 AS BIGINT) AS n_responses FROM site_pages
UNION ALL SELECT id, site_id || '/style.css', 'GET', 'stylesheet', NULL, 1, 0 FROM site_pages"""))
def page_requests(spark, sf):
    return requests(_with_har(spark, sf))


def _with_boxes(spark, sf):
    """Account pages with boxes of their inputs and button, placed by key."""
    k = F.col("id").cast("double")

    def box(tag, ident, name, x):
        return F.struct(F.lit(tag).alias("tag"), ident.cast("string").alias("id"), F.lit(name).cast("string").alias("name"),
                        F.lit("").alias("text"), F.lit(None).cast("string").alias("role"),
                        F.lit(None).cast("string").alias("aria_label"), (k + x).alias("x"), k.alias("y"),
                        F.lit(10.0).alias("width"), F.lit(5.0).alias("height"))
    none = F.lit(None)
    return account_pages(spark, sf).withColumn("bounding_boxes", F.array(
        box("input", F.concat(F.lit("f"), F.col("id")), "user", 1.0), box("input", none, "pw", 2.0),
        box("input", none, "user", 3.0), box("button", none, None, 4.0)))


@query("S14", with_sql(ACCOUNT_SQL, select="""
SELECT id AS page_id, b.n AS box_pos, b.tag AS tag, b.name AS name, b.x + c_custkey AS x, CAST(c_custkey AS DOUBLE) AS y
FROM (SELECT id, c_custkey, unnest([
  {n: 0, tag: 'input', name: 'user', x: 1.0::DOUBLE}, {n: 1, tag: 'input', name: 'pw', x: 2.0::DOUBLE},
  {n: 2, tag: 'input', name: 'user', x: 3.0::DOUBLE}, {n: 3, tag: 'button', name: NULL, x: 4.0::DOUBLE}]) AS b FROM account)"""))
def page_boxes(spark, sf):
    return boxes(_with_boxes(spark, sf)).select("page_id", "box_pos", "tag", "name", "x", "y")


@query("S14", with_sql(_ACCOUNT_ELEMENTS, select="""
SELECT page_id, tag, elements.selector AS selector,
       CASE WHEN tag = 'input' AND elements.selector = text_selector AND b0 THEN c_custkey + 1.0::DOUBLE
            WHEN tag = 'input' AND elements.selector = text_selector AND b1 THEN c_custkey + 3.0::DOUBLE
            WHEN tag = 'input' AND b1 AND elements.selector = 'form > input:nth-of-type(2)' THEN c_custkey + 2.0::DOUBLE END AS x
FROM elements JOIN account ON account.id = elements.page_id WHERE is_interactive"""))
def boxed_page_elements(spark, sf):
    pages = _with_boxes(spark, sf)
    elements = P.elements_table(pages, tags=INTERACTIVE_TAGS)
    return boxed_elements(elements, boxes(pages)).select("page_id", "tag", "selector",
                                                         F.col("bounding_box.x").alias("x"))


@query("S14", with_sql(_ACCOUNT_ELEMENTS, select="""
SELECT page_id, tag, elements.selector AS selector,
       CASE WHEN tag = 'input' AND elements.selector = text_selector AND b0 THEN c_custkey + 1.0::DOUBLE
            WHEN tag = 'input' AND elements.selector = text_selector AND b1 THEN c_custkey + 3.0::DOUBLE
            WHEN tag = 'input' AND b1 AND elements.selector = 'form > input:nth-of-type(2)' THEN c_custkey + 2.0::DOUBLE END AS x
FROM elements JOIN account ON account.id = elements.page_id WHERE is_interactive"""))
def boxed_elements_in_row(spark, sf):
    """The same, of pages that were parsed once: nothing is shuffled."""
    parsed = P.parse_pages(_with_boxes(spark, sf), ("elements",), INTERACTIVE_TAGS)
    return boxed_in_row(parsed, F.col("parsed.elements")).select("page_id", "tag", "selector", F.col("bounding_box.x").alias("x"))


# -- plans -------------------------------------------------------------------

_STEP = "page_id", "goal", "step_index", "action_type", "selector", "value", "description", "timeout_ms", "matched"
_LOGIN = ACCOUNT_SQL + """,
login AS (
  SELECT id AS page_id, 'login' AS goal, s.n AS n, s.action_type AS action_type, s.selector AS selector, s.value AS value,
         s.description AS description, s.timeout_ms AS timeout_ms, s.matched AS matched
  FROM (SELECT id, unnest([
    {n: 0, action_type: 'fill', selector: text_selector, value: 'user-' || id, description: 'Fill username / email',
     timeout_ms: NULL::INTEGER, matched: b1, shown: TRUE},
    {n: 1, action_type: 'fill', selector: 'form > input:nth-of-type(2)', value: 'secret/' || id, description: 'Fill password',
     timeout_ms: NULL::INTEGER, matched: TRUE, shown: b1},
    {n: 2, action_type: 'click', selector: 'form > button', value: NULL, description: 'Click login / submit',
     timeout_ms: NULL::INTEGER, matched: TRUE, shown: TRUE},
    {n: 3, action_type: 'wait', selector: NULL, value: NULL, description: 'Wait for navigation after login',
     timeout_ms: 5000, matched: NULL::BOOLEAN, shown: TRUE}]) AS s FROM account) WHERE s.shown)"""


def _login(spark, sf):
    return A.plan_login(A.page_elements(account_pages(spark, sf)), F.concat(F.lit("user-"), F.col("id")),
                        F.concat(F.lit("secret/"), F.col("id")))


@query("L1 L6 L7 W4", with_sql(_LOGIN, select="""
SELECT page_id, goal, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS step_index, action_type, selector,
       value, description, timeout_ms, matched FROM login"""))
def login_plans(spark, sf):
    return _login(spark, sf).select(*_STEP)


@query("J7 L1", with_sql(_LOGIN, select="""
SELECT page_id, description, CASE WHEN selector IS NOT NULL THEN action_type <> 'click' END AS resolved,
       CASE WHEN selector IS NOT NULL AND action_type <> 'click' THEN selector END AS resolved_selector,
       CASE WHEN selector IS NOT NULL AND action_type <> 'click' THEN 0 END AS selector_rank FROM login"""))
def replayed_plans(spark, sf):
    """Login plans replayed on later snapshots, whose buttons are gone."""
    plans = A.replayable(_login(spark, sf))
    later = P.elements_table(account_pages(spark, sf)).filter("tag <> 'button'")
    # merged: Spark takes the plans for as small as the scan that the pages are made from
    return replay(plans, later).join(plans.select("id", "description").hint("merge"), "id").drop("id")


@query("P3", with_sql(_LOGIN, select="""
SELECT page_id, action_type, '{"action_type":"' || action_type || '","selector":' || coalesce('"' || selector || '"', 'null')
  || ',"value":' || coalesce('"' || value || '"', 'null') || ',"description":"' || description || '","timeout_ms":'
  || coalesce(CAST(timeout_ms AS VARCHAR), 'null') || ',"fallback_selectors":[],"meta":{}}' AS action FROM login"""))
def planned_actions(spark, sf):
    return A.action_json(_login(spark, sf)).select("page_id", "action_type", "action")


@query("L7", with_sql(_LOGIN, select="SELECT page_id, goal, count(*) AS n_steps FROM login GROUP BY ALL"))
def plan_lengths(spark, sf):
    return A.plan_lengths(_login(spark, sf))


@query("L2", with_sql(_ACCOUNT_SIGNALS, _TYPES, select="""
SELECT id AS page_id, 'extract_data' AS goal, 0 AS step_index, 'extract' AS action_type,
       CASE WHEN page_type = 'list' THEN 'table' ELSE 'dom' END AS strategy FROM typed"""))
def extract_plans(spark, sf):
    return A.plan_extract(A.page_elements(account_pages(spark, sf))).select(
        "page_id", "goal", "step_index", "action_type", F.col("meta")["strategy"].alias("strategy"))


@query("L3 W4", with_sql(ACCOUNT_SQL, select="""
SELECT id AS page_id, 'paginate_and_extract' AS goal, CAST(n AS INTEGER) AS step_index,
       CASE n % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'click' ELSE 'wait' END AS action_type,
       CASE WHEN n % 3 = 1 THEN (CASE WHEN b0 THEN 'a:nth-of-type(1)' ELSE 'form > button' END) END AS selector,
       CASE WHEN n % 3 = 2 THEN 3000 END AS timeout_ms, CASE WHEN n % 3 = 1 THEN b0 END AS matched
FROM (SELECT *, unnest(range(13)) AS n FROM account)"""))
def pagination_plans(spark, sf):
    return A.plan_paginate(A.page_elements(account_pages(spark, sf)), max_pages=5).select(
        "page_id", "goal", "step_index", "action_type", "selector", "timeout_ms", "matched")


@query("L4 W4", with_sql(ACCOUNT_SQL, select="""
SELECT id AS page_id, 'download_file' AS goal, 0 AS step_index, 'download' AS action_type, export_selector AS selector,
       TRUE AS matched FROM account"""))
def download_plans(spark, sf):
    return A.plan_download(A.page_elements(account_pages(spark, sf))).select(
        "page_id", "goal", "step_index", "action_type", "selector", "matched")


@query("L5 W4", with_sql(ACCOUNT_SQL, select="""
SELECT id AS page_id, 'search:' || c_mktsegment AS goal, CAST(n AS INTEGER) AS step_index,
       ['fill', 'submit', 'wait'][n + 1] AS action_type,
       CASE WHEN n < 2 THEN (CASE WHEN b2 THEN search_selector ELSE text_selector END) END AS selector,
       CASE WHEN n = 0 THEN c_mktsegment END AS value, CASE WHEN n = 2 THEN 4000 END AS timeout_ms
FROM (SELECT *, unnest(range(3)) AS n FROM account)"""))
def search_plans(spark, sf):
    segments = table(spark, sf, "customer").select(text("c_custkey").alias("id"), F.col("c_mktsegment").alias("query"))
    pages = A.page_elements(account_pages(spark, sf).join(segments, "id"))
    return A.plan_search(pages, F.col("query")).select(
        "page_id", "goal", "step_index", "action_type", "selector", "value", "timeout_ms")


@query("J7", with_sql(ACCOUNT_SQL, select="""
SELECT id, id AS page_id, TRUE AS resolved, CAST(CASE WHEN b0 THEN 0 WHEN b1 THEN 2 ELSE 3 END AS INTEGER) AS selector_rank,
       CASE WHEN b0 THEN '#f' || id WHEN b1 THEN 'form > input:nth-of-type(2)' ELSE 'form > button' END AS resolved_selector
FROM account"""))
def replayed_selectors(spark, sf):
    pages = account_pages(spark, sf)
    tried = pages.select("id", F.col("id").alias("page_id"), F.concat(F.lit("#f"), F.col("id")).alias("selector"),
                         F.array(F.lit("#gone"), F.when(F.floor(F.col("id").cast("long") / F.lit(2)) % 2 == 1,
                                                        "form > input:nth-of-type(2)").otherwise("#lost"),
                                 F.lit("form > button")).alias("fallback_selectors"))
    return replay(tried, P.elements_table(pages))


@query("J7", with_sql(ACCOUNT_SQL, """asked AS (
  SELECT id, b.s AS selector, b.n AS n_found FROM (SELECT id, unnest([
    {s: 'input[name=q]', n: b2::INT}, {s: 'form > input[type="password"][required]', n: b1::INT}, {s: 'body form button', n: 1},
    {s: 'table tr:nth-of-type(2) > td', n: 3}, {s: 'a.next[href^="/list"]', n: b0::INT}, {s: 'a', n: 1 + b0::INT},
    {s: '#f' || id || ', [aria-label=Holder]', n: (b0 OR b3)::INT}, {s: 'form a', n: 0}, {s: 'tr > input', n: 0},
    {s: 'input:hover', n: 0}]) AS b FROM account))"""
    , select="SELECT id AS page_id, selector, selector <> 'input:hover' AS known, n_found FROM asked"))
def found_selectors(spark, sf):
    """Selectors as people write them, on every account page."""
    pages = account_pages(spark, sf)
    asked = F.array(*[F.lit(s) for s in (
        "input[name=q]", 'form > input[type="password"][required]', "body form button", "table tr:nth-of-type(2) > td",
        'a.next[href^="/list"]', "a", "form a", "tr > input", "input:hover")],
        F.concat(F.lit("#f"), F.col("id"), F.lit(", [aria-label=Holder]")))
    selectors = pages.select(F.col("id").alias("page_id"), F.explode(asked).alias("selector"))
    return found_by_selector(pages, selectors).drop("first_pos")


@query("J7", with_sql(ACCOUNT_SQL, select="""
SELECT id, id AS page_id, b0 OR b1 OR b2 AS resolved, CAST(CASE WHEN b2 THEN 0 WHEN b1 THEN 1 WHEN b0 THEN 2 END AS INTEGER) AS selector_rank,
       CASE WHEN b2 THEN 'input[name=q]' WHEN b1 THEN 'form input[name="pw"]' WHEN b0 THEN 'a.next' END AS resolved_selector FROM account"""))
def replayed_css_selectors(spark, sf):
    """Steps whose selectors were written by hand, replayed on the saved pages."""
    pages = account_pages(spark, sf)
    steps = pages.select("id", F.col("id").alias("page_id"), F.lit("input[name=q]").alias("selector"),
                         F.array(F.lit('form input[name="pw"]'), F.lit("a.next")).alias("fallback_selectors"))
    return replay_on_pages(steps, pages)
