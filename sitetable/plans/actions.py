"""Action plans as tables: one row per planned step, built from each page's own elements.

The input is a page table with an ``elements`` array (``with_roles``); every pick
is an array expression inside the page's row, so planning never shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetable.functions.html import INTERACTIVE_TAGS
from sitetable.functions.page_types import page_signals, page_type
from sitetable.functions.text import content_key
from sitetable.operators.pages import parse_pages, with_roles

# Keyword lists by priority, and waits in milliseconds.
USER_WORDS = ("email", "user", "username", "account", "login")
LOGIN_ACTION_WORDS = ("login", "sign in", "submit")
NEXT_WORDS = ("next", "›", "»", "next page")
DOWNLOAD_WORDS = ("download", "export", "csv", "excel", "xlsx")
SEARCH_WORDS = ("search", "query", "keyword", "find")
LOGIN_WAIT_MS, PAGE_WAIT_MS, SEARCH_WAIT_MS = 5000, 3000, 4000

FIELD_ROLES = ("field",)
ACTION_ROLES = ("action", "navigation")

STEP_TYPE = ("struct<action_type:string,selector:string,value:string,description:string,timeout_ms:int,"
             "fallback_selectors:array<string>,meta:map<string,string>,matched:boolean>")


def page_elements(pages: DataFrame) -> DataFrame:
    """Pages with ``elements`` (interactive, with roles) and ``page_type``: the input of the plans."""
    parsed = parse_pages(pages, ("title", "elements", "signals"), INTERACTIVE_TAGS)
    return (parsed.withColumns({"_signals": page_signals(title="parsed.title"),
                                "elements": with_roles(F.col("parsed.elements"))})
                  .withColumn("page_type", page_type("_signals").getField("page_type"))
                  .drop("parsed", "_signals"))


def pick_by_words(elements: Column, roles: Sequence[str], words: Sequence[str]) -> Column:
    """The element for the first keyword that any candidate carries, else the first candidate.

    A keyword outranks document order: the earliest word wins even on a late
    element. Label, selector and attributes (names included) are searched.
    Struct with selector and ``matched``, null without a candidate.
    """
    def place(e: Column) -> Column:
        hay = F.lower(F.concat(e.label, e.selector, e.attributes_text))
        hits = F.array(*[F.when(hay.contains(word.lower()), F.lit(i)) for i, word in enumerate(words)])
        return F.struct(F.coalesce(F.array_min(hits), F.lit(len(words))).alias("rank"),
                        e.doc_pos.alias("doc_pos"), e.selector.alias("selector"))

    def mark(e: Column) -> Column:
        return F.struct(e["rank"].alias("rank"), e.doc_pos.alias("doc_pos"), e.selector.alias("selector"),
                        (e["rank"] < len(words)).alias("matched"))

    candidates = F.filter(elements, lambda e: e.role.isin(*roles))
    return F.array_min(F.transform(F.transform(candidates, place), mark))


def pick_by_type(elements: Column, input_type: str) -> Column:
    """The first element whose ``type`` attribute is exactly ``input_type``, whatever its role."""
    found = F.filter(elements, lambda e: F.coalesce(e.attributes.getItem("type") == input_type, F.lit(False)))
    return F.array_min(F.transform(found, lambda e: F.struct(
        e.doc_pos.alias("doc_pos"), e.selector.alias("selector"), F.lit(True).alias("matched"))))


def step(action_type: str, description: str, pick: Column | None = None, value: Column | None = None,
         timeout_ms: int | None = None, meta: Column | None = None) -> Column:
    """One planned action; a step with a pick is null where the pick found nothing."""
    built = F.struct(
        F.lit(action_type).alias("action_type"),
        (pick.getField("selector") if pick is not None else F.lit(None).cast("string")).alias("selector"),
        (value if value is not None else F.lit(None)).cast("string").alias("value"),
        F.lit(description).alias("description"),
        F.lit(timeout_ms).cast("int").alias("timeout_ms"),
        F.array().cast("array<string>").alias("fallback_selectors"),
        (meta if meta is not None else F.create_map().cast("map<string,string>")).alias("meta"),
        (pick.getField("matched") if pick is not None else F.lit(None).cast("boolean")).alias("matched"),
    ).cast(STEP_TYPE)
    return built if pick is None else F.when(pick.isNotNull(), built)


def assemble(pages: DataFrame, goal: Column, steps: Column, key: str = "id") -> DataFrame:
    """Plan table: the non-null steps of each page in order, numbered from 0."""
    rows = pages.select(F.col(key).alias("page_id"), goal.alias("goal"),
                        F.posexplode(F.array_compact(steps)).alias("step_index", "s"))
    return rows.select("page_id", "goal", "step_index", "s.*")


def plan_login(pages: DataFrame, username: Column, secret_ref: Column, key: str = "id") -> DataFrame:
    """Fill user, fill password, click submit, wait; a missing element drops its step, the wait stays.

    ``secret_ref`` names a stored secret; plain passwords do not belong in a table.
    """
    elements = F.col("elements")
    picked = (pages.withColumn("_user", pick_by_words(elements, FIELD_ROLES, USER_WORDS))
                   .withColumn("_password", pick_by_type(elements, "password"))
                   .withColumn("_submit", pick_by_words(elements, ACTION_ROLES, LOGIN_ACTION_WORDS)))
    return assemble(picked, F.lit("login"), F.array(
        step("fill", "Fill username / email", F.col("_user"), username),
        step("fill", "Fill password", F.col("_password"), secret_ref),
        step("click", "Click login / submit", F.col("_submit")),
        step("wait", "Wait for navigation after login", timeout_ms=LOGIN_WAIT_MS)), key)


def plan_extract(pages: DataFrame, key: str = "id") -> DataFrame:
    """One extract step; the strategy is ``table`` on list pages and ``dom`` elsewhere."""
    strategy = F.when(F.col("page_type") == "list", "table").otherwise("dom")
    return assemble(pages, F.lit("extract_data"), F.array(
        step("extract", "Extract all data rows from page", meta=F.create_map(F.lit("strategy"), strategy))), key)


def plan_paginate(pages: DataFrame, max_pages: int = 50, key: str = "id") -> DataFrame:
    """Extract, then (click next, wait, extract) for each further page if there is anything to click."""
    first = step("extract", "Extract data from current page")
    following = F.array(
        step("click", "Click next page", F.col("_next")),
        step("wait", "Wait for page load", timeout_ms=PAGE_WAIT_MS),
        step("extract", "Extract data from page"))
    steps = F.array(first)
    if max_pages > 1:
        more = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_pages - 1)), lambda _: F.col("_round")))
        steps = F.when(F.col("_next").isNotNull(), F.concat(steps, more)).otherwise(steps)
    picked = (pages.withColumn("_next", pick_by_words(F.col("elements"), ACTION_ROLES, NEXT_WORDS))
                   .withColumn("_round", following))
    return assemble(picked, F.lit("paginate_and_extract"), steps, key)


def plan_download(pages: DataFrame, key: str = "id") -> DataFrame:
    """One download step, or no rows for a page without anything to click."""
    picked = pages.withColumn("_link", pick_by_words(F.col("elements"), ACTION_ROLES, DOWNLOAD_WORDS))
    return assemble(picked, F.lit("download_file"),
                    F.array(step("download", "Click download / export link", F.col("_link"))), key)


def plan_search(pages: DataFrame, query: Column, key: str = "id") -> DataFrame:
    """Fill the search field, submit, wait; no rows for a page without a field."""
    picked = pages.withColumn("_field", pick_by_words(F.col("elements"), FIELD_ROLES, SEARCH_WORDS))
    field = F.col("_field")
    wait = step("wait", "Wait for search results", timeout_ms=SEARCH_WAIT_MS)
    return assemble(picked, F.concat(F.lit("search:"), query), F.array(
        step("fill", "Enter search query", field, query),
        step("submit", "Submit search form", field),
        F.when(field.isNotNull(), wait)), key)


def action_json(steps: DataFrame) -> DataFrame:
    """Add ``action``: the seven fields of a planned action as one JSON object, nulls written out."""
    fields = ("action_type", "selector", "value", "description", "timeout_ms", "fallback_selectors", "meta")
    return steps.withColumn("action", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def replayable(plans: DataFrame) -> DataFrame:
    """Plan steps with the ``id`` by which ``operators.steps.replay`` reports on them."""
    return plans.withColumn("id", content_key("page_id", "goal", "step_index"))


def plan_lengths(steps: DataFrame) -> DataFrame:
    return steps.groupBy("page_id", "goal").agg(F.count("*").alias("n_steps"))
