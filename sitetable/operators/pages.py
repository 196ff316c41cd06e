"""Pages and what they contain: elements, links, forms, tables, types, versions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetable.functions import roles
from sitetable.functions.html import DATA_TAGS, ELEMENT_TAGS, INTERACTIVE_TAGS, PARTS, TEXT_LIMIT, parse_html
from sitetable.functions.page_types import page_signals, page_type
from sitetable.functions.text import content_hash, content_key
from sitetable.operators.chunks import changes, in_slices
from sitetable.session import checkpointed

SIGNAL_PARTS = ("title", "signals")


def parse_pages(pages: DataFrame, parts: Iterable[str] = PARTS, tags: Iterable[str] = ELEMENT_TAGS,
                html: str = "html", text_limit: int | None = TEXT_LIMIT, max_depth: int | None = None) -> DataFrame:
    """Add ``parsed``; every table below is a projection of it. Write it out when several jobs follow."""
    return pages.withColumn("parsed", parse_html(F.col(html), parts, tags, text_limit, max_depth))


def titles(pages: DataFrame, key: str = "id") -> DataFrame:
    return parse_pages(pages.select(key, "html"), ("title",)).select(key, F.col("parsed.title").alias("title"))


def page_texts(pages: DataFrame, key: str = "id") -> DataFrame:
    """Visible text per page, text nodes joined by one space."""
    return parse_pages(pages.select(key, "html"), ("text",)).select(key, F.col("parsed.text").alias("text"))


def with_roles(elements: Column) -> Column:
    """Element array with role, confidence, aria label and the interactive flag added, row by row."""
    def role(e: Column) -> Column:
        return F.struct(e.alias("e"), roles.known_role(roles.infer_role(e.tag, e.attributes)).alias("role"))

    def enrich(pair: Column) -> Column:
        e = pair["e"]
        return F.struct(
            e.doc_pos.alias("doc_pos"), pair["role"].alias("role"), e.tag.alias("tag"), e.text.alias("label"),
            e.selector.alias("selector"), _aria(e.attributes).alias("aria_label"), e.attributes.alias("attributes"),
            roles.confidence(pair["role"], e.attributes).alias("confidence"),
            roles.is_interactive(e.tag).alias("is_interactive"), e.attributes_text.alias("attributes_text"))
    return F.transform(F.transform(elements, role), enrich)


def _aria(attributes: Column) -> Column:
    return F.coalesce(attributes.getItem("aria-label"), attributes.getItem("aria_label"))


def elements_table(pages: DataFrame, key: str = "id", tags: Sequence[str] | None = None,
                   parsed: Column | None = None, text_limit: int | None = TEXT_LIMIT) -> DataFrame:
    """One row per element of the wanted tags, in document order (``doc_pos``), with role and confidence.

    Pages that already carry a ``parsed`` column are not parsed again when ``parsed`` names it.
    """
    wanted = tuple(tags) if tags else ELEMENT_TAGS
    if parsed is None:
        pages = parse_pages(pages.select(key, "html"), ("elements",), wanted, text_limit=text_limit)
        parsed = F.col("parsed")
    rows = pages.select(F.col(key).alias("page_id"), F.explode(parsed.getField("elements")).alias("e"))
    role = roles.known_role(roles.infer_role(F.col("e.tag"), F.col("e.attributes")))
    rows = rows.select(
        "page_id", role.alias("role"), F.col("e.tag").alias("tag"), F.col("e.text").alias("label"),
        F.col("e.selector").alias("selector"),
        _aria(F.col("e.attributes")).alias("aria_label"),
        F.col("e.attributes").alias("attributes"), F.col("e.attributes_text").alias("attributes_text"),
        roles.is_interactive(F.col("e.tag")).alias("is_interactive"), F.col("e.doc_pos").alias("doc_pos"))
    return (rows.withColumn("confidence", roles.confidence(F.col("role"), F.col("attributes")))
                .withColumn("id", content_key("page_id", "doc_pos")))


def with_tags(elements: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Elements of the given tags; by default the interactive and the data tags."""
    return elements.filter(F.col("tag").isin(*(tags or INTERACTIVE_TAGS + DATA_TAGS)))


def interactive(elements: DataFrame) -> DataFrame:
    return elements.filter("is_interactive")


def link_elements(elements: DataFrame) -> DataFrame:
    """Elements that are links: ``a`` with an href, empty ones included."""
    return elements.filter((F.col("tag") == "a") & F.map_contains_key("attributes", F.lit("href")))


def links(pages: DataFrame, key: str = "id") -> DataFrame:
    """One row per link with its place on the page."""
    parsed = parse_pages(pages.select(key, "html"), ("links",))
    return (parsed.select(F.col(key).alias("page_id"), F.posexplode("parsed.links").alias("link_pos", "link"))
                  .select("page_id", "link_pos", "link.href", "link.text"))


def forms(pages: DataFrame, key: str = "id") -> DataFrame:
    """One row per form: action, method and its inputs."""
    parsed = parse_pages(pages.select(key, "html"), ("forms",))
    return (parsed.select(F.col(key).alias("page_id"), F.posexplode("parsed.forms").alias("form_pos", "form"))
                  .select("page_id", "form_pos", "form.action", "form.method", "form.inputs"))


def form_inputs(pages: DataFrame, key: str = "id") -> DataFrame:
    """One row per form input."""
    return (forms(pages, key)
            .select("page_id", "form_pos", "action", "method",
                    F.posexplode("inputs").alias("input_pos", "i"))
            .select("page_id", "form_pos", "action", "method", "input_pos", "i.tag", "i.name", "i.type",
                    "i.placeholder", "i.required"))


def table_rows(pages: DataFrame, key: str = "id") -> DataFrame:
    """One row per table row found in the pages, as a header -> cell map.

    Tables without a header row get the names c0, c1, ...; cells beyond the header too.
    A repeated header name gets the number of its occurrence: P, P_2, ...; no cell is lost.
    """
    parsed = parse_pages(pages.select(key, "html"), ("tables",))
    rows = (parsed.select(F.col(key).alias("page_id"), F.posexplode("parsed.tables").alias("table_pos", "t"))
                  .select("page_id", "table_pos", F.col("t.header").alias("header"),
                          F.posexplode("t.rows").alias("row_pos", "cells")))
    named = F.transform("cells", lambda cell, i: F.struct(
        F.coalesce(F.nullif(F.get("header", i), F.lit("")), F.concat(F.lit("c"), i.cast("string"))).alias("name"),
        cell.alias("cell")))

    def numbered(pairs: Column, mark: Column) -> Column:
        def rename(pair: Column, i: Column) -> Column:
            n = F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda p: p["name"] == pair["name"]))
            return F.struct(F.when(n == 1, pair["name"]).otherwise(F.concat(pair["name"], mark, n.cast("string"))).alias("name"),
                            pair["cell"].alias("cell"))
        return F.transform(pairs, rename)

    # a numbered name may meet one that was there; the second mark starts with a character no trimmed header has
    rows = rows.withColumn("pairs", named).withColumn("pairs", numbered(F.col("pairs"), F.lit("_")))
    rows = rows.withColumn("pairs", numbered(F.col("pairs"), F.lit("\n")))
    return rows.select("page_id", "table_pos", "row_pos", F.map_from_entries("pairs").alias("fields"))


def classify_pages(pages: DataFrame, strict: bool = False,
                   score_cols: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``title``, ``signals``, ``page_type`` and ``confidence`` in one pass over the html.

    A stored title is kept; the parsed one fills in where it is null or absent.
    """
    return classify_parsed(parse_pages(pages, SIGNAL_PARTS), strict, score_cols).drop("parsed")


def classify_parsed(parsed: DataFrame, strict: bool = False,
                    score_cols: Mapping[str, str] | None = None) -> DataFrame:
    """``classify_pages`` for pages that carry a ``parsed`` column already."""
    stored = F.col("title") if "title" in parsed.columns else F.lit(None)
    return (parsed
            .withColumn("title", F.coalesce(stored, F.col("parsed.title")))
            .withColumn("signals", page_signals(strict=strict))
            .withColumn("_type", page_type("signals", score_cols))
            .withColumns({"page_type": F.col("_type.page_type"), "confidence": F.col("_type.confidence")})
            .drop("_type"))


def pages_of_type(pages: DataFrame, wanted: str, limit: int | None = 10, key: str = "id") -> DataFrame:
    """Pages of one type, in key order so that the limit is stable; None for all."""
    found = pages.filter(F.col("page_type") == wanted)
    return found if limit is None else found.orderBy(key).limit(limit)


def latest_pages(pages: DataFrame, url: str | None = None, key: str = "id") -> DataFrame:
    """The latest version of every URL (or of one): highest version, then latest collected, then lowest id.

    Only (version, collected_at, id) is aggregated per URL, partially on the map side,
    so a URL with very many versions costs no more than any other; the wide rows
    are then picked by id.
    """
    if url is not None:
        pages = pages.filter(F.col("url") == url)
    last = F.lit(2**63 - 1)
    newest_first = F.struct(
        F.coalesce(-F.col("version").cast("long"), last).alias("version"),
        F.coalesce(-F.unix_micros(F.col("collected_at").cast("timestamp")), last).alias("collected"),
        F.col(key).alias("key"))
    keep = pages.groupBy("url").agg(F.min(newest_first).alias("top")).select(F.col("top.key").alias("_keep"))
    return pages.join(keep, F.col(key) == F.col("_keep"), "left_semi")


def page_versions(snapshots: DataFrame, key: str = "id", slices: int | None = None) -> DataFrame:
    """Version number and change flag per snapshot: a URL's version rises when its content hash changes.

    Works on (key, url, collected_at, hash) only, in range slices of (url, collected_at, key): a busy URL is many
    slices, whatever its times are, also with all of them null; what passes from slice to slice is one row each.
    """
    slim = checkpointed(snapshots.select(key, "url", "collected_at", content_hash("html").alias("content_hash")))
    order = ["collected_at", key]
    seen = changes(in_slices(slim, ["url", *order], slices), ["url"], order, "content_hash", F.col("_slice"))
    return seen.select(key, "url", "collected_at", "content_hash", F.col("previous").alias("previous_hash"),
                       "changed", (F.col("change_no") + 1).cast("int").alias("version"))
