"""Do selectors that people write still find something in saved pages? A structural join, as column expressions.

A selector becomes a list of tests, one per step from ancestor to element: tag, ids, classes, attributes, place among
siblings of its tag. A page's nodes carry their place in document order and where they end, so a node lies inside
another when its place lies in that one's interval. The steps are applied from left to right: a set of nodes that
pass the first test, the nodes inside one of them (or directly below, after ``>``) that pass the second, and so on.

Known: ``tag``, ``*``, ``#id``, ``.class``, ``[name]``, ``[name=value]`` with ``~=``, ``^=``, ``$=``, ``*=``, ``|=``, quoted
values, ``:nth-of-type(n)``, descendants, ``>``, and lists with commas. Any other selector is not ``known`` and finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetable.operators.pages import parse_pages

# fixed values: the parts of a selector
_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_QUOTED = r'"[^"]*"|' + r"'[^']*'"
_BRACKET = rf"\[(?:[^\]\"']|{_QUOTED})*\]"
_SIMPLE = rf"(?:[^\s>,\[\"']|{_BRACKET})+"
_STEP = rf"(\s*>\s*|\s+|^)({_SIMPLE})"
_ATTRIBUTE = rf"\[\s*({_NAME})\s*(?:([~^$*|]?=)\s*({_QUOTED}|[^\s\]\"']+)\s*)?\]"
_COMPOUND = rf"^(?:\*|{_NAME})?(?:#{_NAME}|\.{_NAME}|{_ATTRIBUTE}|:nth-of-type\(\d+\))*$"
_LISTED = rf"(?:[^,\[\"']|{_BRACKET})+"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _test(step: Column, joint: Column) -> Column:
    """What a node has to have, from the text of one step."""
    bare = F.regexp_replace(step, _BRACKET, "")

    def names(pattern: str) -> Column:
        return F.transform(_all(bare, pattern, 1), lambda x: F.regexp_replace(x, r"\\(.)", "$1"))

    def attribute(raw: Column) -> Column:
        value = F.regexp_extract(raw, _ATTRIBUTE, 3)
        return F.struct(F.lower(F.regexp_extract(raw, _ATTRIBUTE, 1)).alias("name"), F.regexp_extract(raw, _ATTRIBUTE, 2).alias("sign"),
                        F.regexp_replace(value, r"""^["']|["']$""", "").alias("value"))

    return F.struct(
        F.trim(joint).alias("joint"), F.lower(F.regexp_extract(bare, rf"^{_NAME}", 0)).alias("tag"),
        names(rf"(?<!\\)#({_NAME})").alias("ids"), names(rf"(?<!\\)\.({_NAME})").alias("classes"),
        F.transform(_all(step, _BRACKET), attribute).alias("attributes"),
        F.regexp_extract(bare, r":nth-of-type\((\d+)\)", 1).alias("nth"))


def parsed_selector(selector: Column) -> Column:
    """Array of alternatives, each an array of tests; null where a part is not known."""
    def steps(one: Column) -> Column:
        tests = F.zip_with(_all(one, _STEP, 2), _all(one, _STEP, 1), _test)
        # without this, a step that no pattern fits would be passed over
        fits = (F.regexp_replace(one, _STEP, "") == "") & F.forall(_all(one, _STEP, 2), lambda s: s.rlike(_COMPOUND))
        return F.when(fits & (one != ""), tests)

    alternatives = F.transform(F.transform(_all(selector, _LISTED), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), steps)
    whole = F.regexp_replace(F.regexp_replace(selector, _LISTED, ""), r"\s", "")
    commas = F.length(whole) == F.size(alternatives) - 1
    return F.when(commas & (F.size(alternatives) > 0) & F.forall(alternatives, lambda a: a.isNotNull()), alternatives)


def _passes(node: Column, test: Column) -> Column:
    """Does a node pass the test of one step?"""
    def holds(a: Column) -> Column:
        # a column in a lambda: the value is null where the node has no such attribute
        have = F.try_element_at(node["attributes"], a["name"])
        sign, value = a["sign"], a["value"]
        some = value != ""
        return F.coalesce(
            F.when(sign == "", have.isNotNull()).when(sign == "=", have == value)
             .when(sign == "~=", some & F.array_contains(F.split(have, r"\s+"), value))
             .when(sign == "^=", some & have.startswith(value)).when(sign == "$=", some & have.endswith(value))
             .when(sign == "*=", some & have.contains(value))
             .when(sign == "|=", (have == value) | have.startswith(F.concat(value, F.lit("-")))), F.lit(False))

    own = F.split(F.coalesce(F.try_element_at(node["attributes"], F.lit("class")), F.lit("")), r"\s+")
    ident = F.coalesce(F.try_element_at(node["attributes"], F.lit("id")), F.lit(""))
    return (((test["tag"] == "") | (node["tag"] == test["tag"])) & F.forall(test["ids"], lambda i: ident == i)
            & F.forall(test["classes"], lambda c: F.array_contains(own, c))
            & ((test["nth"] == "") | (node["nth"].cast("string") == test["nth"])) & F.forall(test["attributes"], holds))


def found_places(nodes: Column, alternatives: Column) -> Column:
    """Places in document order of the nodes that a selector finds; none for one that is not known."""
    spot = "array<struct<pos:int,end:int>>"

    def narrowed(found: Column, test: Column) -> Column:
        def below(n: Column) -> Column:
            inside = F.exists(found, lambda a: (a["pos"] < n["pos"]) & (n["pos"] < a["end"]))
            child = F.exists(found, lambda a: a["pos"] == n["up"])
            return found.isNull() | F.when(test["joint"] == ">", child).otherwise(inside)
        hits = F.filter(nodes, lambda n: _passes(n, test) & below(n))
        return F.transform(hits, lambda n: F.struct(n["pos"].alias("pos"), n["end"].alias("end"))).cast(spot)

    each = F.transform(F.coalesce(alternatives, F.array()), lambda tests: F.transform(
        F.aggregate(tests, F.lit(None).cast(spot), narrowed), lambda n: n["pos"]))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def found_by_selector(pages: DataFrame, selectors: DataFrame, key: str = "id", max_depth: int | None = None) -> DataFrame:
    """(page_id, selector, known, n_found, first_pos) of every distinct selector asked of a page; pages are parsed once.

    ``selectors`` has page_id and selector. Only these and the pages' nodes meet, by page.
    """
    asked = selectors.select("page_id", "selector").filter("selector IS NOT NULL").distinct()
    nodes = parse_pages(pages.select(key, "html"), ("nodes",), max_depth=max_depth).select(
        F.col(key).alias("page_id"), F.col("parsed.nodes").alias("nodes"))
    tests = asked.withColumn("tests", parsed_selector(F.col("selector")))
    # merged: from the size of the scan Spark cannot tell what the parsed nodes weigh, and would broadcast them
    found = tests.join(nodes.hint("merge"), "page_id").select("page_id", "selector", F.col("tests").isNotNull().alias("known"),
                                                found_places(F.col("nodes"), F.col("tests")).alias("found"))
    return found.select("page_id", "selector", "known", F.coalesce(F.size("found"), F.lit(0)).alias("n_found"), F.get("found", F.lit(0)).alias("first_pos"))


def replay_on_pages(steps: DataFrame, pages: DataFrame, key: str = "id") -> DataFrame:
    """``steps.replay`` for any selector: which selector of a step still finds an element of the saved page?

    Own and fallback selectors are tried in order; the result has the columns of ``steps.replay``.
    """
    own = F.array(F.col("selector"))
    if "fallback_selectors" in steps.columns:
        own = F.concat(own, F.coalesce(F.col("fallback_selectors"), F.array().cast("array<string>")))
    tried = steps.select("id", "page_id", F.posexplode_outer(own).alias("_rank", "selector"))
    hits = found_by_selector(pages, tried, key).filter("n_found > 0").select("page_id", "selector", F.lit(True).alias("_hit"))
    found = (tried.join(hits.hint("merge"), ["page_id", "selector"], "left").groupBy("id", "page_id")
             .agg(F.min(F.when(F.col("_hit"), F.struct("_rank", "selector"))).alias("_best"),
                  F.max(F.col("selector").isNotNull()).alias("_any")))
    return found.select("id", "page_id", F.when(F.col("_any"), F.col("_best").isNotNull()).alias("resolved"),
                        F.col("_best._rank").alias("selector_rank"), F.col("_best.selector").alias("resolved_selector"))
