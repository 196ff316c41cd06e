"""Page signals and page type: weighted boolean signals, all native expressions.

Arguments are column names (``parsed.forms`` style paths included); the rules
are rendered as SQL text, which keeps the expressions short to read and to build.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


# Signal, page type, weight. Ties go to the type named first.
SIGNAL_RULES: tuple[tuple[str, str, float], ...] = (
    ("has_password_field", "login", 0.9),
    ("has_login_keyword", "login", 0.6),
    ("has_search_field", "search", 0.7),
    ("has_table", "list", 0.6),
    ("has_list_items", "list", 0.4),
    ("has_pagination", "list", 0.5),
    ("has_many_inputs", "form", 0.6),
    ("has_submit_button", "form", 0.3),
    ("has_charts", "dashboard", 0.7),
    ("has_dashboard_keyword", "dashboard", 0.5),
    ("has_download_link", "download", 0.8),
    ("has_detail_keyword", "detail", 0.4),
)
# Keyword lists of the signals.
LOGIN_WORDS = ("login", "sign in", "signin", "log in")
PAGINATION_WORDS = ("pagination", "page-next", "pager", "?page=", "&page=")
CHART_WORDS = ("chart", "echarts", "highcharts", "d3.js", "canvas")
DASHBOARD_WORDS = ("dashboard", "overview", "summary")
DOWNLOAD_WORDS = ('href="', "download", ".csv", ".xlsx", ".zip")
DETAIL_WORDS = ("detail", "profile", "view", "show", "record")

SIGNALS = tuple(signal for signal, _, _ in SIGNAL_RULES)
SCORED_TYPES = tuple(dict.fromkeys(page_type for _, page_type, _ in SIGNAL_RULES))


def _any(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{word}')" for word in words) + ")"


def page_signals(html: str = "html", title: str = "title", url: str = "url", facts: str = "parsed.signals",
                 strict: bool = False) -> Column:
    """Struct of the 12 signals; ``facts`` is the parsed part ``signals``.

    ``strict`` repairs two loose tests: any quoted link counting as a download
    and ``<link`` counting as a list item.
    """
    low = f"lower({html})"
    named = f"lower(concat(coalesce({title}, ''), ' ', coalesce({url}, '')))"

    def count(part: str) -> str:
        return f"(length({low}) - length(replace({low}, '{part}', ''))) div {len(part)}"

    def form_input(kind: str) -> str:
        return f"array_contains({facts}.form_inputs, '{kind}')"

    items = f"({count('<li')}) - ({count('<link')})" if strict else count("<li")
    tests = {
        "has_password_field": form_input("password"),
        "has_login_keyword": _any(named, LOGIN_WORDS),
        "has_search_field": f"coalesce({form_input('search')}, false) OR contains({low}, 'search')",
        "has_table": f"contains({low}, '<table')",
        "has_list_items": f"{items} > 5",
        "has_pagination": _any(low, PAGINATION_WORDS),
        "has_many_inputs": f"{facts}.inputs >= 4",
        "has_submit_button": f"{facts}.submit",
        "has_charts": _any(low, CHART_WORDS),
        "has_dashboard_keyword": _any(named, DASHBOARD_WORDS),
        "has_download_link": _any(low, DOWNLOAD_WORDS[1:] if strict else DOWNLOAD_WORDS),
        "has_detail_keyword": _any(named, DETAIL_WORDS),
    }
    fields = ", ".join(f"'{name}', coalesce({tests[name]}, false)" for name in SIGNALS)
    return F.expr(f"named_struct({fields})")


def type_scores(signals: str = "signals") -> dict[str, str]:
    """SQL text of the score per page type: its weights summed in rule order."""
    parts: dict[str, list[str]] = {page_type: [] for page_type in SCORED_TYPES}
    for signal, page_type, weight in SIGNAL_RULES:
        parts[page_type].append(f"if({signals}.{signal}, {weight}D, 0D)")
    return {page_type: "(" + " + ".join(terms) + ")" for page_type, terms in parts.items()}


def page_type(signals: str = "signals", score_cols: Mapping[str, str] | None = None) -> Column:
    """Struct (page_type, confidence): best score and its share of all scores.

    ``score_cols`` names columns that replace rule scores per type, e.g. those
    of a model. Without any score the page is ``unknown`` with confidence 0.
    """
    scores = {**type_scores(signals), **(score_cols or {})}
    ranked = ", ".join(f"named_struct('score', {score}, 'rank', {-rank}, 'name', '{name}')"
                       for rank, (name, score) in enumerate(scores.items()))
    best, total = f"array_max(array({ranked}))", " + ".join(scores.values())
    return F.expr(f"""named_struct(
        'page_type', CASE WHEN {total} > 0 THEN {best}.name ELSE 'unknown' END,
        'confidence', CASE WHEN {total} > 0 THEN least({best}.score / ({total}), 1D) ELSE 0D END)""")
