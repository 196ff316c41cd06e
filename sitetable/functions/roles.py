"""Element roles and their confidence, from tag and attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitetable.functions.html import INTERACTIVE_TAGS

# Role rules, in the order in which they apply; the first that fits wins.
INPUT_ROLES = {"text": "field", "password": "field", "email": "field", "search": "field", "submit": "action"}
TAG_ROLES = {"button": "action", "a": "navigation", "select": "field", "textarea": "field"}
ROLE_ATTRIBUTE_ROLES = {"navigation": "navigation", "search": "field", "button": "action", "link": "navigation"}
PAGINATION_CLASSES = ("paginat", "next", "prev")
DATA_TAG_ROLES = {"table": "data", "tr": "data", "td": "data", "th": "data"}
KNOWN_ROLES = ("field", "action", "navigation", "status", "data", "pagination")


def _lookup(roles: dict[str, str], key: Column) -> Column:
    pairs = ", ".join(f"'{name}', '{role}'" for name, role in roles.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def infer_role(tag: Column, attributes: Column) -> Column:
    """Role by input type, tag, role attribute, class and data tag, in that order; else ``unknown``."""
    class_name = F.lower(attributes.getItem("class"))
    paginates = class_name.contains(PAGINATION_CLASSES[0])
    for part in PAGINATION_CLASSES[1:]:
        paginates = paginates | class_name.contains(part)
    return F.coalesce(
        F.when(tag == "input", _lookup(INPUT_ROLES, F.lower(attributes.getItem("type")))),
        _lookup(TAG_ROLES, tag),
        _lookup(ROLE_ATTRIBUTE_ROLES, F.lower(attributes.getItem("role"))),
        F.when(paginates, "pagination"),
        _lookup(DATA_TAG_ROLES, tag),
        F.lit("unknown"))


def known_role(role: Column) -> Column:
    """Map a free role name to the role domain; anything else is ``unknown``."""
    return F.coalesce(_lookup({name: name for name in KNOWN_ROLES}, role), F.lit("unknown"))


def _given(attributes: Column, name: str) -> Column:
    return F.coalesce(attributes.getItem(name), F.lit("")) != ""


def confidence(role: Column, attributes: Column) -> Column:
    """0.5 plus a share for id, name, role and a known role, then a share for an aria label; 1.0 at most."""
    def share(test: Column, amount: float) -> Column:
        return F.when(test, F.lit(amount)).otherwise(F.lit(0.0))
    base = (F.lit(0.5) + share(_given(attributes, "id"), 0.1) + share(_given(attributes, "name"), 0.1)
            + share(_given(attributes, "role"), 0.15) + share(role != "unknown", 0.1))
    label = _given(attributes, "aria-label") | _given(attributes, "aria_label")
    return F.least(F.least(base, F.lit(1.0)) + share(label, 0.15), F.lit(1.0))


def is_interactive(tag: Column) -> Column:
    return tag.isin(*INTERACTIVE_TAGS)
