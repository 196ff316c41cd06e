"""Redacting JSON texts of any shape, by field name and by value."""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# shipped with the job: workers need not have the library installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TOKEN = re.compile(r"""[ \t\n\r]*+(?:
    (?P<sign>[{}\[\],:])
  | (?P<text>"(?:[^"\\\x00-\x1f]++ | \\(?:["\\/bfnrt] | u[0-9a-fA-F]{4}))*+")
  | (?P<plain>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?+ | true | false | null)
  | (?P<end>\Z))""", re.X)


def _quoted(value: str) -> str:
    out = json.dumps(value, ensure_ascii=False)
    try:
        out.encode()
        return out
    except UnicodeEncodeError:  # half a surrogate pair can only be written as an escape
        return json.dumps(value)


class _Open:
    """An object or list that is being read; ``raw`` ones are copied without a look inside."""

    __slots__ = ("is_list", "raw", "entries", "key")

    def __init__(self, is_list: bool, raw: bool):
        self.is_list, self.raw, self.key = is_list, raw, None
        self.entries: dict = {}

    def add(self, value) -> None:
        # of entries that repeat a name the last counts, in the place of the first
        self.entries[len(self.entries) if self.is_list else self.key] = value

    def closed(self) -> list:
        """Texts, and lists of such, to be written one after the other."""
        out: list = ["[" if self.is_list else "{"]
        for n, (key, value) in enumerate(self.entries.items()):
            out += ["," if n else "", "" if self.is_list else _quoted(key) + ":", value]
        return [*out, "]" if self.is_list else "}"]


def cleaned_json(text: str, names: frozenset[str], patterns: list[re.Pattern], placeholder: str) -> str | None:
    """The text with named entries replaced and texts redacted, within lists too; None if it is no JSON.

    Lists within lists are left alone. Read token by token on a stack of its own, so nesting has no limit, and numbers
    keep their spelling.
    """
    stack: list[_Open] = []
    masked = _quoted(placeholder)
    want, result, at = "value", None, 0
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            return None
        at = token.end()
        if token["end"] is not None:
            break
        sign = token["sign"]
        top = stack[-1] if stack else None
        if want in ("value", "first") and (sign is None or sign in "{["):
            if sign is not None:
                in_list = top is not None and top.is_list
                stack.append(_Open(sign == "[", bool(top) and (top.raw or sign == "[" and in_list)))
                want = "first" if sign == "[" else "first key"
                continue
            value = token["plain"]
            if value is None:
                value = json.loads(token["text"])
                if not (top and top.raw):
                    for pattern in patterns:
                        value = pattern.sub(lambda _: placeholder, value)
                value = _quoted(value)
        elif want in ("key", "first key") and token["text"] is not None:
            top.key, want = json.loads(token["text"]), "colon"
            continue
        elif want == "colon" and sign == ":":
            want = "value"
            continue
        elif want == "next" and sign == ",":
            want = "value" if top.is_list else "key"
            continue
        elif top and sign == ("]" if top.is_list else "}") and want in ("next", "first" if top.is_list else "first key"):
            value = stack.pop().closed()
            top = stack[-1] if stack else None
        else:
            return None
        if top is None:
            result, want = value, "end"
        else:
            top.add(masked if not top.is_list and not top.raw and top.key.lower() in names else value)
            want = "next"
    return None if want != "end" else _joined(result)


def _joined(value) -> str:
    out, left = [], [value]
    while left:
        part = left.pop()
        if isinstance(part, list):
            left.extend(reversed(part))
        else:
            out.append(part)
    return "".join(out)


def redact_json_text(text: Column, names, patterns, hint: str, placeholder: str) -> Column:
    """A JSON text whose named entries, at any depth and of any type, hold the placeholder, and whose other texts are
    redacted by ``patterns`` in their order; keys and numbers stay as they are spelled. A text that is no JSON is unchanged.

    Only texts that hold one of the names in quotes, or match ``hint``, go to Python (the rest are passed as null).
    """
    wanted = frozenset(n.lower() for n in names)
    patterns = list(patterns)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        compiled = [re.compile(p) for p in patterns]

        def one(t):
            if t is None:
                return None
            out = cleaned_json(t, wanted, compiled, placeholder)
            return t if out is None else out
        return texts.map(one, na_action=None)

    # an escaped spelling of a name cannot be seen in the text, so escapes count as a hint too
    named = r'(?i)"(?:' + "|".join(sorted(map(re.escape, wanted))) + r')"|\\u'
    return F.coalesce(mask(F.when(text.rlike(named) | text.rlike(hint), text)), text)
