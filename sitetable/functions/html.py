"""Page HTML -> one nested record per page: the only Python stage of the library.

Spark has no HTML operator, so ``parse_html`` is an Arrow UDF around one regular
expression for tokens and a small tree builder; both take time linear in the page,
also on broken ones (the standard library's tokenizer does not, and one such page
would hold up a whole job). Only the html column travels to Python; the rest of the
row stays in the JVM. The tree is built leniently, the way C HTML parsers repair pages:

* ``html`` / ``head`` / ``body`` are implied, bare text under them opens a ``p``;
* an open ``p``, ``li``, ``td``, ``option`` ... is closed by the tags in ``_CLOSES``;
* an end tag closes what is open above its match, unless something of a higher
  structural rank (a table cell, a row, a ``div`` ...) lies in between;
* end tags without a match are dropped, except ``</p>``, which is an empty ``p``;
* a tag or comment that is never closed takes the rest of the source with it.

Nesting has no limit: nothing here recurses, and an end tag finds its match without walking the open elements.
Selectors spell out the whole path, so the elements of an endlessly nested page take space quadratic in its depth;
``max_depth`` bounds that where pages are not trusted: deeper elements become siblings and ``cut`` tells so.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# executors get this module with the UDF itself, whether or not the package is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tags that a page exposes for interaction, and the data tags listed with them.
INTERACTIVE_TAGS = ("a", "button", "input", "select", "textarea", "label", "form")
DATA_TAGS = ("table", "tr", "td", "th")
ELEMENT_TAGS = INTERACTIVE_TAGS + DATA_TAGS
TEXT_LIMIT = 300

PARTS = ("title", "text", "elements", "links", "forms", "tables")  # besides: "signals" for page types, "cut" where max_depth is given, "nodes" for selectors

_DDL = {
    "title": "string",
    "text": "string",
    "elements": "array<struct<doc_pos:int,tag:string,text:string,selector:string,"
                "attributes:map<string,string>,attributes_text:string>>",
    "links": "array<struct<href:string,text:string>>",
    "forms": "array<struct<action:string,method:string,inputs:array<struct<"
             "tag:string,name:string,type:string,placeholder:string,required:boolean>>>>",
    "tables": "array<struct<header:array<string>,rows:array<array<string>>>>",
    "signals": "struct<inputs:int,submit:boolean,form_inputs:array<string>>",
    "cut": "boolean",
    "nodes": "array<struct<pos:int,end:int,up:int,nth:int,tag:string,attributes:map<string,string>>>",
}
_ARROW = {
    "title": pa.string(),
    "text": pa.string(),
    "elements": pa.list_(pa.struct([
        ("doc_pos", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("selector", pa.string()),
        ("attributes", pa.map_(pa.string(), pa.string())), ("attributes_text", pa.string())])),
    "links": pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])),
    "forms": pa.list_(pa.struct([
        ("action", pa.string()), ("method", pa.string()),
        ("inputs", pa.list_(pa.struct([
            ("tag", pa.string()), ("name", pa.string()), ("type", pa.string()),
            ("placeholder", pa.string()), ("required", pa.bool_())])))])),
    "tables": pa.list_(pa.struct([
        ("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])),
    "signals": pa.struct([("inputs", pa.int32()), ("submit", pa.bool_()), ("form_inputs", pa.list_(pa.string()))]),
    "cut": pa.bool_(),
    "nodes": pa.list_(pa.struct([("pos", pa.int32()), ("end", pa.int32()), ("up", pa.int32()), ("nth", pa.int32()), ("tag", pa.string()),
                                 ("attributes", pa.map_(pa.string(), pa.string()))])),
}

_VOID = frozenset("area base basefont br col embed frame hr img input isindex link meta param source track wbr".split())
_HEAD = frozenset("title meta link script style base".split())
_UNREAD = frozenset("script style template rt rp".split())
_LIST_ATTRS = frozenset("class rel rev headers accesskey accept-charset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FONT = frozenset("tt i b u s strike big small".split())

# new tag -> open tags it ends
_CLOSES: dict[str, frozenset[str]] = {
    tag: frozenset({"p"}) for tag in
    "address blockquote center dir div dl fieldset hr menu ol pre ul table caption h1 h2 h3 h4 h5 h6".split()
}
for _h in _HEADINGS:
    _CLOSES[_h] |= _HEADINGS - {_h}
_CLOSES |= {
    "p": frozenset({"p"}) | _HEADINGS | _FONT,
    "form": frozenset({"form", "p", "ul", "ol", "dl", "address", "pre"}) | _HEADINGS,
    "a": frozenset({"a"}),
    "li": frozenset({"li", "p", "dl", "address", "pre"}) | _HEADINGS,
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "option": frozenset({"option"}),
    "optgroup": frozenset({"option", "optgroup"}),
    "table": frozenset({"p", "a", "pre"}) | _HEADINGS,
    "tr": frozenset({"tr", "td", "th", "p", "caption", "colgroup"}),
    "td": frozenset({"td", "th", "p", "span", "font", "a", "b", "u"}),
    "th": frozenset({"td", "th", "p", "span", "font", "a", "b", "u"}),
}
for _t in ("tbody", "thead", "tfoot"):
    _CLOSES[_t] = frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "p", "caption", "colgroup"})

# structural rank: an end tag never reaches past an open tag of a higher rank
_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190,
         "head": 200, "body": 200, "html": 220}


class _Node:
    __slots__ = ("tag", "attrs", "parent", "kinds", "nth", "pos", "end", "text_from", "text_to")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None, pos: int, text_from: int):
        self.tag, self.attrs, self.parent, self.pos, self.text_from = tag, attrs, parent, pos, text_from
        self.end, self.text_to = pos + 1, text_from
        self.kinds: dict[str, int] = {}
        self.nth = 1
        if parent is not None:
            self.nth = parent.kinds[tag] = parent.kinds.get(tag, 0) + 1

    def selector(self) -> str:
        parts: list[str] = []
        node = self
        while node is not None and node.tag not in ("html", "body"):
            if node.attrs.get("id"):
                parts.append("#" + node.attrs["id"])
                break
            alone = node.parent is None or node.parent.kinds[node.tag] == 1
            parts.append(node.tag if alone else f"{node.tag}:nth-of-type({node.nth})")
            node = node.parent
        return " > ".join(reversed(parts))


# A quote delimits a value only after an equals sign. Nothing here backtracks over what it has read.
_TOKEN = re.compile(r"""
    <!-- (?: >|->|.*?(?:-->|\Z) )
  | <[!?] [^>]*+ (?:>|\Z)
  | < (?P<end>/?) (?P<tag>[a-zA-Z][^\s/>]*+)
      (?P<body>(?: [^>"'=]++ | =\s*+"[^"]*+" | =\s*+'[^']*+' | ["'=] )*+) (?P<close>>|\Z)
""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I) for tag in ("script", "style")}


class _Page:
    """Flat document-order node list; a node spans [pos, end) nodes and [text_from, text_to) strings."""

    def __init__(self, html: str, max_depth: int | None = None) -> None:
        self.max_depth, self.cut = max_depth, False
        self.nodes: list[_Node] = []
        self.strings: list[str] = []
        self.open: list[_Node] = []
        self._pending: list[str] = []
        self._open_at: dict[str, list[int]] = {}  # tag -> depths at which it is open
        self._ranked_at: dict[int, list[int]] = {rank: [] for rank in set(_RANK.values())}
        self._unread = 0
        self._seen_head = self._seen_body = False
        self._read(html)
        self._flush()
        while self.open:
            self._pop()
        self._whole = "".join(self.strings)
        self._offsets = [0, *accumulate(map(len, self.strings))]

    def _read(self, html: str) -> None:
        at = 0
        while (token := _TOKEN.search(html, at)) is not None:
            if token.start() > at:
                self._pending.append(html[at:token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                self._flush()
            elif token["close"]:
                tag = tag.lower()
                if token["end"]:
                    self._end(tag)
                elif not self._begin(tag, token["body"]) and tag in _RAW_END:
                    at = _RAW_END[tag].search(html, at).start()
        self._pending.append(html[at:])

    # -- tags -------------------------------------------------------------
    def _begin(self, tag: str, body: str) -> bool:
        """Open an element; True if it is closed again at once."""
        attrs: dict[str, str] = {}
        read = 0
        for found in _ATTRIBUTE.finditer(body):
            read = found.end()
            name = found[1].lower()
            if name not in attrs:
                value = found[2] or found[3] or found[4] or ""
                if "&" in value:
                    value = unescape(value)
                attrs[name] = " ".join(value.split()) if name in _LIST_ATTRS else value
        closed = tag in _VOID or body[read:].rstrip().endswith("/")
        self._start(tag, attrs)
        if closed and tag not in ("html", "head", "body"):
            self._pop()
        return closed

    def _end(self, tag: str) -> None:
        if tag in _VOID or tag in ("html", "body"):
            return
        own = _RANK.get(tag, 100)
        barrier = max((at[-1] for rank, at in self._ranked_at.items() if rank > own and at), default=-1)
        if (at := self._open_at.get(tag)) and at[-1] > barrier:
            depth = at[-1]
            while len(self.open) > depth:
                self._pop()
            return
        if tag == "p":
            self._start("p", {})
            self._pop()

    # -- tree -------------------------------------------------------------
    def _flush(self) -> None:
        if not self._pending:
            return
        text = "".join(self._pending)
        self._pending.clear()
        if self._unread:
            return
        text = (unescape(text) if "&" in text else text).strip()
        if not text:
            return
        if not self.open or self.open[-1].tag in ("html", "head"):
            self._start("p", {})
        self.strings.append(text)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        self._flush()
        if tag in ("html", "head", "body"):
            if not self._outer(tag):
                return
        else:
            closes = _CLOSES.get(tag, ())
            while self.open and self.open[-1].tag in closes:
                self._pop()
            if tag in _HEAD and not self._seen_body:
                if not self._seen_head:
                    self._start("head", {})
            elif not self._seen_body:
                self._start("body", {})
            if self.max_depth is not None and len(self.open) >= self.max_depth:
                self.cut = True
                self._pop()
        node = _Node(tag, attrs, self.open[-1] if self.open else None, len(self.nodes), len(self.strings))
        self._open_at.setdefault(tag, []).append(len(self.open))
        if tag in _RANK:
            self._ranked_at[_RANK[tag]].append(len(self.open))
        self.nodes.append(node)
        self.open.append(node)
        self._unread += tag in _UNREAD

    def _outer(self, tag: str) -> bool:
        """Make room for html/head/body; False when that tag is already there."""
        if tag == "html":
            return not self.nodes
        if not self.nodes:
            self._start("html", {})
        if self._seen_body or (tag == "head" and self._seen_head):
            return False
        while len(self.open) > 1:
            self._pop()
        self._seen_head = True
        self._seen_body = tag == "body"
        return True

    def _pop(self) -> None:
        self._flush()
        node = self.open.pop()
        node.end, node.text_to = len(self.nodes), len(self.strings)
        self._open_at[node.tag].pop()
        if node.tag in _RANK:
            self._ranked_at[_RANK[node.tag]].pop()
        self._unread -= node.tag in _UNREAD

    # -- results ----------------------------------------------------------
    def full_text(self, node: _Node) -> str:
        return self._whole[self._offsets[node.text_from]:self._offsets[node.text_to]]

    def short_text(self, node: _Node, limit: int | None) -> str:
        start, end = self._offsets[node.text_from], self._offsets[node.text_to]
        return self._whole[start:end if limit is None else min(end, start + limit)]


def _elements(page: _Page, tags: frozenset[str], text_limit: int | None) -> list[dict]:
    return [{"doc_pos": n.pos, "tag": n.tag, "text": page.short_text(n, text_limit), "selector": n.selector(),
             "attributes": list(n.attrs.items()), "attributes_text": str(n.attrs)}
            for n in page.nodes if n.tag in tags]


_FIELDS = ("input", "select", "textarea")


def _forms(page: _Page) -> list[dict]:
    fields = [n for n in page.nodes if n.tag in _FIELDS]
    at = [n.pos for n in fields]
    inputs = [{"tag": n.tag, "name": n.attrs.get("name"), "type": n.attrs.get("type"),
               "placeholder": n.attrs.get("placeholder"), "required": "required" in n.attrs} for n in fields]
    return [{"action": form.attrs.get("action"), "method": form.attrs.get("method", "get"),
             "inputs": inputs[bisect_right(at, form.pos):bisect_left(at, form.end)]}
            for form in page.nodes if form.tag == "form"]


def _signals(page: _Page) -> dict:
    """What page types are told by: inputs, a submit button, the types of inputs in forms."""
    kinds, covered = set(), 0  # up to where the forms so far reach
    for n in page.nodes:
        if n.tag in _FIELDS and "type" in n.attrs and n.pos < covered:
            kinds.add(n.attrs["type"])
        elif n.tag == "form":
            covered = max(covered, n.end)
    return {"inputs": sum(n.tag == "input" for n in page.nodes),
            "submit": any(n.tag == "button" or n.tag in INTERACTIVE_TAGS and n.attrs.get("type") == "submit" for n in page.nodes),
            "form_inputs": sorted(kinds)}


def _tables(page: _Page) -> list[dict]:
    rows: dict[int, list[_Node]] = {n.pos: [] for n in page.nodes if n.tag == "table"}
    cells: dict[int, list[_Node]] = {}
    # the table and the row each node lies in, passed on from its parent
    in_table: list[int | None] = []
    in_row: list[int | None] = []
    for n in page.nodes:
        up = n.parent
        in_table.append(None if up is None else up.pos if up.tag == "table" else in_table[up.pos])
        in_row.append(None if up is None else up.pos if up.tag == "tr" else in_row[up.pos])
        if n.tag == "tr" and in_table[-1] is not None:
            rows[in_table[-1]].append(n)
            cells[n.pos] = []
        elif n.tag in ("td", "th") and in_row[-1] in cells:
            cells[in_row[-1]].append(n)
    out = []
    for table_rows in rows.values():
        grid = [(cells[r.pos], [page.full_text(c) for c in cells[r.pos]]) for r in table_rows]
        has_header = bool(grid) and bool(grid[0][0]) and all(c.tag == "th" for c in grid[0][0])
        out.append({"header": grid[0][1] if has_header else [],
                    "rows": [texts for _, texts in grid[has_header:]]})
    return out


def parse_page(html: str, parts: Iterable[str] = PARTS, tags: Iterable[str] = ELEMENT_TAGS,
               text_limit: int | None = TEXT_LIMIT, max_depth: int | None = None) -> dict:
    """Parse one page; ``parts`` limits what is built."""
    page = _Page(html, max_depth)
    record: dict = {}
    for part in parts:
        if part == "title":
            first = next((n for n in page.nodes if n.tag == "title"), None)
            record[part] = page.full_text(first) if first else ""
        elif part == "text":
            record[part] = " ".join(page.strings)
        elif part == "elements":
            record[part] = _elements(page, frozenset(tags), text_limit)
        elif part == "links":
            record[part] = [{"href": n.attrs["href"], "text": page.full_text(n)}
                            for n in page.nodes if n.tag == "a" and "href" in n.attrs]
        elif part == "forms":
            record[part] = _forms(page)
        elif part == "tables":
            record[part] = _tables(page)
        elif part == "signals":
            record[part] = _signals(page)
        elif part == "cut":
            record[part] = page.cut
        elif part == "nodes":
            record[part] = [{"pos": n.pos, "end": n.end, "up": None if n.parent is None else n.parent.pos, "nth": n.nth,
                             "tag": n.tag, "attributes": list(n.attrs.items())} for n in page.nodes]
    return record


def parsed_type(parts: Iterable[str] = PARTS) -> str:
    return "struct<" + ",".join(f"{p}:{_DDL[p]}" for p in parts) + ">"


def parse_html(html: Column | str, parts: Iterable[str] = PARTS, tags: Iterable[str] = ELEMENT_TAGS,
               text_limit: int | None = TEXT_LIMIT, max_depth: int | None = None) -> Column:
    """Column of parsed pages, a struct with the asked-for ``parts``; null html gives null.

    Element texts are cut at ``text_limit`` characters; None keeps them whole. ``max_depth`` bounds the nesting, off
    by default; the part ``cut`` marks the pages it changed.

    Marked non-deterministic so that the optimizer evaluates it once per page
    instead of repeating it below every filter and projection that reads it.
    """
    parts, tags = tuple(parts), tuple(tags)
    unknown = set(parts) - set(_DDL)
    if unknown:
        raise ValueError(f"unknown page parts: {sorted(unknown)}")
    arrow_type = pa.struct([(p, _ARROW[p]) for p in parts])

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if html is None else parse_page(html, parts, tags, text_limit, max_depth) for html in batch.to_pylist()],
                           type=arrow_type)

    # the evaluated hints tell Spark that this is an iterator-of-arrays UDF
    parse.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(parse, parsed_type(parts)).asNondeterministic()
    return udf(html)
