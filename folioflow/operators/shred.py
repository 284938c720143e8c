"""Pages to node rows: the only step that reads markup.

Each page becomes one row per node with its place in document order (``pre``), the end of
its subtree (``last``), its parent, its depth and its place among its siblings. A node's
ancestors are the nodes whose pre..last it lies in, so nothing grows with the depth.
Selectors and text extraction are interval joins over these rows (see ``operators.dom``).
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.entities import unescape
from folioflow.schemas import NODES

# Elements without content.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr", "basefont", "frame",
}
# Elements whose content is text only.
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe"}
# Elements whose text is not part of a page's text.
HIDDEN = {"script", "style", "noscript", "template"}
# Elements that chapter text skips.
SKIPPED = {"script", "style", "noscript", "iframe", "svg", "button", "select", "textarea", "ins"}
# Elements that end an open paragraph.
BLOCK = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
    "table", "ul", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "center",
    "dir", "listing", "plaintext", "xmp", "summary",
}
# Elements ended by a sibling of the same name.
SAME = {
    "li", "p", "dt", "dd", "option", "optgroup", "tr", "td", "th", "thead", "tbody",
    "tfoot", "a", "h1", "h2", "h3", "h4", "h5", "h6", "rt", "rp", "colgroup", "caption",
}
# Open element -> elements whose start ends it.
ROW_ENDS = {"tr", "thead", "tbody", "tfoot"}
ENDED_BY = {
    "p": BLOCK,
    "td": ROW_ENDS, "th": ROW_ENDS, "tr": ROW_ENDS,
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "tfoot": {"tbody"},
    "dt": {"dd"}, "dd": {"dt"}, "option": {"optgroup"},
}
# Nodes in an Arrow batch.
FLUSH_NODES = 50_000

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[^>]*)>"
    r"|<(?P<tag>[A-Za-z][A-Za-z0-9]*)(?=[\s/>]|\Z)(?P<attrs>(?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?", re.S)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


# What is special about an element, as bits.
IS_VOID, IS_HIDDEN, IS_SKIPPED, IS_RAW = 1, 2, 4, 8
SPECIAL = {
    tag: IS_VOID * (tag in VOID) | IS_HIDDEN * (tag in HIDDEN) | IS_SKIPPED * (tag in SKIPPED) | IS_RAW * (tag in RAW)
    for tag in VOID | HIDDEN | SKIPPED | RAW
}
# Open element and the element whose start ends it.
ENDS = {(top, tag) for top, tags in ENDED_BY.items() for tag in tags} | {(tag, tag) for tag in SAME}
# Groups of a token.
COMMENT, CDATA, CLOSE, TAG_ATTRS = 1, 2, 3, 5
# Places in a node row and in an entry of the open-element stack.
LAST, TAG, N_ELEMS, N_TYPE = 2, 6, 14, 16
S_PRE, S_TAG, S_HIDE, S_SKIP, S_COUNT, S_PREV, S_TYPES = range(7)
# Longest attribute text that is remembered; most repeat from element to element.
SHORT = 100


def _attributes(attrs: str) -> tuple[list[tuple[str, str]], bool]:
    """Names and values of an element's attributes, the first of a name, and whether a slash closes the element."""
    seen: dict[str, str] = {}
    slashes = attrs.count("/")
    for name, a, b, c in ATTR.findall(attrs):
        value = a or b or c
        slashes -= value.count("/") if slashes else 0
        seen.setdefault(name.lower(), unescape(value))
    return list(seen.items()), slashes > 0 and ATTR.sub("", attrs).rstrip().endswith("/")


_remembered = lru_cache(4096)(_attributes)


def page_nodes(page_id: int, html: str) -> list[list]:
    """The node rows of one page; a row holds the columns of ``NODES`` in order."""
    rows: list[list] = []
    elements: list[list] = []
    top: list = [0, "", -1, -1, 0, None, {}]
    stack = [top]
    n_open: dict[str, int] = {}
    ended, at, size = False, 0, len(html)
    search, special, get_open = TOKEN.search, SPECIAL.get, n_open.get
    while True:
        m = search(html, at)
        start = m.start() if m else size
        if start > at:
            raw = html[at:start]
            if len(stack) > 1 or raw.strip():
                # A stray "<" is a text node of its own.
                for part in re.split("(<)", raw) if "<" in raw else (raw,):
                    if part and (len(stack) > 1 or part.strip()):
                        pre = len(rows) + 1
                        part = unescape(part) if "&" in part else part
                        rows.append([page_id, pre, pre, top[0], len(stack), "text", None, None, part, None, None, ended, top[2], top[3], None, None, None])
                        ended = False
        if not m:
            break
        at, kind = m.end(), m.lastindex
        if kind == TAG_ATTRS:
            tag, attrs = m.group(4, 5)
            tag = tag.lower()
            while (top[S_TAG], tag) in ENDS:
                n_open[top[S_TAG]] -= 1
                rows[top[S_PRE] - 1][LAST] = len(rows)
                stack.pop()
                top = stack[-1]
                ended = True
            facts = special(tag, 0)
            if attrs:
                items, closed = _remembered(attrs) if len(attrs) <= SHORT else _attributes(attrs)
            else:
                items, closed = [], False
            pre = len(rows) + 1
            hide = pre if facts & IS_HIDDEN else top[S_HIDE]
            skip = pre if facts & IS_SKIPPED else top[S_SKIP]
            types = top[S_TYPES]
            same = types[tag] = types.get(tag, 0) + 1
            # The counts of all siblings are filled in when the page is done.
            row = [page_id, pre, pre, top[S_PRE], len(stack), "element", tag, items, None, top[S_COUNT], top[S_PREV], None, hide, skip, top, same, None]
            rows.append(row)
            elements.append(row)
            top[S_COUNT] += 1
            top[S_PREV] = pre
            if closed or facts & IS_VOID:
                ended = True
                continue
            top = [pre, tag, hide, skip, 0, None, {}]
            stack.append(top)
            n_open[tag] = get_open(tag, 0) + 1
            if not facts & IS_RAW:
                continue
            end = RAW_END[tag].search(html, at)
            raw = html[at : end.start() if end else size]
            if raw:
                pre = len(rows) + 1
                rows.append([page_id, pre, pre, top[0], len(stack), "text", None, None, raw, None, None, ended, top[2], top[3], None, None, None])
                ended = False
            at = end.end() if end else size
        elif kind == CLOSE:
            words = re.split(r"[\s/]", m[CLOSE].strip(), maxsplit=1)
            tag = words[0].lower()
        else:
            if kind == COMMENT:
                pre = len(rows) + 1
                rows.append([page_id, pre, pre, top[0], len(stack), "comment", None, None, m[COMMENT], None, None, None, top[2], top[3], None, None, None])
            elif kind == CDATA and m[CDATA] and (len(stack) > 1 or m[CDATA].strip()):
                raw = m[CDATA]
                for part in re.split("(<)", raw) if "<" in raw else (raw,):
                    if part and (len(stack) > 1 or part.strip()):
                        pre = len(rows) + 1
                        rows.append([page_id, pre, pre, top[0], len(stack), "text", None, None, unescape(part), None, None, ended, top[2], top[3], None, None, None])
                        ended = False
            continue
        # An end, of this element or of the innermost open one of that name.
        if tag and get_open(tag):
            while True:
                done = stack.pop()
                n_open[done[S_TAG]] -= 1
                rows[done[S_PRE] - 1][LAST] = len(rows)
                if done[S_TAG] == tag:
                    break
            top = stack[-1]
            ended = True
    for done in stack[1:]:
        rows[done[S_PRE] - 1][LAST] = len(rows)
    for row in elements:
        siblings = row[N_ELEMS]
        row[N_ELEMS], row[N_TYPE] = siblings[S_COUNT], siblings[S_TYPES][row[TAG]]
    return rows


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(NODES)


def shred_html(pages: DataFrame, html: str = "text") -> DataFrame:
    """Node rows of each page (page_id, html). One narrow stage, no shuffle, and no bound on the depth.

    Page ids are unique; a page without an id has no nodes.
    """

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()

        def pack(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema
            )

        rows: list[list] = []
        # Rows form no cycles, and looking for some costs more than reading the markup.
        collecting = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                for page_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows.extend(page_nodes(page_id, text or ""))
                    if len(rows) >= FLUSH_NODES:
                        yield pack(rows)
                        rows = []
            if rows:
                yield pack(rows)
        finally:
            if collecting:
                gc.enable()

    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(html)).filter("page_id is not null")
    return ready.mapInArrow(shred, NODES)
