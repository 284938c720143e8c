"""Selectors and texts over node rows, as one interval join per page partition.

Nodes are brought together by page and put in document order once. There all steps of all fields run as array operations
over whole pages (``operators.intervals``), and what was asked for comes out: node sets, values, lines, or one record for each
page or list item. Tests on nodes are columns, evaluated before and handed on as bits. A node table that was written
by ``extract.shred_table`` is laid out by page, so that its nodes move no further; other frames are exchanged once.

A node set is a frame of (page_id, ctx, pre): the selected nodes ``pre`` of a page, found
for the context ``ctx`` (a list item, or 0 for the whole page).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import escape_html, strip_space
from folioflow.operators.intervals import Events, NodeSet, Pages, Texts, picked
from folioflow.operators.shred import VOID

KEY = ["page_id", "ctx", "pre"]
# Nodes that a task takes up at once, in whole pages.
CHUNK = 100_000
# Elements that break lines.
LINE_BLOCKS = [
    "p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "section",
    "article", "blockquote", "pre", "dd", "dt", "figure", "figcaption", "header",
    "footer", "hr", "table", "ul", "ol", "center", "form",
]


# Tests on one node ------------------------------------------------------------------


def attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name.lower()], F.lit(""))


def has_class(name: str) -> Column:
    # Most elements fail the cheap first test.
    return attr("class").contains(name) & F.array_contains(F.split(attr("class"), r"\s+"), name)


def match(tag: str | None = None, cls: str | list[str] | None = None, id: str | None = None) -> Column:
    """Tag, class tokens and id of an element; nothing given matches every element."""
    test = F.lit(True)
    if tag and tag != "*":
        test = test & (F.col("tag") == tag)
    for c in [cls] if isinstance(cls, str) else cls or []:
        test = test & has_class(c)
    if id:
        test = test & (attr("id") == id)
    return test


def attr_match(name: str, op: str | None = None, value: str = "") -> Column:
    """Attribute tests: present, ``= != ^= $= *= ~= |=``; an empty operand never matches ^ $ * ~."""
    a, v = attr(name), F.lit(value)
    if op is None:
        return F.map_contains_key(F.col("attrs"), name.lower())
    if op in ("^=", "$=", "*=", "~=") and not value:
        return F.lit(False)
    return {
        "=": a == v,
        "!=": a != v,
        "^=": a.startswith(value),
        "$=": a.endswith(value),
        "*=": a.contains(value),
        "~=": F.array_contains(F.split(a, r"\s+"), value),
        "|=": (a == v) | a.startswith(value + "-"),
    }[op]


def is_root() -> Column:
    return F.col("parent") == 0


def nth(position: Column, a: int, b: int) -> Column:
    """``an+b`` on a 1-based position; odd is (2, 1), even is (2, 0)."""
    if a == 0:
        return position == b
    k = (position - b) / F.lit(a)
    return (k >= 0) & (k == F.floor(k))


def with_positions(elements: DataFrame) -> DataFrame:
    """Elements with their sibling counts: ``n_elems``, ``type_index`` (1-based) and ``n_type``; see ``nth``.

    Node rows have them from the start, so tests of steps can use them as well.
    """
    return elements


# Steps ------------------------------------------------------------------------------


class Step(NamedTuple):
    """One selector step: where to look from a node and what to keep there, or a filter of what was found so far."""

    axis: str  # inside, self_inside, child, next, later; has, lacks, empty, contains, without, pick
    test: Column | None = None
    op: str = ""
    n: int = 0
    stop: int | None = None
    needle: str = ""
    steps: tuple = ()


def inside(test: Column) -> Step:
    return Step("inside", test)


def self_inside(test: Column) -> Step:
    return Step("self_inside", test)


def child(test: Column) -> Step:
    return Step("child", test)


def next_to(test: Column) -> Step:
    return Step("next", test)


def later(test: Column) -> Step:
    return Step("later", test)


def has(test: Column) -> Step:
    """Nodes with a descendant that passes the test."""
    return Step("has", test)


def lacks(test: Column) -> Step:
    """Nodes without a descendant that passes the test."""
    return Step("lacks", test)


def empty() -> Step:
    """Nodes without child elements and without text."""
    return Step("empty", (F.col("kind") == "element") | ((F.col("kind") == "text") & (strip_space(F.col("text")) != "")))


def contains(needle: str) -> Step:
    """Nodes whose text contains the needle."""
    return Step("contains", needle=needle)


def without(*steps: Step) -> Step:
    """Nodes that these steps do not find from the page as a whole."""
    return Step("without", steps=tuple(steps))


def pick(op: str, n: int = 0, stop: int | None = None) -> Step:
    """Positions in document order among what was found for a context: eq, not_eq, lt, gt, first, last, even, odd, slice."""
    return Step("pick", op=op, n=n, stop=stop)


def elements_of(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "element")


def page_context(nodes: DataFrame) -> DataFrame:
    """Every page as its own context."""
    return nodes.select("page_id").distinct().select("page_id", F.lit(0).alias("ctx"), F.lit(0).alias("pre"))


# The pass over whole pages ----------------------------------------------------------


class _Plan:
    """Tests of the steps by bit, and the node columns that the pass needs."""

    def __init__(self) -> None:
        self.tests: list[Column] = []
        self.columns: dict[str, Column] = {}

    def bit(self, test: Column, elements: bool = True) -> int:
        self.tests.append((F.col("kind") == "element") & test if elements else test)
        return len(self.tests) - 1

    def steps(self, steps: tuple[Step, ...]) -> list[tuple]:
        """Steps without columns, for the tasks."""
        out = []
        for s in steps:
            if s.axis == "contains":
                self.need_text()
            bit = None if s.test is None else self.bit(s.test, s.axis != "empty")
            out.append((s.axis, bit, s.op, s.n, s.stop, s.needle, self.steps(s.steps)))
        return out

    def need_text(self) -> None:
        self.columns["text"] = F.when(F.col("kind") == "text", F.col("text"))
        self.columns["gap"] = F.coalesce("gap", F.lit(False))
        self.columns["hide"] = F.coalesce("hide", F.lit(-1))

    def take(self, take: str) -> tuple[str, int | None]:
        """A way to read nodes, and the bit it needs."""
        if take in ("text", "own_text", "text_lines"):
            self.need_text()
            return take, self.bit(F.lit(True)) if take == "text_lines" else None
        if take in ("html", "outer_html"):
            self.columns |= {"depth": F.col("depth"), "head": _opening(), "tail": _closing()}
            return take, None
        if take == "lines":
            part = F.when(F.col("kind") == "text", F.col("text")).when((F.col("tag") == "img") & (F.length(attr("alt")) > 1), attr("alt"))
            self.columns |= {"depth": F.col("depth"), "part": part, "skip": F.coalesce("skip", F.lit(-1))}
            return take, self.bit(F.col("tag").isin(*LINE_BLOCKS))
        if take != "":
            self.columns[f"attr:{take}"] = F.when(F.col("kind") == "element", attr(take))
        return take, None

    def flags(self) -> dict[str, Column]:
        """The tests as bits of long columns."""
        out = {}
        for lo in range(0, len(self.tests), 60):
            bits = [F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(self.tests[lo : lo + 60])]
            total = bits[0].cast("long")
            for b in bits[1:]:
                total = total + b
            out[f"flags:{lo // 60}"] = total
        return out


def _opening() -> Column:
    pairs = F.transform(
        F.map_entries("attrs"),
        lambda e: F.when(e["value"] == "", F.concat(F.lit(" "), e["key"])).otherwise(
            F.concat(F.lit(" "), e["key"], F.lit('="'), escape_html(e["value"]), F.lit('"'))
        ),
    )
    return (
        F.when(F.col("kind") == "text", escape_html(F.col("text")))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))
        .otherwise(F.concat(F.lit("<"), F.col("tag"), F.array_join(pairs, ""), F.lit(">")))
    )


def _closing() -> Column:
    closes = (F.col("kind") == "element") & ~F.col("tag").isin(*VOID)
    return F.when(closes, F.concat(F.lit("</"), F.col("tag"), F.lit(">"))).otherwise("")


class _Chunk:
    """Whole pages in a task: their rows by column, and the marks that came with them."""

    def __init__(self, table: pa.Table):
        mark = table.column("mark_ctx").combine_chunks() if "mark_ctx" in table.column_names else None
        self.marks = self.blank = None
        if mark is not None:
            self.marks = table.filter(mark.is_valid())
            table = table.filter(mark.is_null())
        if table.column("pre").null_count:
            self.blank, table = table.filter(table.column("pre").is_null()), table.filter(table.column("pre").is_valid())
        self.table = table.combine_chunks()
        self.page_id = self.ints("page_id")
        self.pages = Pages(self.page_id, *(self.ints(c) for c in ("pre", "last", "parent", "prev")))
        if (self.ints("n_rows") != (self.pages.stop - self.pages.first)[self.pages.page_no]).any():
            raise ValueError("a page is not whole")
        self._texts: Texts | None = None
        self._events: Events | None = None
        self._rows: dict[int, np.ndarray] = {}

    def ints(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy().astype(np.int64)

    def strings(self, name: str) -> list:
        return self.table.column(name).to_pylist()

    def rows(self, bit: int) -> np.ndarray:
        """Rows that pass a test."""
        if bit not in self._rows:
            self._rows[bit] = np.flatnonzero(self.ints(f"flags:{bit // 60}") >> (bit % 60) & 1)
        return self._rows[bit]

    @property
    def texts(self) -> Texts:
        if self._texts is None:
            text = self.table.column("text").combine_chunks()
            rows = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
            some = pa.array(rows)
            hide = self.ints("hide")[rows]
            gap = self.table.column("gap").take(some).to_numpy()
            self._texts = Texts(self.pages, rows, text.take(some).to_pylist(), gap, np.where(hide > 0, self.pages.base[rows] + hide, -1))
        return self._texts

    @property
    def events(self) -> Events:
        if self._events is None:
            self._events = Events(self.pages, self.ints("depth"))
        return self._events

    def follow(self, s: NodeSet, steps: list[tuple]) -> NodeSet:
        p = self.pages
        for axis, bit, op, n, stop, needle, inner in steps:
            if axis == "pick":
                s = picked(s, op, n, stop)
            elif axis == "contains":
                s = s.only(np.array([needle in t for t in self.texts.whole(s.at)], bool))
            elif axis == "without":
                s = s.only(~p.is_in(s, self.follow(p.roots(), inner)))
            elif axis == "has":
                s = s.only(p.holds(s, self.rows(bit)))
            elif axis in ("lacks", "empty"):
                s = s.only(~p.holds(s, self.rows(bit)))
            elif axis in ("inside", "self_inside"):
                s = p.inside(s, self.rows(bit), axis == "self_inside")
            elif axis in ("child", "next", "later"):
                s = getattr(p, axis)(s, self.rows(bit))
            else:
                raise ValueError(f"unknown axis: {axis}")
        return s

    def read(self, at: np.ndarray, take: str, bit: int | None) -> list:
        """Values of places; lists of numbered lines for ``lines``, nothing for a blank ``take``."""
        if take == "":
            return [""] * len(at)
        if take == "text":
            return self.texts.whole(at)
        if take == "own_text":
            return self.texts.own(at)
        if take == "text_lines":
            return self.texts.lines(at, self.rows(bit))
        if take in ("html", "outer_html"):
            return self.events.markup(at, self.strings("head"), self.strings("tail"), take == "outer_html")
        if take == "lines":
            cut = np.zeros(len(self.page_id), bool)
            cut[self.rows(bit)] = True
            skip = self.ints("skip")
            parts = [x or "" for x in self.strings("part")]
            return self.events.lines(at, parts, cut, np.where(skip > 0, self.pages.base + skip, -1))
        values = self.table.column(f"attr:{take}").combine_chunks()
        some = values.take(pa.array(np.maximum(at, 0))).to_pylist() if len(at) else []
        return ["" if a < 0 or v is None else v for a, v in zip(at.tolist(), some)]

    def page_ids(self, at: np.ndarray) -> np.ndarray:
        return self.page_id[self.pages.first[self.pages.page_of(at)]] if len(at) else np.zeros(0, np.int64)

    def pre(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < 0, 0, at - self.pages.base[np.maximum(at, 0)]) if len(at) else at

    def marked(self) -> tuple[NodeSet, np.ndarray]:
        """The marks as a node set, and the frame's number of each of its contexts."""
        page, ctx, pre = (self.marks.column(c).to_numpy().astype(np.int64) for c in ("page_id", "mark_ctx", "mark_pre"))
        ids = self.page_id[self.pages.first]
        order = np.argsort(ids, kind="stable")
        at = np.minimum(np.searchsorted(ids[order], page), len(ids) - 1)
        known = ids[order][at] == page if len(ids) else np.zeros(len(page), bool)
        page, ctx, pre = order[at[known]] if len(ids) else page[known], ctx[known], pre[known]
        place = np.where(pre == 0, -1 - page, self.pages.first[page] + pre - 1) if len(page) else pre
        # A page as a whole has a negative place and so stands before its rows.
        keys, number = np.unique(np.stack([page, ctx], 1), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([number.ravel(), place], 1), axis=0)
        return NodeSet(pairs[:, 0], pairs[:, 1]), keys[:, 1]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Chunk]:
    """Rows that come page by page, cut into whole pages of about ``size`` rows."""
    held: list[pa.RecordBatch] = []
    n, limit = 0, size
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= limit:
            table = pa.Table.from_batches(held)
            page = table.column("page_id").to_numpy()
            done = np.flatnonzero(page != page[-1])
            cut = int(done[-1]) + 1 if len(done) else 0
            if cut:
                yield _Chunk(table.slice(0, cut))
                held = table.slice(cut).to_batches()
            n = len(table) - cut
            limit = max(size, 2 * n)
    if n:
        yield _Chunk(pa.Table.from_batches(held))


def _with_about(rows: DataFrame, about: DataFrame, keep_pages: bool) -> DataFrame:
    """Columns by page on the first row of each page. Joins leave rows in their order, and nodes are never the side that moves."""
    more = [c for c in about.columns if c != "page_id"]
    named = about.select(F.col("page_id").cast("long").alias("page_id"), *[F.col(c).alias(f"about:{c}") for c in more])
    if keep_pages:
        joined = named.hint("merge").join(rows, "page_id", "left")
    else:
        limit = _bytes_of(about.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
        size = int(str(named._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        joined = rows.join(F.broadcast(named) if size <= limit else named.hint("merge"), "page_id")
    first = F.coalesce(F.col("pre") == 1, F.lit(True))
    return joined.select(*rows.columns, *[F.when(first, F.col(f"about:{c}")).alias(f"about:{c}") for c in more])


def _bytes_of(setting: str) -> int:
    """A size as Spark writes it in settings: a number with or without a unit."""
    digits = setting.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:], 0)
    return int(digits.rstrip("kmgt")) << unit


def _pass(
    nodes: DataFrame, plan: _Plan, schema: T.StructType, solve: Callable[[_Chunk], list], marks: DataFrame | None = None,
    about: DataFrame | None = None, keep_pages: bool = False, size: int = CHUNK,
) -> DataFrame:
    """Run ``solve``, which gives the columns of ``schema``, over whole pages of nodes.

    ``marks``: node set frame that comes along; ``about``: columns by page_id, on the first row of each page; with ``keep_pages``
    pages of ``about`` without nodes come as well.
    """
    rows = nodes.select(
        "page_id", "pre", "last", "parent", F.coalesce("prev_elem", F.lit(0)).alias("prev"),
        *[c.alias(n) for n, c in (plan.flags() | plan.columns).items()],
    )
    if marks is not None:
        one = marks.select(F.col("page_id").cast("long").alias("page_id"), F.col("ctx").cast("int").alias("mark_ctx"), F.col("pre").alias("mark_pre")).distinct()
        rows = rows.unionByName(one, allowMissingColumns=True)
    # The window keeps pages whole and in order, whatever the plan does before it, and needs no exchange where they lie together.
    whole = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("n_rows", F.count("last").over(whole))
    if about is not None:
        rows = _with_about(rows, about.filter("page_id is not null"), keep_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for chunk in _chunks(batches, size):
            columns = solve(chunk)
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, target)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return rows.mapInArrow(run, schema)


class Items(NamedTuple):
    """List items of a page: one or several selectors, how their lists are combined, and whether the order is turned."""

    parts: tuple[tuple[Step, ...], ...]
    combine: str = "concat"  # one list after the other, weave (one of each in turn) or first (the first that is not empty)
    reverse: bool = False


def _listed(chunk: _Chunk, paths: list[list[tuple]], combine: str, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items in list order, page by page, and their numbers in their page. An item found twice counts once."""
    found = [chunk.follow(chunk.pages.roots(), path) for path in paths]
    page = np.concatenate([s.ctx for s in found])
    at = np.concatenate([s.at for s in found])
    part = np.repeat(np.arange(len(found)), [len(s.at) for s in found])
    rank = np.concatenate([s.sizes()[0] for s in found])
    order = np.lexsort((part, rank, page) if combine == "weave" else (rank, part, page))
    if combine == "first":
        least = np.full(len(chunk.pages.first), len(found))
        np.minimum.at(least, page, part)
        order = order[part[order] == least[page[order]]]
    _, firsts = np.unique(at[order], return_index=True)
    order = order[np.sort(firsts)]
    at, page = at[order], page[order]
    number, size = NodeSet(page, at).sizes()
    if reverse:
        order = np.lexsort((-number, page))
        at, page = at[order], page[order]
        number, size = NodeSet(page, at).sizes()
    return at, number


def records(
    nodes: DataFrame, fields: dict[str, tuple[tuple[Step, ...], str]], items: tuple[Step, ...] | Items = (), about: DataFrame | None = None,
    one: bool = False, nested: bool = False, size: int = CHUNK,
) -> DataFrame:
    """One row for each page, or for each list item: page_id, ctx, pos, the columns of ``about``, and an array of texts for each field.

    ``pos`` counts the items of a page in list order.

    A field is steps from the item (or page) and what to take there: text, own_text, text_lines, html, outer_html, lines, a blank
    for nothing but the count, or an attribute name. With ``one`` every page of ``about`` has one row: of its first item, or blank.
    With ``nested`` the items of a page are one row, an array ``items`` of structs of ctx and the fields.
    """
    plan = _Plan()
    listed = items if isinstance(items, Items) else Items((tuple(items),) if items else ())
    paths, combine, reverse = [plan.steps(p) for p in listed.parts], listed.combine, listed.reverse
    reads = [(plan.steps(steps), *plan.take(take)) for steps, take in fields.values()]
    more = [] if about is None else [f for f in about.schema.fields if f.name != "page_id"]
    schema = T.StructType(
        [T.StructField("page_id", T.LongType()), T.StructField("ctx", T.IntegerType()), T.StructField("pos", T.IntegerType()), *more]
        + [T.StructField(n, T.ArrayType(T.StringType())) for n in fields]
    )
    if nested:
        inner = T.StructType([schema["ctx"], *schema.fields[3 + len(more) :]])
        schema = T.StructType([schema["page_id"], *more, T.StructField("items", T.ArrayType(inner))])
    names, parts = [f"about:{f.name}" for f in more], ["ctx", *fields]

    def solve(chunk: _Chunk) -> list:
        p = chunk.pages
        start, number = p.roots(), np.zeros(len(p.first), np.int64)
        if paths:
            at, number = _listed(chunk, paths, combine, reverse)
            at, number = (at[number == 0], number[number == 0]) if one else (at, number)
            start = NodeSet(np.arange(len(at)), at)
        page = p.page_of(start.at)
        firsts = pa.array(p.first[page]) if len(page) else pa.array([], pa.int64())
        columns: list = [chunk.page_ids(start.at), chunk.pre(start.at), number]
        columns += [chunk.table.column(n).combine_chunks().take(firsts) for n in names]
        for steps, take, bit in reads:
            s = chunk.follow(start, steps)
            values, ctx = chunk.read(s.at, take, bit), s.ctx
            if take == "lines":
                ctx = np.repeat(ctx, [len(v) for v in values]) if values else ctx
                values = [line for v in values for _, line in v]
            offsets = np.searchsorted(ctx, np.arange(len(start.at) + 1))
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.string())))
        if one:
            columns = _with_blanks(chunk, page, columns, names)
        if nested:
            structs = pa.StructArray.from_arrays([pa.array(columns[1], pa.int32()), *columns[3 + len(names) :]], names=parts)
            offsets = np.searchsorted(page, np.arange(len(p.first) + 1))
            heads = [chunk.table.column(n).combine_chunks().take(pa.array(p.first)) for n in names]
            return [chunk.page_id[p.first], *heads, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)]
        return columns

    return _pass(nodes, plan, schema, solve, about=about, keep_pages=one, size=size)


def _with_blanks(chunk: _Chunk, page: np.ndarray, columns: list, names: list[str]) -> list:
    """Further rows for pages without an item and without nodes."""
    left = np.setdiff1d(np.arange(len(chunk.pages.first)), page)
    rows = chunk.table.take(pa.array(chunk.pages.first[left])) if len(left) else chunk.table.slice(0, 0)
    parts = [rows] if chunk.blank is None else [rows, chunk.blank.select(rows.column_names)]
    rows = pa.concat_tables(parts).combine_chunks()
    n = rows.num_rows
    blanks = [rows.column("page_id"), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64()), *[rows.column(c) for c in names]]
    out = []
    for c, b in zip(columns, [*blanks, *[None] * len(columns)]):
        c = c if isinstance(c, pa.Array) else pa.array(c)
        b = pa.array([[]] * n, c.type) if b is None else b.combine_chunks() if isinstance(b, pa.ChunkedArray) else b
        out.append(pa.concat_arrays([c, b.cast(c.type)]))
    return out


# Node sets --------------------------------------------------------------------------

_SET = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("ctx", T.IntegerType()), T.StructField("pre", T.IntegerType())])


def sel_simple(nodes: DataFrame, test: Column) -> DataFrame:
    """Elements of whole pages that pass a test."""
    return elements_of(nodes).filter(test).select("page_id", F.lit(0).alias("ctx"), "pre")


def select(nodes: DataFrame, *steps: Step) -> DataFrame:
    """Nodes that steps find from the page as a whole."""
    return _found(nodes, None, steps)


def sel_path(nodes: DataFrame, start: DataFrame, *steps: Step) -> DataFrame:
    """Follow steps from the start nodes; the result is distinct per context."""
    return _found(nodes, start, steps)


def _found(nodes: DataFrame, start: DataFrame | None, steps: tuple[Step, ...]) -> DataFrame:
    plan = _Plan()
    path, from_pages = plan.steps(steps), start is None

    def solve(chunk: _Chunk) -> list:
        s, ctx = (chunk.pages.roots(), None) if from_pages else chunk.marked()
        s = chunk.follow(s, path)
        return [chunk.page_ids(s.at), np.zeros(len(s.at), np.int64) if ctx is None else ctx[s.ctx], chunk.pre(s.at)]

    return _pass(nodes, plan, _SET, solve, marks=start)


def sel_any(*sets: DataFrame) -> DataFrame:
    """Union of selector groups."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def sel_not(nodes_set: DataFrame, excluded: DataFrame) -> DataFrame:
    return nodes_set.join(excluded.select("page_id", "pre"), ["page_id", "pre"], "left_anti").select(*KEY)


def sel_has(nodes: DataFrame, nodes_set: DataFrame, test: Column) -> DataFrame:
    """Nodes with a descendant that passes the test."""
    return sel_path(nodes, nodes_set, has(test))


def sel_contains(nodes: DataFrame, nodes_set: DataFrame, needle: str) -> DataFrame:
    return sel_path(nodes, nodes_set, contains(needle))


def sel_empty(nodes: DataFrame, nodes_set: DataFrame) -> DataFrame:
    """Nodes without child elements and without text."""
    return sel_path(nodes, nodes_set, empty())


def sel_set(nodes_set: DataFrame, op: str, n: int = 0) -> DataFrame:
    """Set positions per context in document order: eq, lt, gt, first, last, even, odd, not_eq."""
    by = Window.partitionBy("page_id", "ctx")
    i = F.row_number().over(by.orderBy("pre")) - 1
    back = F.row_number().over(by.orderBy(F.desc("pre")))
    rows = nodes_set.withColumn("_i", back if op == "last" or (op in ("eq", "not_eq") and n < 0) else i)
    at = F.col("_i")
    size = F.count("*").over(by)
    test = {
        "eq": at == (-n if n < 0 else n),
        "not_eq": at != (-n if n < 0 else n),
        "lt": at < max(0, n),
        "gt": at > n,
        "first": at == 0,
        "last": at == 1,
        "even": at % 2 == 0,
        "odd": at % 2 == 1,
    }[op]
    if op == "gt" and n < -1:
        return rows.withColumn("_size", size).filter(at >= F.col("_size") + n + 1).select(*KEY)
    return rows.filter(test).select(*KEY)


def children_step(nodes: DataFrame, nodes_set: DataFrame) -> DataFrame:
    """Direct element children."""
    return sel_path(nodes, nodes_set, child(F.lit(True)))


# Values -----------------------------------------------------------------------------


def _values(nodes: DataFrame, targets: DataFrame, take: str) -> DataFrame:
    plan = _Plan()
    way = plan.take(take)
    schema = T.StructType([_SET[0], _SET[2], T.StructField("value", T.StringType())])

    def solve(chunk: _Chunk) -> list:
        s, _ = chunk.marked()
        return [chunk.page_ids(s.at), chunk.pre(s.at), chunk.read(s.at, *way)]

    places = targets.select("page_id", F.lit(0).alias("ctx"), "pre")
    values = _pass(nodes, plan, schema, solve, marks=places)
    return targets.join(values, ["page_id", "pre"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def node_text(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Text of each node: visible descendant text, element ends as blanks, blanks collapsed."""
    return _values(nodes, targets, "text")


def node_own_text(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Text that stands directly in each node."""
    return _values(nodes, targets, "own_text")


def node_text_lines(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """One line per direct text or child element."""
    return _values(nodes, targets, "text_lines")


def node_attr(nodes: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """Attribute of each node, blank when missing."""
    values = elements_of(nodes).select("page_id", "pre", attr(name).alias("value"))
    return targets.join(values, ["page_id", "pre"])


def node_html(nodes: DataFrame, targets: DataFrame, outer: bool = False) -> DataFrame:
    """Markup of each node, written again with escaping."""
    return _values(nodes, targets, "outer_html" if outer else "html")


_LINES = T.StructType([_SET[0], _SET[2], T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])


def block_lines(nodes: DataFrame, targets: DataFrame | None = None, steps: tuple[Step, ...] = ()) -> DataFrame:
    """Lines of the text under each target (page_id, ctx, pre): page_id, pre, line_no, line.

    Without targets the nodes that ``steps`` find, or whole pages. Block elements and br end a line; skipped elements
    give nothing; an image without content gives its alternative text. Lines are numbered by a running count of ends.
    """
    plan = _Plan()
    path, way, from_pages = plan.steps(steps), plan.take("lines"), targets is None

    def solve(chunk: _Chunk) -> list:
        s = chunk.follow(chunk.pages.roots() if from_pages else chunk.marked()[0], path)
        found = chunk.read(s.at, *way)
        at = np.repeat(s.at, [len(v) for v in found]) if found else s.at
        lines = [x for v in found for x in v]
        return [chunk.page_ids(at), chunk.pre(at), [n for n, _ in lines], [t for _, t in lines]]

    marks = None if targets is None else targets.select("page_id", F.lit(0).alias("ctx"), "pre")
    return _pass(nodes, plan, _LINES, solve, marks=marks)
