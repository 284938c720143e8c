"""Records from pages: a list selector and field selectors, evaluated for all pages at once.

A spec is made of Python objects and fixed when the plan is built. All fields of a spec
are found in one pass over the node rows of each page (see ``operators.dom``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import jsons
from folioflow.functions.clean import HTML_MARK, apply_replace_rules, clean_lines, plain_lines
from folioflow.functions.text import count_words, let, not_blank, regex_chain, strip_space, text_or_blank, tidy
from folioflow.functions.urls import abs_url
from folioflow.operators import dom
from folioflow.operators.search import make_hit
from folioflow.operators.shred import shred_html
from folioflow.session import settle, settle_by

# Attributes that hold links.
URL_ATTRS = {
    "href", "src", "url", "data-src", "data-original", "data-lazy-src", "poster", "action", "srcset",
}
HIT_FIELDS = ["name", "author", "kind", "word_count", "last_chapter", "intro", "cover_url", "book_url"]
# What can be taken of a node besides an attribute.
READERS = {"text", "own_text", "text_lines", "html", "outer_html"}
BOOK_FIELDS = ["name", "author", "kind", "last_chapter", "intro", "cover", "toc_url", "word_count", "status"]


@dataclass(frozen=True)
class Field:
    """Where a value stands, what to take there, and regex replacements on it."""

    steps: tuple[dom.Step, ...] = ()
    take: str = "text"  # text, own_text, text_lines, html, outer_html, or an attribute name
    regexes: tuple[tuple[str, str], ...] = ()
    index: int | None = None
    otherwise: Field | None = None  # used where this one is blank
    also: tuple[Field, ...] = ()  # further parts, whose values follow this one's
    weave: bool = False  # one value of each part in turn instead


@dataclass(frozen=True)
class Spec:
    """Fields of a record, and the selector of the list items for list pages.

    ``derived`` fields are computed from other fields after these are known. ``items`` is one selector, or ``dom.Items`` for
    several joined ones and for lists in descending order.
    """

    fields: dict[str, Field]
    items: tuple[dom.Step, ...] | dom.Items = ()
    derived: dict[str, Column] = field(default_factory=dict)


def shred_table(pages: DataFrame, html: str = "text") -> DataFrame:
    """Node rows written once to the shared folder, laid out by page, so that no page is parsed or moved twice."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), html).repartition(n, "page_id")
    return settle_by(shred_html(ready, html), "nodes", "page_id")


def _tries(name: str, f: Field | None) -> list[dict[str, Field]]:
    """The alternatives of a field in order, each as its parts by the name of their column."""
    out: list[dict[str, Field]] = []
    while f is not None:
        out.append({f"{name}#{len(out)}.{j}": part for j, part in enumerate((f, *f.also))})
        f = f.otherwise
    return out


def _reads(fields: dict[str, Field]) -> dict[str, tuple[tuple[dom.Step, ...], str]]:
    """What the pass over the nodes has to find and to take."""
    flat = {n: f for name, first in fields.items() for parts in _tries(name, first) for n, f in parts.items()}
    return {n: (f.steps if f.index is None else (*f.steps, dom.pick("eq", f.index)), f.take) for n, f in flat.items()}


def _values(f: Field, found: Column, page_url: Column) -> Column:
    """The values of one part, in document order: replacements on each, links completed, blank ones left out."""
    link, attribute = f.take in URL_ATTRS, f.take not in READERS

    def complete(v: Column) -> Column:
        return let(abs_url(page_url, v), lambda full: F.when((strip_space(v) != "") & (full != ""), full).otherwise(v))

    def one(x: Column) -> Column:
        v = tidy(x) if attribute and not link else x
        v = regex_chain(v, list(f.regexes)) if f.regexes else v
        return let(v, complete) if link else v

    values = F.transform(found, one) if attribute or f.regexes else found
    return F.filter(values, lambda x: x != "")


def _woven(lists: Column) -> Column:
    """One value of each list in turn, as long as any has one."""
    longest = F.aggregate(lists, F.lit(0), lambda n, x: F.greatest(n, F.size(x)))
    turns = F.transform(F.sequence(F.lit(0), longest), lambda i: F.array_compact(F.transform(lists, lambda x: F.get(x, i))))
    return F.flatten(turns)


def _texts(fields: dict[str, Field], found: Callable[[str], Column], page_url: Column) -> dict[str, Column]:
    """Each field's text: its first alternative that is not blank, parts joined by line feeds."""

    def text(parts: dict[str, Field]) -> Column:
        lists = [_values(f, found(n), page_url) for n, f in parts.items()]
        woven = next(iter(parts.values())).weave and len(lists) > 1
        return F.array_join(let(F.array(*lists), _woven) if woven else F.concat(*lists) if len(lists) > 1 else lists[0], "\n")

    tries = {name: [text(parts) for parts in _tries(name, f)] for name, f in fields.items()}
    # Each alternative stands in the expression once.
    return {name: F.coalesce(F.get(F.filter(F.array(*t), not_blank), F.lit(0)), F.lit("")) for name, t in tries.items()}


def var_fields(records: DataFrame, puts: dict[str, Column], gets: dict[str, Column]) -> DataFrame:
    """Two passes: variables are set first, then the fields that read them are computed."""
    return records.withColumns(puts).withColumns(gets).drop(*puts)


def _about(pages: DataFrame, *columns: str) -> DataFrame:
    return pages.select("page_id", *columns, F.col("final_url").alias("page_url"))


def _records(
    about: DataFrame, nodes: DataFrame, spec: Spec, one: bool = False, finish: dict[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """One row for each item: page_id, ctx, the columns of ``about`` and the fields of the spec, finished by a function each."""
    found = dom.records(nodes, _reads(spec.fields), spec.items, about, one)
    texts = _texts(spec.fields, lambda n: F.col(f"`{n}`"), F.col("page_url"))
    for n, f in (finish or {}).items():
        if n in texts:
            texts[n] = let(texts[n], f)
    # An array of one, taken apart again: what is built on a field refers to it and does not repeat its expression.
    record = F.explode(F.array(F.struct(*[c.alias(n) for n, c in texts.items()]))).alias("_r")
    rest = ["page_id", "ctx", "pos", *about.columns[1:]]
    out = found.select(*rest, record).select(*rest, "_r.*")
    return out.withColumns(spec.derived) if spec.derived else out


def extract_hits(pages: DataFrame, nodes: DataFrame, spec: Spec, limit: int | None = 60) -> DataFrame:
    """List pages to hits: blank names dropped, first ``limit`` per page in document order.

    ``pages``: page_id, source_id, source_name, final_url. The items of a page stay one row until they are numbered, so
    nothing is moved for it.
    """
    about = _about(pages, "source_id", "source_name")
    if "name" in spec.derived:
        named = _records(about, nodes, spec).filter(not_blank(F.col("name")))
        named = named.withColumn("item_pos", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
        named = named if limit is None else named.filter(F.col("item_pos") <= limit)
    else:
        found = dom.records(nodes, _reads(spec.fields), spec.items, about, nested=True)

        def record(x: Column) -> Column:
            texts = _texts(spec.fields, lambda n: x[n], F.col("page_url"))
            return F.struct(*[c.alias(n) for n, c in texts.items()])

        items = F.transform("items", record)
        if "name" in spec.fields:
            items = F.filter(items, lambda x: not_blank(x["name"]))
        items = items if limit is None else F.slice(items, 1, limit)
        named = found.select("page_id", *about.columns[1:], F.posexplode(items).alias("_i", "_r"))
        named = named.withColumn("item_pos", F.col("_i") + 1).select("page_id", *about.columns[1:], "item_pos", "_r.*").withColumns(spec.derived)
    for name in HIT_FIELDS:
        if name not in named.columns:
            named = named.withColumn(name, F.lit(""))
    return make_hit(named.drop("ctx", "pos"))


def extract_explore(pages: DataFrame, nodes: DataFrame, explore: Spec, search: Spec, limit: int = 30) -> DataFrame:
    """Category pages to hits; fields the explore spec lacks come from the search spec."""
    both = Spec({**search.fields, **explore.fields}, explore.items or search.items, {**search.derived, **explore.derived})
    return extract_hits(pages, nodes, both, limit)


def extract_json_hits(
    pages: DataFrame, items: Iterable[jsons.Step], fields: dict[str, list[jsons.Step]], limit: int = 60
) -> DataFrame:
    """JSON pages to hits: an array gives its items, an object is one item."""
    def items_of(found: Column) -> Column:
        only = F.when(F.size(found) == 1, F.try_variant_get(F.element_at(found, 1), "$", "array<variant>"))
        return F.coalesce(only, found)

    listed = let(jsons.json_path(jsons.parse_json_loose(F.col("text")), *items), items_of)
    rows = pages.select("page_id", "source_id", "source_name", F.col("final_url").alias("page_url"), F.posexplode(listed).alias("ctx", "_item"))
    values = {n: jsons.path_text(F.col("_item"), *steps) for n, steps in fields.items()}
    for n in HIT_FIELDS:
        values.setdefault(n, F.lit(""))
    hits = make_hit(rows.withColumns(values).drop("_item"))
    w = Window.partitionBy("page_id").orderBy("ctx")
    return hits.withColumn("item_pos", F.row_number().over(w)).filter(F.col("item_pos") <= limit).drop("ctx")


def extract_book(pages: DataFrame, nodes: DataFrame, spec: Spec) -> DataFrame:
    """Detail pages to the nine book fields. ``spec.items`` is the base of the fields, if given: its first match."""
    rows = _records(_about(pages, "source_id"), nodes, spec, one=True)

    def text(n: str) -> Column:
        return strip_space(text_or_blank(F.col(n))) if n in rows.columns else F.lit("")

    toc = abs_url(F.col("page_url"), text("toc_url"))
    special = {
        "cover": abs_url(F.col("page_url"), text("cover")),
        "toc_url": F.when(toc != "", toc).otherwise(F.col("page_url")),
    }
    return rows.select("page_id", "source_id", "page_url", *[special.get(n, text(n)).alias(n) for n in BOOK_FIELDS])


def follow_next(starts: DataFrame, links: DataFrame, max_pages: int | None = None, revisit_start: bool = False) -> DataFrame:
    """Pages reached from each start (start_id, url): start_id, page_no, url.

    ``links``: url, next_url; of several the smallest counts. Ends on a blank, self or visited link; with ``revisit_start`` a chain may
    pass its start once more. Pointers are doubled: round k knows where 2^k links lead, and with it the first 2^k pages of a
    chain give the next 2^k. A chain is done when it has ended or a page appears in it twice, which cuts it there; so
    there are about log2 of the longest chain's pages rounds, and no row carries the pages it has seen.
    """
    named = (text_or_blank(F.col("next_url")) != "") & (F.col("next_url") != F.col("url"))
    jumps = settle(links.filter(named).groupBy("url").agg(F.min("next_url").alias("next_url")), "jumps")
    front = settle(starts.select("start_id", F.lit(1).alias("page_no"), "url"), "follow")
    span, done = 1, []
    while True:
        more = front.join(jumps, "url").select("start_id", (F.col("page_no") + span).alias("page_no"), F.col("next_url").alias("url"))
        both = settle(front.unionByName(more), "follow")
        span *= 2
        counted = both.filter("page_no > 1") if revisit_start else both
        nth = F.row_number().over(Window.partitionBy("start_id", "url").orderBy("page_no"))
        again = counted.withColumn("_n", nth).filter("_n = 2").groupBy("start_id").agg(F.min("page_no").alias("_cut"))
        tops = both.groupBy("start_id").agg(F.max("page_no").alias("_top")).join(again, "start_id", "left")
        full = F.lit(False) if max_pages is None else F.lit(span >= max_pages)
        ended = settle(tops.filter(F.col("_cut").isNotNull() | (F.col("_top") < span) | full), "ended")
        kept = both.join(ended, "start_id").filter(F.col("_cut").isNull() | (F.col("page_no") < F.col("_cut")))
        done.append(kept.drop("_cut", "_top"))
        front = settle(both.join(ended, "start_id", "left_anti"), "follow")
        if front.isEmpty():
            break
        ahead = jumps.select(F.col("url").alias("next_url"), F.col("next_url").alias("_far"))
        jumps = settle(jumps.join(ahead, "next_url").select("url", F.col("_far").alias("next_url")), "jumps")
    out = reduce(DataFrame.unionByName, done)
    return out if max_pages is None else out.filter(F.col("page_no") <= max_pages)


def extract_toc(
    pages: DataFrame, nodes: DataFrame, spec: Spec, starts: DataFrame | None = None, next_link: Field | None = None, max_pages: int | None = None
) -> DataFrame:
    """Chapter rows of contents pages, in page order.

    ``pages``: page_id, book_id, page, final_url. Fields: title, url, and optionally
    is_volume_text. Feed the result to ``dedupe_chapters`` and ``number_chapters``. A list in descending order has
    ``dom.Items`` with ``reverse``; several of its pages then follow each other from the last to the first.

    With ``starts`` (book_id, url) and ``next_link`` the pages of a book are those that its first page leads to, and numbered
    in that order; ``pages`` then need no book_id and page.
    """
    whole = {"title": strip_space, "url": lambda v: abs_url(F.col("page_url"), v)}
    plain = {n: f for n, f in whole.items() if n not in spec.derived}
    rows = _records(_about(pages, *[c for c in ("book_id", "page") if c in pages.columns]), nodes, spec, finish=plain)
    rows = rows.withColumns({n: f(F.col(n)) for n, f in whole.items() if n in spec.derived})
    flag = F.col("is_volume_text") if "is_volume_text" in rows.columns else F.lit("")
    turned = isinstance(spec.items, dom.Items) and spec.items.reverse
    if starts is not None and next_link is not None:
        order = follow_next(starts.select(F.col("book_id").alias("start_id"), "url"), next_links(pages, nodes, next_link), max_pages)
        order = order.select(F.col("start_id").alias("book_id"), F.col("page_no").alias("page"), F.col("url").alias("page_url"))
        rows = rows.drop("book_id", "page").join(order, "page_url")
    page = -F.col("page") if turned else F.col("page")
    return rows.select("book_id", page.alias("page"), "pos", "title", "url", flag.alias("is_volume_text"))


def next_links(pages: DataFrame, nodes: DataFrame, link: Field) -> DataFrame:
    """The next page that each page names (url, next_url), where it names one."""
    rows = _records(_about(pages), nodes, Spec({"next_url": link}))
    return rows.select(F.col("page_url").alias("url"), "next_url").filter("next_url <> ''")


def toc_warnings(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Books whose first contents page gave no chapter."""
    first = pages.filter(F.col("page") == 1).select("book_id").distinct()
    return first.join(rows.filter(F.col("page") == 1), "book_id", "left_anti").select(
        "book_id", F.lit("目录规则未匹配到任何章节，请检查 chapterList 规则").alias("warning")
    )


def clean_html(fragments: DataFrame, aliases: Callable[[], list[Column]] = list, replace_rules: str = "") -> DataFrame:
    """Clean texts (page_id, text) with or without markup: page_id, content."""
    ready = fragments.withColumn("text", apply_replace_rules(text_or_blank(F.col("text")), replace_rules))
    # Few fragments have markup; they are written once, because the rest of the work reads them more than once.
    marked = settle(ready.filter(F.col("text").rlike(HTML_MARK)), "marked")
    plain = ready.filter(~F.col("text").rlike(HTML_MARK)).withColumn("lines", plain_lines(F.col("text")))
    rich = dom.records(shred_table(marked), {"lines": ((), "lines")}, about=marked.drop("text"), one=True).drop("ctx", "pos")
    # A fragment without an id has no nodes and so no lines.
    lost = marked.filter("page_id is null").drop("text").withColumn("lines", F.array().cast("array<string>"))
    both = plain.drop("text").unionByName(rich).unionByName(lost)
    return both.withColumn("content", clean_lines(F.col("lines"), aliases())).drop("lines")


def extract_content(
    pages: DataFrame, nodes: DataFrame, content: tuple[dom.Step, ...], title: Field | None = None, replace_rules: str = ""
) -> DataFrame:
    """Chapter pages to clean text, per (book_id, idx) over all its pages in order.

    ``pages``: page_id, book_id, idx, page, final_url, chapter_title, book_name.
    """
    chapter = ["book_id", "idx"]
    about = _about(pages, *chapter, "page", "chapter_title", "book_name")
    titles = {} if title is None else {"title": title}
    # The rules work on markup, so with them the chosen parts are written out and read again.
    found = dom.records(nodes, {"found": (content, "html" if replace_rules else "lines"), **_reads(titles)}, about=about, one=True)
    texts = _texts(titles, lambda n: F.col(f"`{n}`"), F.col("page_url")) if titles else {"title": F.lit("")}
    rows = found.select("page_id", *about.columns[1:], texts["title"].alias("title"), "found")
    if replace_rules:
        html = apply_replace_rules(F.array_join("found", "\n"), replace_rules)
        parts = settle(rows.withColumn("text", html).drop("found"), "parts")
        rows = dom.records(shred_table(parts), {"found": ((), "lines")}, about=parts.drop("text"), one=True)
    joined = rows.groupBy(*chapter).agg(
        F.sort_array(F.collect_list(F.struct("page", "found"))).alias("ps"),
        F.count("*").cast("int").alias("pages"),
        F.min_by("page_url", "page").alias("url"),
        F.min_by("chapter_title", "page").alias("chapter_title"),
        F.min_by("book_name", "page").alias("book_name"),
        F.coalesce(F.min_by("title", F.when(text_or_blank(F.col("title")) != "", F.col("page"))), F.lit("")).alias("title"),
    )
    flat = F.flatten(F.transform("ps", lambda p: p["found"]))
    text = clean_lines(flat, [F.col("chapter_title"), F.col("title"), F.col("book_name")])
    out = joined.withColumn("_found", F.size(flat) > 0).withColumn("content", text)
    return out.select(
        *chapter, "content", "title", count_words(F.col("content")).alias("words"), "pages", "url",
        F.when(~F.col("_found"), "正文规则未匹配到内容（可能是站点结构变化或需要登录）")
        .when(F.col("content") == "", "正文清洗后为空，可能被站点反爬或规则失效")
        .otherwise("").alias("error"),
    )
