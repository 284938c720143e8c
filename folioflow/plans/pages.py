"""Pages: landing, node rows, selectors, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import jsons
from folioflow.operators import dom, extract
from folioflow.operators import library as lib
from folioflow.plans.columns import AD_SQL, SP, clean_author_sql, strip_sql
from folioflow.plans.library import DEDUPED, toc_rows
from folioflow.plans.registry import query
from folioflow.plans.views import load, sql_for
from folioflow.schemas import RAW_PAGES
from folioflow.session import settle
from folioflow.sources import landing

# Landing ----------------------------------------------------------------------------


@query("scan_pages", "select page_id, url, length(html) as chars from pages")
def scan_pages(spark, d):
    rows = landing.scan_pages(spark, f"{d}/pages.parquet", RAW_PAGES)
    return rows.select("page_id", "url", F.length("html").cast("long").alias("chars"))


@query("decode_pages", "select page_id, md5(html) as text from pages")
def decode_pages(spark, d):
    form = F.col("page_id") % 4
    utf8 = F.encode("html", "UTF-8")
    body = (
        F.when(form == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .when(form == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")))
        .otherwise(utf8)
    )
    kind = F.when(form == 2, "text/html; Charset='UTF8'").otherwise("text/html")
    raw = load(spark, d, "pages").select("page_id", body.alias("body"), kind.alias("content_type"), F.lit("").alias("charset"))
    return landing.decode_pages(raw).select("page_id", F.md5("text").alias("text"))


@query("classify_fetch", sql_for("page_rows", body="select page_id, case when status = 404 then 'UPSTREAM_NOT_FOUND' when status = 429 then 'UPSTREAM_ERROR' else '' end as error_code, case when status = 404 then concat('书源站点返回 404：该页面不存在或已失效（', final_url, '）') when status = 429 then '请求过于频繁（HTTP 429），请降低并发或稍后重试' else '' end as error from page_rows"))
def classify_fetch(spark, d):
    rows = load(spark, d, "page_rows").withColumn("server", F.lit(""))
    return landing.classify_fetch(rows).select("page_id", "error_code", "error")


# Node rows --------------------------------------------------------------------------


def nodes_of(spark, d):
    return extract.shred_table(load(spark, d, "page_rows").select("page_id", "text"))


def found(nodes, sep="\n", **fields):
    """One text column per field: steps and what to take there."""
    rows = dom.records(nodes, {n: (steps, take) for n, (*steps, take) in fields.items()})
    return rows.select("page_id", *[F.array_join(n, sep).alias(n) for n in fields])


def counts(nodes, **sets):
    """Sizes of several node sets per page."""
    rows = dom.records(nodes, {n: (steps, "") for n, steps in sets.items()})
    return rows.select("page_id", *[F.size(n).cast("long").alias(n) for n in sets])


def inside(tag=None, cls=None):
    return dom.inside(dom.match(tag, cls))


def unescape_sql(x: str) -> str:
    for name, char in [("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{char}')"
    return x


def text_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({unescape_sql(x)}, '[{SP}]+', ' ', 'g')")


def n_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(html, '{pattern}'))"


H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"
FOOTER = "regexp_extract(html, '(?s)<footer>(.*?)(?:</footer>|</body>|$)', 1)"
LI = "regexp_extract_all(html, '<li><a href=\"[^\"]*\">(.*?)</a>', 1)"
HREF = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


@query("shred_html", f"select page_id, {n_sql('<p[ >]')} as p, {n_sql('<li[ >]')} as li, {n_sql('<a ')} as a, {n_sql('<br')} as br, {n_sql('<!--')} as notes, {text_sql(H1)} as h1 from pages")
def shred_html(spark, d):
    nodes = nodes_of(spark, d)
    tags = {t: (inside(t),) for t in ("p", "li", "a", "br")}
    rows = dom.records(nodes, {**{n: (steps, "") for n, steps in tags.items()}, "h1": ((inside("h1"),), "text")})
    notes = nodes.groupBy("page_id").agg(F.count_if(F.col("kind") == "comment").alias("notes"))
    sizes = [F.size(t).cast("long").alias(t) for t in tags]
    return rows.select("page_id", *sizes, F.array_join("h1", "\n").alias("h1")).join(notes, "page_id")


@query("node_text", f"select page_id, {text_sql(H1)} as h1, {text_sql(FOOTER)} as footer from pages")
def node_text(spark, d):
    return found(nodes_of(spark, d), h1=(inside("h1"), "text"), footer=(inside("footer"), "text"))


@query("node_own_text", f"select page_id, {text_sql(FOOTER)} as footer, repeat('|', len({LI}) - 1) as li from pages")
def node_own_text(spark, d):
    nodes = nodes_of(spark, d)
    rows = dom.records(nodes, {"footer": ((inside("footer"),), "own_text"), "li": ((inside("li"),), "own_text")})
    return rows.select("page_id", F.array_join("footer", "\n").alias("footer"), F.array_join("li", "|").alias("li"))


@query("node_text_lines", f"select page_id, {unescape_sql(f'array_to_string({LI}, chr(10))')} as menu from pages")
def node_text_lines(spark, d):
    return found(nodes_of(spark, d), menu=(inside("ul"), "text_lines"))


@query("node_attr", f"select page_id, {unescape_sql(f'array_to_string({HREF}, chr(10))')} as links from pages")
def node_attr(spark, d):
    return found(nodes_of(spark, d), links=(inside("a"), "href"))


@query("node_html", "select page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) as inner_html, regexp_extract(html, '<h1>.*?</h1>') as outer_html from pages")
def node_html(spark, d):
    return found(nodes_of(spark, d), inner_html=(inside("nav"), "html"), outer_html=(inside("h1"), "outer_html"))


@query("sel_simple", f"select page_id, {n_sql('<div class=.ad.>')} as ads, 1 as articles, {n_sql('<[a-z]')} as every from pages")
def sel_simple(spark, d):
    sizes = counts(nodes_of(spark, d), ads=(inside(cls="ad"),), articles=(inside("article"),), every=(inside("*"),))
    return sizes.withColumn("articles", F.col("articles").cast("int"))


@query("sel_attr", f"select page_id, len({HREF}) as has_href, len(list_filter({HREF}, lambda x: starts_with(x, '/t'))) as starts, len(list_filter({HREF}, lambda x: ends_with(x, 'e'))) as ends, len(list_filter({HREF}, lambda x: contains(x, 'an'))) as holds, len(list_filter({HREF}, lambda x: x <> '/the')) as differs, cast(0 as bigint) as empty_operand, {n_sql('<html lang=.')} as lang from pages")
def sel_attr(spark, d):
    nodes = nodes_of(spark, d)
    tests = {
        "has_href": ("href",), "starts": ("href", "^=", "/t"), "ends": ("href", "$=", "e"), "holds": ("href", "*=", "an"),
        "differs": ("href", "!=", "/the"), "empty_operand": ("href", "*=", ""), "lang": ("lang",),
    }
    return counts(nodes, **{
        n: (dom.inside(dom.match("a" if t[0] == "href" else "html") & dom.attr_match(*t)),) for n, t in tests.items()
    })


@query("sel_combinators", f"select page_id, {n_sql('<a ')} as inside_a, {n_sql('<li[ >]')} as child_li, {n_sql('<li[ >]')} - 1 as next_li, {n_sql('<li[ >]')} - 1 as later_li, {n_sql('<a ')} + 1 as either, cast(0 as bigint) as none from pages")
def sel_combinators(spark, d):
    li = dom.match("li")
    sizes = counts(
        nodes_of(spark, d),
        inside_a=(inside("nav"), dom.inside(li), inside("a")),
        child_li=(inside("ul"), dom.child(li)),
        next_li=(dom.inside(li), dom.next_to(li)),
        later_li=(dom.inside(li), dom.later(li)),
        either=(dom.inside(dom.match("a") | dom.match("h1")),),
        none=(inside("nav"), dom.child(dom.match("a"))),
    )
    return sizes


@query("sel_positional", f"select page_id, {unescape_sql(f'{LI}[1]')} as first_li, {unescape_sql(f'{LI}[-1]')} as last_li, {unescape_sql(f'array_to_string(list_filter({LI}, lambda x, i: i % 2 = 1), chr(10))')} as odd_li, {unescape_sql(f'array_to_string({LI}[3:], chr(10))')} as from_third, {unescape_sql(f'{LI}[-2]')} as second_back from pages")
def sel_positional(spark, d):
    place, back = F.col("elem_index") + 1, F.col("n_elems") - F.col("elem_index")
    tests = {
        "first_li": F.col("elem_index") == 0,
        "last_li": F.col("type_index") == F.col("n_type"),
        "odd_li": dom.nth(place, 2, 1),
        "from_third": dom.nth(place, 1, 3),
        "second_back": dom.nth(back, 0, 2),
    }
    return found(nodes_of(spark, d), **{n: (dom.inside(dom.match("li") & t), "text") for n, t in tests.items()})


@query("sel_set", f"select page_id, cast(1 as bigint) as eq1, cast(1 as bigint) as eq_last, least(2, len({LI})) as lt2, greatest(len({LI}) - 3, 0) as gt2, cast(ceil(len({LI}) / 2.0) as bigint) as even, len({LI}) // 2 as odd, len({LI}) - 1 as without_first from pages")
def sel_set(spark, d):
    ops = {"eq1": ("eq", 1), "eq_last": ("eq", -1), "lt2": ("lt", 2), "gt2": ("gt", 2), "even": ("even",), "odd": ("odd",), "without_first": ("not_eq", 0)}
    return counts(nodes_of(spark, d), **{n: (inside("li"), dom.pick(*op)) for n, op in ops.items()})


@query("sel_filters", f"select page_id, len({LI}) - 1 as not_first, cast(1 as bigint) as has_a, len(list_filter({LI}, lambda x: contains({unescape_sql('x')}, 'an'))) as holds, cast(1 as bigint) as root, {n_sql('<br')} + {n_sql('<meta')} as empty from pages")
def sel_filters(spark, d):
    leaf = dom.match("br") | dom.match("meta") | dom.match("title")
    first = dom.inside(dom.match("li") & (F.col("elem_index") == 0))
    return counts(
        nodes_of(spark, d),
        not_first=(inside("li"), dom.without(first)),
        has_a=(inside("ul"), dom.has(dom.match("a"))),
        holds=(inside("li"), dom.contains("an")),
        root=(dom.inside(dom.is_root()),),
        empty=(dom.inside(leaf), dom.empty()),
    )


@query("children_step", f"select page_id, {n_sql('<li[ >]')} as of_ul, cast(2 as bigint) as of_html from pages")
def children_step(spark, d):
    every = dom.child(F.lit(True))
    return counts(nodes_of(spark, d), of_ul=(inside("ul"), every), of_html=(inside("html"), every))


@query("self_step", "select page_id, cast(1 as bigint) as with_self, cast(0 as bigint) as below from pages")
def self_step(spark, d):
    ul = dom.match("ul")
    return counts(nodes_of(spark, d), with_self=(dom.inside(ul), dom.self_inside(ul)), below=(dom.inside(ul), dom.inside(ul)))


BARE = unescape_sql("regexp_replace(l, '<[^>]+>', '', 'g')")
LINE = f"regexp_replace(regexp_replace({BARE}, '[\\t\\r\\n\\f]+', ' ', 'g'), ' {{2,}}', ' ', 'g')"
ARTICLE = {
    "art": "select page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as body, regexp_extract(html, '<h1>(.*?)</h1>', 1) as h1 from pages",
    "cut": "select page_id, h1, unnest(ls) as l, unnest(range(1, len(ls) + 1)) as n from (select page_id, h1, regexp_split_to_array(body, '</?(?:p|br|h1|div|li|ul)(?: [^>]*)?/?>') as ls from art) a",
    "lines": f"select page_id, n, {strip_sql(LINE)} as s, {text_sql('h1')} as title from cut",
}


@query("block_lines", sql_for(extra=ARTICLE, body="select page_id, count(*) as line_count, md5(string_agg(s, chr(10) order by n)) as content from lines where s <> '' group by page_id"))
def block_lines(spark, d):
    lines = dom.block_lines(nodes_of(spark, d), steps=(inside("article"),))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("page_id").agg(
        F.count("*").alias("line_count"), F.md5(F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("content")
    )


@query("extract_content", sql_for(extra={
    **ARTICLE,
    "good": f"select *, s = title or regexp_replace(s, '[{SP}]', '', 'g') = regexp_replace(title, '[{SP}]', '', 'g') as is_alias from lines where s <> '' and not (length(s) <= 80 and ({AD_SQL}))",
    "counted": "select *, coalesce(sum(case when is_alias then 0 else 1 end) over (partition by page_id order by n rows between unbounded preceding and 1 preceding), 0) as before from good",
    "texts_": "select page_id, string_agg(s, chr(10) order by n) as content from counted where not is_alias or before > 1 group by page_id",
}, body=f"select page_id as book_id, md5(coalesce(content, '')) as content, {text_sql('h1')} as title, cast(1 as int) as pages, case when content is null then '正文清洗后为空，可能被站点反爬或规则失效' else '' end as error from art left join texts_ using (page_id)"))
def extract_content(spark, d):
    nodes = nodes_of(spark, d)
    pages = load(spark, d, "page_rows").select(
        "page_id", F.col("page_id").alias("book_id"), F.lit(0).alias("idx"), F.lit(1).alias("page"), "final_url",
        F.lit("").alias("chapter_title"), F.lit("").alias("book_name"),
    )
    title = extract.Field((dom.inside(dom.match("h1")),))
    out = extract.extract_content(pages, nodes, (dom.inside(dom.match("article")),), title)
    return out.select("book_id", F.md5("content").alias("content"), "title", "pages", "error")


# Extraction: list, detail, contents and JSON pages made from the hits ----------------

ITEM = """concat('<li class="item x"><h3 class=name><a href="', book_url, '">', name, '</a></h3><p class="author">', author, '<p class="kind">', kind, '<div class="more"><img data-src="', cover_url, '"><i>', last_chapter, '</i></div></li>')"""


def list_pages(spark, d):
    """List pages of 20 hits, as a site would serve them."""
    hits, s = load(spark, d, "hits"), load(spark, d, "sources")
    rows = hits.withColumn("p", F.floor((F.col("item_pos") - 1) / 20)).groupBy("source_id", "p").agg(
        F.sort_array(F.collect_list(F.struct("item_pos", F.expr(ITEM).alias("h")))).alias("items")
    )
    html = F.concat(F.lit("<html><body><ul class=list>\n"), F.array_join(F.transform("items", lambda x: x["h"]), "\n"), F.lit("</ul></body></html>"))
    return rows.join(s.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "url"), "source_id").select(
        (F.col("source_id") * 1_000_000 + F.col("p")).alias("page_id"), "source_id", "source_name", "p",
        F.concat("url", F.lit("/list/"), F.col("p").cast("string"), F.lit(".html")).alias("final_url"), html.alias("text"),
    )


def list_spec():
    return extract.Spec(
        items=(inside("ul", "list"), inside("li", "item")),
        fields={
            "name": extract.Field((inside(cls="name"), inside("a"))),
            "author": extract.Field((inside("p", "author"),)),
            "kind": extract.Field((inside(cls="kind"),), regexes=(("^", "k:"),)),
            "book_url": extract.Field((inside("a"),), "href", index=0),
            "cover_url": extract.Field((inside("img"),), "src", otherwise=extract.Field((inside("img"),), "data-src")),
            "last_chapter": extract.Field((inside(cls="more"), dom.child(dom.match("i")))),
        },
    )


HIT_SQL = f"select h.source_id, cast((h.item_pos - 1) % 20 + 1 as int) as item_pos, h.name, {clean_author_sql('h.author')} as author, concat('k:', h.kind) as kind, concat(s.url, h.book_url) as book_url, case when h.cover_url = '' then '' else concat(s.url, h.cover_url) end as cover_url, h.last_chapter from hits h join sources s on s.id = h.source_id"
HIT_COLUMNS = ["source_id", "item_pos", "name", "author", "kind", "book_url", "cover_url", "last_chapter"]


@query("extract_hits", sql_for("hits", "sources", body=HIT_SQL))
def extract_hits(spark, d):
    pages = list_pages(spark, d)
    nodes = extract.shred_table(pages)
    return extract.extract_hits(pages, nodes, list_spec()).select(*HIT_COLUMNS)


@query("extract_explore", sql_for("hits", "sources", extra={"h": HIT_SQL}, body="select source_id, item_pos, name, author, replace(kind, 'k:', 'x:') as kind, book_url, cover_url, last_chapter from h where item_pos <= 15"))
def extract_explore(spark, d):
    pages = list_pages(spark, d)
    nodes = extract.shred_table(pages)
    explore = extract.Spec(fields={"kind": extract.Field((inside("p", "kind"),), regexes=(("^", "x:"),))})
    return extract.extract_explore(pages, nodes, explore, list_spec(), limit=15).select(*HIT_COLUMNS)


@query("extract_json_hits", sql_for("hits", "sources", extra={"h": HIT_SQL}, body="select source_id, item_pos, name, author, replace(kind, 'k:', '') as kind, book_url, cover_url, last_chapter from h"))
def extract_json_hits(spark, d):
    hits, s = load(spark, d, "hits"), load(spark, d, "sources")
    item = F.to_json(F.struct("name", "author", "kind", F.col("book_url").alias("url"), F.col("cover_url").alias("cover"), F.col("last_chapter").alias("last")))
    rows = hits.withColumn("p", F.floor((F.col("item_pos") - 1) / 20)).groupBy("source_id", "p").agg(
        F.sort_array(F.collect_list(F.struct("item_pos", item.alias("j")))).alias("items")
    )
    body = F.concat(F.lit('cb({"code":0,"data":{"list":['), F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("]}});"))
    pages = rows.join(s.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "url"), "source_id").select(
        (F.col("source_id") * 1_000_000 + F.col("p")).alias("page_id"), "source_id", "source_name",
        F.concat("url", F.lit("/api")).alias("final_url"), body.alias("text"),
    )
    fields = {"name": "name", "author": "author", "kind": "kind", "book_url": "url", "cover_url": "cover", "last_chapter": "last"}
    out = extract.extract_json_hits(
        pages, [jsons.key("data"), jsons.key("list")], {n: [jsons.key(k)] for n, k in fields.items()}
    )
    return out.select(*HIT_COLUMNS)


@query("extract_book", sql_for("books", "sources", body="select b.id as page_id, b.name, b.author, b.intro, concat(s.url, '/cover/', b.id, '.jpg') as cover, case when b.toc_url = '' then concat(s.url, b.book_url) else b.toc_url end as toc_url, '' as status from books b join sources s on s.id = b.source_id"))
def extract_book(spark, d):
    s = load(spark, d, "sources").select(F.col("id").alias("source_id"), "url")
    html = F.concat(
        F.lit("<div id=other><h1>wrong</h1></div><div id=info><h1>"), "name", F.lit("</h1><p class=by> "), "author",
        F.lit("</p><p class=intro>"), "intro", F.lit('</p><img src="/cover/'), F.col("id").cast("string"), F.lit('.jpg"><a class=toc href="'),
        "toc_url", F.lit('">list</a></div>'),
    )
    pages = load(spark, d, "books").join(s, "source_id").select(
        F.col("id").alias("page_id"), "source_id", F.concat("url", "book_url").alias("final_url"), html.alias("text")
    )
    spec = extract.Spec(
        items=(dom.inside(dom.match(id="info")),),
        fields={
            "name": extract.Field((inside("h1"),)),
            "author": extract.Field((inside(cls="by"),)),
            "intro": extract.Field((inside(cls="intro"),)),
            "cover": extract.Field((inside("img"),), "src"),
            "toc_url": extract.Field((inside("a", "toc"),), "href"),
        },
    )
    out = extract.extract_book(pages, extract.shred_table(pages), spec)
    return out.select("page_id", "name", "author", "intro", "cover", "toc_url", "status")


TOC_SQL = "select book_id, cast(row_number() over (partition by book_id order by page, pos) - 1 as int) as idx, title, case when url = '' then '' else concat('https://t.example.com', url) end as url, is_volume from kept"
TOC_ROW = """concat('<dd data-v="', is_volume_text, '"><a href="', url, '">', title, '</a></dd>')"""


def toc_fields():
    return {
        "title": extract.Field((inside("a"),)),
        "url": extract.Field((inside("a"),), "href"),
        "is_volume_text": extract.Field((dom.self_inside(dom.match("dd")),), "data-v"),
    }


def numbered(found):
    return lib.number_chapters(lib.dedupe_chapters(found)).select("book_id", "idx", "title", "url", "is_volume")


@query("extract_toc", sql_for("hits", extra=DEDUPED, body=TOC_SQL))
def extract_toc(spark, d):
    rows = toc_rows(spark, d)
    pages = rows.groupBy("book_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", F.expr(TOC_ROW).alias("h")))).alias("r"))
    pages = pages.select(
        (F.col("book_id") * 1_000_000 + F.col("page")).alias("page_id"), "book_id", "page",
        F.lit("https://t.example.com/toc.html").alias("final_url"),
        F.concat(F.lit("<dl>"), F.array_join(F.transform("r", lambda x: x["h"]), ""), F.lit("</dl>")).alias("text"),
    )
    spec = extract.Spec(items=(inside("dl"), inside("dd")), fields=toc_fields())
    return numbered(extract.extract_toc(pages, extract.shred_table(pages), spec))


@query("toc_descending", sql_for("hits", extra=DEDUPED, body=TOC_SQL))
def toc_descending(spark, d):
    """The newest chapters come first, in two lists that take turns, and each page links to the one before it."""
    rows = toc_rows(spark, d).withColumn("h", F.expr(TOC_ROW))
    sides = [F.sort_array(F.collect_list(F.when(F.col("pos") % 2 == k, F.struct("pos", "h")))) for k in (1, 0)]
    pages = rows.groupBy("book_id", "page").agg(sides[0].alias("odd"), sides[1].alias("even"), F.max("pos").alias("top"))
    pages = settle(pages, "toc-pages")
    before = pages.alias("p").join(pages.select("book_id", F.col("page").alias("lower")).alias("q"), "book_id").filter("lower < page")
    before = before.groupBy("book_id", "page").agg(F.max("lower").alias("lower"))
    linked = pages.join(before, ["book_id", "page"], "left")

    def address(page):
        return F.concat(F.lit("/"), F.col("book_id").cast("string"), F.lit("/"), page.cast("string"), F.lit(".html"))

    def listed(side):
        return F.array_join(F.transform(F.reverse(side), lambda x: x["h"]), "")

    # The chapter with the highest place is the first of the page, so it starts the two lists that take turns.
    left, right = F.when(F.col("top") % 2 == 1, listed("odd")).otherwise(listed("even")), F.when(F.col("top") % 2 == 1, listed("even")).otherwise(listed("odd"))
    more = F.coalesce(F.concat(F.lit('<a class=next href="'), address(F.col("lower")), F.lit('">more</a>')), F.lit(""))
    site = F.lit("https://t.example.com")
    pages = linked.select(
        (F.col("book_id") * 1_000_000 + F.col("page")).alias("page_id"), F.concat(site, address(F.col("page"))).alias("final_url"),
        F.concat(F.lit("<dl class=a>"), left, F.lit("</dl><dl class=b>"), right, F.lit("</dl>"), more).alias("text"),
    )
    starts = linked.groupBy("book_id").agg(F.max("page").alias("page")).select("book_id", F.concat(site, address(F.col("page"))).alias("url"))
    pages = settle(pages, "toc-pages")
    lists = dom.Items(((inside("dl", "a"), inside("dd")), (inside("dl", "b"), inside("dd"))), "weave", reverse=True)
    spec = extract.Spec(items=lists, fields=toc_fields())
    link = extract.Field((inside("a", "next"),), "href", index=0)
    return numbered(extract.extract_toc(pages, extract.shred_table(pages), spec, starts, link))


@query("var_fields", sql_for("hits", body="select source_id, item_pos, concat('/read', book_url) as book_url, name from hits"))
def var_fields(spark, d):
    out = extract.var_fields(
        load(spark, d, "hits"),
        puts={"v_link": F.col("book_url")},
        gets={"book_url": F.concat(F.lit("/read"), F.col("v_link"))},
    )
    return out.select("source_id", "item_pos", "book_url", "name")


@query("follow_next", sql_for("chapters", body="select book_id as start_id, cast(idx + 1 as int) as page_no, concat('/', book_id, '/', idx) as url from chapters where idx < 30"))
def follow_next(spark, d):
    # The last page of each chain links back to its first.
    c = load(spark, d, "chapters").select("book_id", "idx")
    last = c.groupBy("book_id").agg(F.max("idx").alias("last"))

    def link(i):
        return F.concat(F.lit("/"), F.col("book_id").cast("string"), F.lit("/"), i.cast("string"))

    links = c.join(last, "book_id").select(
        link(F.col("idx")).alias("url"), link(F.when(F.col("idx") == F.col("last"), F.lit(0)).otherwise(F.col("idx") + 1)).alias("next_url")
    )
    starts = c.filter(F.col("idx") == 0).select(F.col("book_id").alias("start_id"), link(F.col("idx")).alias("url"))
    return extract.follow_next(starts, links, 30)
