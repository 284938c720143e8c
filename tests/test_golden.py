"""Known values on literal rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import codec, jsons, lists, ranking, text, urls
from folioflow.functions.clean import clean_plain
from folioflow.functions.entities import unescape
from folioflow.operators import alternatives, catalog, dom, extract, health, library, merge, search
from folioflow.operators.shred import page_nodes
from folioflow.sources import definitions, landing, requests


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x)


# Merge ------------------------------------------------------------------------------

SPELLINGS = [
    ("斗破苍穹", "天蚕土豆", "A"), ("《斗破苍穹》", "天蚕土豆", "B"), ("斗破苍穹", "作者：天蚕土豆", "C"),
    ("斗破 苍穹", "天蚕土豆 著", "D"), ("斗破苍穹", "", "E"), ("斗破苍穹", "天蚕土豆 漫画组", "F"),
    ("斗破苍穹之秋雨", "某甲", "G"), ("完美世界", "辰东", "H"), ("完美世界", "辰东", "I"),
]
HIT_SCHEMA = (
    "source_id long, source_name string, weight int, sort_order int, item_pos int, name string, author string, "
    "kind string, intro string, cover_url string, last_chapter string, book_url string"
)


def hits(spark, rows):
    data = [(i, s, 0, 0, 1, n, a, "", "", "", "", f"/b/{i}") for i, (n, a, s) in enumerate(rows)]
    return spark.createDataFrame(data, HIT_SCHEMA)


def test_merge_spellings(spark):
    rows = merge.merge_hits(hits(spark, SPELLINGS)).collect()
    assert len(rows) == 3
    best = next(r for r in rows if r.origin_count == 6)
    assert best.author != ""
    assert [o.source_name for o in best.origins] == list("ABCDEF")
    assert merge.merge_hits(hits(spark, SPELLINGS), dedupe=False).count() == 9


def test_merge_first_author_fills_blank_entry(spark):
    rows = [("t", "", "A"), ("t", "", "B"), ("t", "xy", "C"), ("t", "z", "D"), ("t", "y", "E"), ("t", "", "F")]
    got = {tuple(o.source_name for o in r.origins) for r in merge.merge_hits(hits(spark, rows)).collect()}
    assert got == {("A", "B", "C", "E", "F"), ("D",)}


def test_origins_are_capped_but_counted(spark):
    rows = [("t", "a", f"s{i:02d}") for i in range(30)]
    r = merge.merge_hits(hits(spark, rows)).first()
    assert r.origin_count == 30 and [o.source_name for o in r.origins] == [f"s{i:02d}" for i in range(12)]


def test_merge_hits_query_keeps_all_origins(spark, monkeypatch):
    from folioflow.plans import search as plan

    rows = [("t", ["a", "", "b"][i % 3], f"s{i:02d}") for i in range(60)]
    r = merge.merge_hits(hits(spark, rows[::3]), origin_limit=None).first()
    assert [(o.pos, o.source_name) for o in r.origins] == [(i + 1, f"s{3 * i:02d}") for i in range(20)]
    monkeypatch.setattr(plan, "ranked", lambda spark, d: hits(spark, rows))
    got = {tuple(r.origins.split(",")) for r in plan.merge_hits(spark, "").collect()}
    assert got == {tuple(f"{i}|/b/{i}" for i in range(60) if i % 3 < 2), tuple(f"{i}|/b/{i}" for i in range(2, 60, 3))}


# Text -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, want",
    [("作者：天蚕土豆", "天蚕土豆"), ("天蚕土豆 著", "天蚕土豆"), ("天蚕土豆\n漫画组", "天蚕土豆 漫画组"), ("X 著 ", "X 著"), (None, "")],
)
def test_clean_author(spark, raw, want):
    assert value(spark, text.clean_author(lit(raw).cast("string"))) == want


def test_norms(spark):
    assert value(spark, text.norm_keyword(lit("《斗破  苍穹》！"))) == "斗破苍穹"
    assert value(spark, text.norm_keyword(lit("ＡＢ（c）　d"))) == "abcd"
    assert value(spark, text.norm_title(lit("【A】 b　"))) == "ab"
    assert value(spark, text.tidy(lit("　a \n b  "))) == "a b"
    assert value(spark, text.count_words(lit("斗破 ab12 c，d"))) == 5
    assert value(spark, text.interleave_chars(lit("abc"), lit("1"))) == "a1bc"
    assert value(spark, text.regex_chain(lit("分类：玄幻"), [("分类：", "类别-")])) == "类别-玄幻"
    assert value(spark, text.split_long(lit("aa\nbb\ncccccc\nd"), 5)) == ["aa\nbb", "cccccc", "d"]
    assert value(spark, text.fold_script(lit("鬥破"), {"鬥": "斗"})) == "斗破"


def test_ad_lines(spark):
    ads = ["", "　", "天才一秒记住 x", "www.example.com", "下一章", "-----", "https://a.b/c", "本书由人上传", "目 录"]
    fine = ["他说记住这一天。", "x" * 81 + "www.example.com", "第一段正文。"]
    rows = spark.createDataFrame([(x,) for x in ads + fine], "l string")
    got = [r.a for r in rows.select(text.is_ad_line(F.col("l")).alias("a")).collect()]
    assert got == [True] * len(ads) + [False] * len(fine)


def test_clean_plain(spark):
    raw = "第1章 起点\r\n　　第 1 章起点\n一段&nbsp;正文\n\n本站域名 www.a.com\n二段  正文\n第1章 起点"
    out = value(spark, clean_plain(lit(raw), [lit("第1章 起点")], "正文##文\n##skipped\n([##["))
    assert out == "一段 文\n二段 文\n第1章 起点"


def test_unescape():
    assert unescape("&amp;lt; &#x41;&#66; &nope; &AMP; &#xD800;") == "&lt; AB &nope; & &#xD800;"


# Lists, JSON, encodings -------------------------------------------------------------


def test_pick_index(spark):
    arr = F.array(*map(F.lit, "abcd"))
    assert value(spark, lists.pick_at(arr, 0)) == ["a"] and value(spark, lists.pick_at(arr, -1)) == ["d"]
    assert value(spark, lists.pick_at(arr, -3)) == ["b"] and value(spark, lists.pick_at(arr, 9)) == []
    assert value(spark, lists.pick_slice(arr, -1, -2)) == ["c", "d"]
    assert value(spark, lists.pick_slice(arr, 1, -1)) == ["b", "c"]
    assert value(spark, lists.exclude_at(arr, 0)) == ["b", "c", "d"]
    assert value(spark, lists.exclude_two(arr, 0, -1)) == ["b", "c"]
    assert value(spark, lists.exclude_two(arr, 0, 1)) == ["b", "d"]


BODY = '{"code":0,"data":{"list":[{"name":"斗破苍穹","author":"天蚕土豆","words":5},{"name":"完美世界","author":"辰东","words":"6"}]}}'


def test_json_paths(spark):
    v, k = jsons.parse(lit(BODY)), jsons.key
    at = lambda *s: value(spark, jsons.path_text(v, k("data"), k("list"), *s))
    assert at(jsons.where(lambda x: jsons.compare(jsons.field(x, "author"), "==", "辰东")), k("name")) == "完美世界"
    assert at(jsons.wildcard(), k("name")) == '["斗破苍穹","完美世界"]'
    assert at(jsons.where(lambda x: jsons.compare(jsons.field(x, "words"), ">=", 6)), k("words")) == "6"
    assert at(jsons.where(lambda x: jsons.compare(jsons.field(x, "words"), "==", 6)), k("name")) == "完美世界"
    assert at(jsons.index(-1), k("author")) == "辰东" and at(jsons.index(7)) == ""
    assert at(jsons.union(1, 0), k("words")) == '["6",5]'
    assert value(spark, jsons.is_json(lit('{"a":1},{"b":2}'))) is False
    assert value(spark, jsons.json_recursive(lit(BODY), "words")) == ["5", '"6"']


def test_codecs(spark):
    assert value(spark, codec.encode_keyword(lit("斗破 a"), lit("gb2312"))) == "%B6%B7%C6%C6%20a"
    assert value(spark, codec.encode_keyword(lit("斗ç"), lit("GBK"))) == "%B6%B7%C3%A7"
    assert value(spark, codec.encode_keyword(lit("斗(a)"), lit(""))) == "%E6%96%97(a)"
    assert value(spark, codec.base64_decode(lit("546E5bm7"))) == "玄幻"
    assert value(spark, codec.md5(lit("a"))) == "0cc175b9c0f1b6a831c399e269772661"
    assert value(spark, codec.time_format(lit(1700000000))) == "2023/11/14 22:13"
    assert value(spark, codec.time_format(lit(1700000000000), "yyyyMMdd")) == "20231114"


def test_decode_pages(spark):
    html = '<meta charset="gb2312"><p>斗破</p>'
    rows = [
        (1, html.encode("gbk"), "", ""), (2, "斗破".encode("gbk"), "", ""), (3, "斗破".encode("big5"), "text/html; charset=big5", ""),
        (4, "斗破".encode(), "", "nonsense"), (5, b"\xff\xfe" + "斗".encode("utf-16le"), "", "gbk"), (6, b"", "", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, body binary, content_type string, charset string")
    got = {r.page_id: r.text for r in landing.decode_pages(df).collect()}
    assert got == {1: html, 2: "斗破", 3: "斗破", 4: "斗破", 5: "斗", 6: ""}


# URLs -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "href, want",
    [
        ("/b/1.html", "https://d.test/b/1.html"), ("x/y", "https://d.test/a/x/y"), ("../z", "https://d.test/z"),
        ("./z/", "https://d.test/a/z/"), ("//cdn/x", "https://cdn/x"), ("?p=2", "https://d.test/a/b?p=2"), ("#", ""), ("#k", "https://d.test/a/b?q#k"),
        ("javascript:x", ""), ("mailto:a", ""), (" http://o/x ", "http://o/x"), ("/斗 a", "https://d.test/%E6%96%97%20a"), ("..", "https://d.test/"),
    ],
)
def test_abs_url(spark, href, want):
    assert value(spark, urls.abs_url(lit("https://D.test:443/a/b?q"), lit(href))) == want


def test_other_urls(spark):
    assert value(spark, urls.base_url(lit("//a.com/x?y"))) == "https://a.com"
    assert value(spark, urls.base_url(lit("http://A.com:80/x"))) == "http://a.com"
    assert value(spark, urls.book_url(lit("1159212932"), lit("https://a.com"))) == "1159212932"
    assert value(spark, urls.host_of(lit("https://u@A.com:8080/x"))) == "a.com:8080"
    assert value(spark, urls.host_of(lit(""))) == "—"
    assert not value(spark, urls.url_valid(lit('["https://a.com"]'))) and value(spark, urls.url_valid(lit("https://a.com/x")))
    assert not value(spark, urls.url_valid(lit("http://")))


# Ranking ----------------------------------------------------------------------------

EXACT = [
    ("斗破苍穹", "天蚕土豆"), ("《斗破苍穹》", "天蚕土豆"), ("斗破 苍穹", "天蚕土豆"), ("斗破苍穹之秋雨", "某甲"),
    ("斗破苍穹大番外", "斗破苍穹漫画组"), ("完美世界", "辰东"),
]


@pytest.mark.parametrize("q, kind, n", [("斗破苍穹", "name", 3), ("天蚕土豆", "author", 3), ("天蚕土豆", "all", 3), ("斗破苍穹之秋雨", "all", 1), ("", "name", 6)])
def test_filter_exact(spark, q, kind, n):
    df = spark.createDataFrame(EXACT, "name string, author string")
    assert search.filter_exact(df, q, kind).count() == n


def test_scores(spark):
    def rel(n, a, q, c="", i="", last=""):
        return value(spark, ranking.relevance(lit(n), lit(a), lit(c), lit(i), lit(last), q))

    assert rel("abc", "", "abc", "x", "x", "x") == 105 and rel("abcd", "", "ABC ") == 82 and rel("xabc", "bc", "abc") == 92
    assert rel("cxbxa", "", "abc") == 28 and rel("c", "c", "c") == 120 and rel("a", "", "") == 0

    def score(n, a, tn, ta):
        return value(spark, ranking.match_score(lit(n), lit(a), lit("c"), lit(""), lit(tn), lit(ta)))

    assert score("《斗破》", "土豆", "斗破", "土豆") == 98 and score("斗破之", "土豆组", "斗破", "土豆") == 63
    assert score("破天", "", "斗破", "x") == 18 and score("", "", "斗破", "x") == 3
    assert alternatives.threshold_of(None) == 45 and alternatives.threshold_of(0) == 0


# Definitions ------------------------------------------------------------------------


def test_normalize_takes_first_alias_in_document_order(spark):
    raw = '{"title":"t","bookSourceName":"n","bookSourceUrl":"a.com/x","Rule_Search":"{\'chapterList\':\'.l\'}","enabled":"No"}'
    r = definitions.normalize_source(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r.name, r.url, r.enabled, r.can_toc, r.can_content, r.usable) == ("t", "https://a.com", False, True, False, False)
    assert definitions.NO_SEARCH in r.issues and definitions.NO_CONTENT in r.issues


def test_upsert_modes(spark):
    cat = spark.createDataFrame(
        [(7, "a", "u", "old", 0, True, 1, "", "{}", 0, 3)],
        "id long, name string, url string, group_name string, type int, enabled boolean, weight int, comment string, raw string, last_update_time long, sort_order int",
    )
    rows = spark.createDataFrame(
        [(p, n, u, g, 0, True, 2, "", "{}", 0) for p, n, u, g in [(0, "a", "u", "x"), (1, "b", "u", "y"), (2, "b", "u", "z"), (3, "c", "", "w")]],
        "pos long, name string, url string, group_name string, type int, enabled boolean, weight int, comment string, raw string, last_update_time long",
    )

    def state(mode):
        return sorted((r.id, r.name, r.group_name) for r in definitions.upsert_sources(cat, rows, mode).collect())

    assert state("append") == [(7, "a", "old"), (8, "b", "y")]
    assert state("merge") == [(7, "a", "x"), (8, "b", "z")]
    assert state("replace") == [(1, "a", "x"), (2, "b", "y")]
    acts = [r.action for r in definitions.import_actions(cat, rows, "merge").orderBy("pos").collect()]
    assert acts == ["updated", "added", "updated", "failed"]


def test_health_and_purge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").withColumn("respond_time", F.lit(0))
    cat = catalog.evolve_schema(old, catalog.HEALTH_COLUMNS)
    assert health.health_stats(cat).first().untested == 2
    runs = spark.sql("select 1L as source_id, 1L as event_id, timestamp_ntz'2024-01-01' as tested_at, false as ok, 0 as hit_count, repeat('e', 600) as error, 9 as elapsed")
    done = health.record_health(cat, runs)
    first = done.filter("id = 1").first()
    assert len(first.last_test_error) == 500 and first.respond_time == 9
    assert [r.id for r in health.purge_invalid(done, cat.select("id")).collect()] == [2]
    assert health.purge_invalid(done, cat.select("id").limit(0)).count() == 2


def test_plan_requests(spark):
    df = spark.createDataFrame(
        [(1, "https://a.com", "/s,{\n'method':'post','body':'k={{key}}','charset':'gbk'}"), (2, "https://b.com", "/q?{{ key }}&{{x\ny}}\n/second")],
        "id long, url string, search_url string",
    ).withColumns({"header": F.create_map().cast("map<string,string>"), "charset": F.lit("")})
    a, b = requests.plan_requests(df, ["斗"]).orderBy("source_id").collect()
    assert (a.request_url, a.method, a.body) == ("https://a.com/s", "POST", "k=%B6%B7")
    assert b.method == "GET" and b.request_url.startswith("https://b.com/q?%E6%96%97&")


# Node rows and extraction -----------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x}</style></head><body>
<div class="list"><div class="item first"><a class="cover" href="/b/1"><img src="/i/1.jpg" alt="pic"></a>
<h3 class=name><a href='/b/1'>One &amp; more</a></h3><p class="author">作者：甲<p class="last"><a href="/c/9">nine</a></p></div>
<div class="item"><h3 class="name"><a href="/b/2">Two</a></h3><p class="author">乙</p></div>
<div class="item"><h3 class="name"><a href="/b/3">Three</a></h3></div></div>
<div id="content"><p>first&nbsp;line</p><p>second<br>third</p><script>var a=1<2;</script><!--no--></div>
<p>open
<div>after</div>
</body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    pages = spark.createDataFrame(
        [(1, 5, "S", "https://d.test/list", PAGE)], "page_id long, source_id long, source_name string, final_url string, text string"
    )
    return pages, extract.shred_table(pages)


def found(page, *steps):
    nodes = page[1]
    return dom.sel_path(nodes, dom.page_context(nodes), *steps)


def texts(page, nodes_set):
    return [r.value for r in dom.node_text(page[1], nodes_set).orderBy("pre").collect()]


def test_selectors(page):
    nodes, inside, match = page[1], dom.inside, dom.match
    items = found(page, inside(match(cls="list")), dom.child(match(cls="item")))
    assert items.count() == 3
    assert texts(page, found(page, inside(match(cls="name")), inside(match("a")))) == ["One & more", "Two", "Three"]
    assert found(page, inside(dom.attr_match("src", "^=", "/i/"))).count() == 1
    assert found(page, inside(match("p")), dom.next_to(match("div"))).count() >= 1
    assert texts(page, dom.sel_contains(nodes, found(page, inside(match("p"))), "乙")) == ["乙"]
    assert dom.sel_has(nodes, items, match("img")).count() == 1
    assert dom.sel_set(items, "eq", -1).first().pre == max(r.pre for r in items.collect())
    assert dom.sel_empty(nodes, found(page, inside(match("br")))).count() == 1
    assert texts(page, found(page, inside(match("title")))) == ["T &amp; t"]  # raw text is not decoded
    body = texts(page, found(page, inside(match(id="content"))))[0]
    assert body == "first line second third"
    img = dom.node_html(nodes, found(page, inside(match("img"))), outer=True).first().value
    assert img == '<img src="/i/1.jpg" alt="pic">'
    assert dom.node_attr(nodes, found(page, inside(match("img"))), "nope").first().value == ""


def test_block_lines_and_content(page):
    nodes = page[1]
    lines = dom.block_lines(nodes, found(page, dom.inside(dom.match(id="content")))).orderBy("line_no").collect()
    assert [r.line.replace(" ", " ") for r in lines] == ["first line", "second", "third"]


def test_extract_hits(page):
    pages, nodes = page
    inside, match, field = dom.inside, dom.match, extract.Field
    spec = extract.Spec(
        items=(inside(match(cls="item")),),
        fields={
            "name": field((inside(match(cls="name")), inside(match("a")))),
            "author": field((inside(match(cls="author")),)),
            "book_url": field((inside(match(cls="name")), inside(match("a"))), "href", (("^/b/", "/r/"),)),
            "cover_url": field((inside(match("img")),), "src"),
            "last_chapter": field((inside(match(cls="nope")),), otherwise=field((inside(match(cls="last")),))),
        },
    )
    a, b, c = extract.extract_hits(pages, nodes, spec).orderBy("item_pos").collect()
    assert (a["name"], a.author, a.book_url, a.cover_url, a.last_chapter) == ("One & more", "甲", "https://d.test/r/1", "https://d.test/i/1.jpg", "nine")
    assert (b["name"], b.author, b.cover_url) == ("Two", "乙", "") and c.author == "" and c.key == "5|https://d.test/r/3"
    assert extract.extract_hits(pages, nodes, spec, limit=2).count() == 2


def test_tree_shapes():
    def shape(html):
        return [(r[6], r[4]) for r in page_nodes(1, html) if r[5] == "element"]

    assert shape("<ul><li>a<li>b</ul>") == [("ul", 1), ("li", 2), ("li", 2)]
    assert shape("<table><tr><td>a<td>b<tr><td>c</table>") == [("table", 1), ("tr", 2), ("td", 3), ("td", 3), ("tr", 2), ("td", 3)]
    assert shape("<p>a<div>b</div>") == [("p", 1), ("div", 1)]
    assert shape("<script>a</b><p></script><br/><i x=1 x=2>") == [("script", 1), ("br", 1), ("i", 1)]
    assert [r[8] for r in page_nodes(1, "a < b<![CDATA[&lt;]]>")] == ["a ", "<", " b", "<"]


def test_clean_html_with_rules(spark):
    rows = spark.createDataFrame([(1, "<p>ads here</p><p>text</p>"), (2, "plain ads here\nmore")], "page_id long, text string")
    got = {r.page_id: r.content for r in extract.clean_html(rows, replace_rules="ADS here##x").collect()}
    assert got == {1: "x\ntext", 2: "plain x\nmore"}


def test_follow_next(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "x"), ("s", "t"), ("t", "s")], "url string, next_url string")
    starts = spark.createDataFrame([(1, "a"), (2, "x"), (3, "s")], "start_id long, url string")
    rows = extract.follow_next(starts, links, 6).collect()
    assert sorted((r.start_id, r.page_no, r.url) for r in rows) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x"), (3, 1, "s"), (3, 2, "t")]
    toc = extract.follow_next(starts, links, 6, revisit_start=True).filter("start_id = 3").count()
    assert toc == 3  # a contents chain may pass its start once more
    assert extract.follow_next(starts, links, 2).filter("start_id = 1").count() == 2


def test_shelf_and_progress(spark):
    events = spark.sql(
        "select * from values (1L, 1L, timestamp_ntz'2024-01-01 00:00:02', 10, 5), (2L, 1L, timestamp_ntz'2024-01-01 00:00:01', 3600, 9), "
        "(3L, 1L, timestamp_ntz'2024-01-01 00:00:03', 5, null) as t(event_id, book_id, ts, add_seconds, chapter_index)"
    )
    r = library.progress_state(events).first()
    assert (r.chapter_index, r.read_seconds) == (5, 15)


def test_plain_replacements(spark):
    """Only $1..$n, $& and $$ mean something in a replacement; nothing in it can stop a job."""
    cases = [("$", "$"), ("$9", "$9"), ("\\", "\\"), ("$1x", "bx"), ("$10", "b0"), ("[$&]", "[abc]"), ("$$1", "$1"), ("a\\1", "a\\1")]
    for replacement, expected in cases:
        assert value(spark, text.regex_chain(lit("abc"), [("a(b)c", replacement)])) == expected
    assert value(spark, clean_plain(lit("price abc here"), replace_rules="abc##$5")) == "price $5 here"


def test_blank_patches(spark):
    books = spark.createDataFrame([(1, "old", "x"), (2, "old", "x"), (3, "old", "x")], "id long, name string, updated_at string")
    patch = spark.createDataFrame([(1, "\n"), (2, "\u3000"), (3, " new ")], "id long, name string")
    out = {r.id: (r.name, r.updated_at) for r in catalog.patch_nonblank(books, patch, "id", ["name"], F.lit("now")).collect()}
    assert out == {1: ("old", "x"), 2: ("old", "x"), 3: (" new ", "now")}


def test_deep_json(spark):
    """Texts nested 100,000 levels deep give their values, and deep values are written whole."""
    n = 100_000
    deep = "[" * n + '{"k": "x"}' + "]" * n
    assert value(spark, jsons.json_recursive(lit(deep), "k")) == ['"x"']
    assert value(spark, jsons.json_recursive(lit('{"a":' * n + '{"k":[1, {"b":"é"}]}' + "}" * n), "k")) == ['[1, {"b": "é"}]']
    assert value(spark, jsons.json_recursive(lit('{"k":' + "[" * n + "]" * n + "}"), "k")) == ["[" * n + "]" * n]
    assert value(spark, jsons.json_recursive(lit("[" * n + "]" * (n - 1)), "k")) == []
    assert value(spark, jsons.json_recursive(lit('{"a": [{"k": {"k": 1}}], "k": null}'), "k")) == ['{"k": 1}', "1", "null"]


def test_fill_once(spark):
    from folioflow.sources.requests import fill_once

    values = {"key": lit("{{page}} $1"), "page": lit("2")}
    assert value(spark, fill_once(lit("q={{ key }}&p={{page}}&x={{other}}"), values)) == "q={{page}} $1&p=2&x={{other}}"


def test_all_members_of_a_group(spark):
    rows = spark.range(51).selectExpr("id", "concat('n', id) as name", "'g' as group_name", "cast(id % 3 as int) as weight", "0 as sort_order")
    out = catalog.group_members(rows).orderBy("pos").collect()
    assert [r.pos for r in out] == list(range(1, 52)) and {r.members for r in out} == {51}
    assert [r.id for r in out] == [i for w in (2, 1, 0) for i in range(51) if i % 3 == w]


def test_locale_order(spark):
    rows = spark.createDataFrame([(1.0, n, 1, "u") for n in ("B", "b", "A", "a")], "score double, source_name string, source_id long, book_url string")
    assert [r.source_name.lower() for r in search.top_search(rows, None).collect()] == ["a", "a", "b", "b"]


def test_deep_json_reads_and_writes_like_the_library():
    rng = random.Random(3)

    def some(depth):
        kind = rng.random()
        if depth and kind < 0.3:
            return [some(depth - 1) for _ in range(rng.randint(0, 3))]
        if depth and kind < 0.7:
            return {rng.choice(["k", "a", 'q"', ""]): some(depth - 1) for _ in range(rng.randint(0, 3))}
        return rng.choice([None, True, False, 0, -7, 1.5, 1e300, "", "é\n\\", "漢😀", float("inf")])

    for _ in range(300):
        x = some(5)
        for text in (json.dumps(x), json.dumps(x, indent=1, ensure_ascii=False), f" {json.dumps(x)}\n"):
            assert jsons.parse_deep(text) == x and jsons.dump_deep(x) == json.dumps(x, ensure_ascii=False)
        text = json.dumps(x)
        cut = text[: rng.randrange(len(text))] + rng.choice(["", ",", "]", "}", "x", ":"])
        try:
            want = json.loads(cut)
        except ValueError:
            with pytest.raises(ValueError):
                jsons.parse_deep(cut)
        else:
            assert jsons.parse_deep(cut) == want
    assert jsons.parse_deep('{"a": 1, "a": 2}') == {"a": 2}


def test_pages_without_guards():
    from folioflow.operators.shred import page_nodes

    assert [r[8] for r in page_nodes(1, f"<p>a</p><!--{'c' * 5000}-->") if r[5] == "comment"] == ["c" * 5000]
    assert max(r[4] for r in page_nodes(1, "<div>" * 2000 + "x" + "</div>" * 2000)) >= 2000


def test_long_authors(spark):
    from folioflow.functions.text import parts_of_lengths

    rows = spark.createDataFrame([("t", "ab" * 10_000)], "title string, ak string")
    others = spark.createDataFrame([("t", "bab"), ("t", "x" * 7), ("u", "zz")], "title string, part string")
    got = {r.part for r in parts_of_lengths(rows, others, ["title"], "ak", "part").collect()}
    assert got == {"aba", "bab", "abababa", "bababab"}
