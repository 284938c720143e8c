"""Interval joins over node rows: against naive tree walks, as plans, and for very deep pages."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import dom, extract
from folioflow.operators.intervals import NodeSet, Pages, picked
from folioflow.operators.shred import page_nodes

TAGS = ["div", "span", "b", "i", "em"]


def markup(rng, n):
    """Nested elements with texts, comments, hidden parts and images."""
    out, open_ = [], []
    for _ in range(n):
        r = rng.random()
        if r < 0.45:
            tag = rng.choice(TAGS)
            out.append(f'<{tag} class="{rng.choice(["x", "y", "x y", ""])}">')
            open_.append(tag)
        elif r < 0.7 and open_:
            out.append(f"</{open_.pop()}>")
        elif r < 0.9:
            out.append(rng.choice(["one ", "two\n", " three", "　"]))
        elif r < 0.94:
            out.append("<script>no</script>")
        elif r < 0.97:
            out.append('<img alt="pic &amp;" src="/i">')
        else:
            out.append("<!--note-->")
    return "".join(out)


class Tree:
    """The rows of a page with ancestors, for naive answers."""

    def __init__(self, page_id, html):
        self.rows = page_nodes(page_id, html)
        self.up = [r[3] for r in self.rows]

    def inside(self, k, root):
        while k:
            k = self.up[k - 1]
            if k == root:
                return True
        return False

    def walk(self, start, axis, test):
        hits = [k for k, r in enumerate(self.rows, 1) if r[5] == "element" and test(r)]
        rows = self.rows
        if axis == "inside":
            return [k for k in hits if any(self.inside(k, s) for s in start)]
        if axis == "self_inside":
            return [k for k in hits if k in start or any(self.inside(k, s) for s in start)]
        if axis == "child":
            return [k for k in hits if self.up[k - 1] in start]
        if axis == "next":
            return [k for k in hits if rows[k - 1][10] in start and rows[k - 1][10]]
        return [k for k in hits if any(s and s < k and self.up[s - 1] == self.up[k - 1] for s in start)]


def arrays(trees):
    rows = [r for t in trees for r in t.rows]
    return [np.array([r[c] or 0 for r in rows], np.int64) for c in (0, 1, 2, 3, 10)]


@pytest.mark.parametrize("seed", range(6))
def test_axes_against_tree_walks(seed):
    rng = random.Random(seed)
    trees = [t for t in (Tree(p, markup(rng, rng.randint(1, 120))) for p in rng.sample(range(99), 8)) if t.rows]
    pages = Pages(*arrays(trees))
    every = [r for t in trees for r in t.rows]
    first = np.cumsum([0, *[len(t.rows) for t in trees]])
    for _ in range(60):
        # Several contexts a page, with places inside each other and the page as a whole.
        sets = []
        for p, t in enumerate(trees):
            for _ in range(rng.randint(0, 3)):
                sets.append((p, sorted(rng.sample(range(len(t.rows) + 1), rng.randint(1, min(5, len(t.rows)))))))
        ctx = np.array([c for c, (_, s) in enumerate(sets) for _ in s], np.int64)
        at = np.array([-1 - p if k == 0 else first[p] + k - 1 for p, s in sets for k in s], np.int64)
        axis, tag = rng.choice(["inside", "self_inside", "child", "next", "later"]), rng.choice(TAGS)
        rows = np.flatnonzero([r[5] == "element" and r[6] == tag for r in every])
        s = NodeSet(ctx, at)
        got = pages.inside(s, rows, axis == "self_inside") if "inside" in axis else getattr(pages, axis)(s, rows)
        want = [(c, first[p] + k - 1) for c, (p, start) in enumerate(sets) for k in trees[p].walk(start, axis, lambda r: r[6] == tag)]
        assert list(zip(got.ctx.tolist(), got.at.tolist())) == want
        held = pages.holds(s, rows)
        assert held.tolist() == [bool(trees[p].walk([k], "inside", lambda r: r[6] == tag)) for p, start in sets for k in start]


def test_picks():
    lists = [list(range(10, 10 + n)) for n in (0, 1, 2, 5)]
    s = NodeSet(np.repeat(np.arange(4), [len(x) for x in lists]), np.concatenate(lists).astype(int))
    cases = {
        ("eq", 1): lambda x: x[1:2], ("eq", -1): lambda x: x[-1:], ("eq", -3): lambda x: x[-3:-2] if len(x) >= 3 else [],
        ("not_eq", 0): lambda x: x[1:], ("not_eq", -1): lambda x: x[:-1], ("lt", 2): lambda x: x[:2], ("lt", -1): lambda x: [],
        ("gt", 1): lambda x: x[2:], ("gt", -1): lambda x: x, ("gt", -3): lambda x: x[-2:], ("first",): lambda x: x[:1], ("last",): lambda x: x[-1:],
        ("even",): lambda x: x[::2], ("odd",): lambda x: x[1::2], ("slice", 1, 3): lambda x: x[1:3], ("slice", -2): lambda x: x[-2:],
        ("slice", 0, -1): lambda x: x[:-1], ("slice", -1, -3): lambda x: x[-3:], ("slice", 4, 2): lambda x: [],
    }
    for op, want in cases.items():
        got = picked(s, *op)
        assert [got.at[got.ctx == c].tolist() for c in range(4)] == [want(x) for x in lists], op


@pytest.fixture(scope="module")
def site(spark):
    rng = random.Random(9)
    html = [
        "<ul>" + "".join(f'<li class="item"><b>n{i}</b> <i>{"x" if i % 2 else ""}</i><em>a</em><em>b{i}</em><p>t{i}<script>s</script></p></li>' for i in range(rng.randint(0, 9))) + "</ul>"
        for _ in range(40)
    ] + ["", "no markup", "<p>lone"]
    rows = [(p, 7, "S", f"https://s.test/{p}/", h) for p, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, source_id long, source_name string, final_url string, text string").repartition(5)
    return pages, extract.shred_table(pages), html


def test_filters_inside_fields(site):
    """Positions, slices, exclusions, has, lacks, contains, empty and later siblings, for each list item on its own."""
    pages, nodes, html = site
    field, inside, match = extract.Field, dom.inside, dom.match
    em = inside(match("em"))
    fields = {
        "first": field((em, dom.pick("first"))), "last": field((em, dom.pick("eq", -1))), "rest": field((em, dom.pick("slice", 1))),
        "other": field((em, dom.pick("not_eq", 0))), "later": field((inside(match("b")), dom.later(match("em")))),
        "blank": field((inside(match("i")), dom.empty(), dom.self_inside(match("i"))), "outer_html"),
        "bold": field((dom.self_inside(match("li")), dom.has(match("b"))), "class"),
        "plain": field((inside(match("p")), dom.lacks(match("b")), dom.contains("t3"))),
        "not_first": field((em, dom.without(inside(match("em") & (F.col("type_index") == 1))))),
        "nth": field((inside(match("em") & dom.nth(F.col("type_index"), 2, 0)),)),
    }
    spec = extract.Spec(fields=fields, items=(inside(match("li")),))
    rows = extract._records(extract._about(pages, "source_id"), nodes, spec).collect()
    want = []
    for p, h in enumerate(html):
        for i in range(len(re.findall("<li", h))):
            own = f"b{i}"
            want.append((p, "a", own, own, own, f"a\n{own}", "<i></i>" if i % 2 == 0 else "", "item", "t3" if i == 3 else "", own, own))
    assert sorted(tuple(r[c] for c in ["page_id", *fields]) for r in rows) == sorted(want)


def test_small_chunks_and_pages_without_nodes(site):
    pages, nodes, html = site
    spec = {"n": ((dom.inside(dom.match("li")),), ""), "t": ((), "text")}
    about = pages.select("page_id", "final_url")
    for size in (1, 50, 100_000):
        rows = dom.records(nodes, spec, about=about, one=True, size=size).collect()
        assert {r.page_id: (len(r.n), r.final_url) for r in rows} == {p: (h.count("<li"), f"https://s.test/{p}/") for p, h in enumerate(html)}
        assert {r.page_id: r.t for r in rows if r.page_id >= 40} == {40: [], 41: ["no markup"], 42: ["lone"]}
    items = dom.records(nodes, {"b": ((dom.inside(dom.match("b")),), "text")}, (dom.inside(dom.match("li")),), about, nested=True).collect()
    assert {r.page_id: [x["b"] for x in r["items"]] for r in items if r["items"]} == {
        p: [[f"n{i}"] for i in range(h.count("<li"))] for p, h in enumerate(html) if "<li" in h
    }


def test_sets_with_contexts_equal_records(site):
    """Node sets from a frame of start nodes, nested contexts among them."""
    _, nodes, _ = site
    li = dom.select(nodes, dom.inside(dom.match("li")))
    items = li.select("page_id", F.col("pre").alias("ctx"), "pre")
    both = items.unionByName(dom.page_context(nodes)).unionByName(items)
    found = dom.sel_path(nodes, both, dom.inside(dom.match("em")), dom.pick("last"))
    n = li.count()
    assert found.filter("ctx > 0").count() == n
    assert found.filter("ctx = 0").count() == li.select("page_id").distinct().count()
    texts = {r.value for r in dom.node_text(nodes, found.filter("ctx > 0")).collect()}
    assert texts <= {f"b{i}" for i in range(9)} and texts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_and_none_when_laid_out(spark, site):
    """With broadcasts off the pages' columns move once; nodes do not move at all, and neither in a second query."""
    pages, nodes, _ = site
    spec = extract.Spec(fields={"name": extract.Field((dom.inside(dom.match("b")),))}, items=(dom.inside(dom.match("li")),))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = plan_of(extract.extract_hits(pages, nodes, spec))
        assert hits.count("Exchange hashpartitioning(page_id") == 1 and hits.count("Window") == 1
        for df in (dom.records(nodes, {"t": ((), "text")}), dom.select(nodes, dom.inside(dom.match("li")), dom.child(dom.match("b")))):
            assert "Exchange" not in plan_of(df) and "Bucketed: true" in plan_of(df)
        counts = nodes.groupBy("page_id").count()
        assert "Exchange" not in plan_of(nodes.join(counts, "page_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_very_deep_pages(spark):
    """50,000 levels are 50,000 levels, each with its parent, and what is in the deepest is found."""
    n = 50_000
    html = "<div>" * n + "<b>x</b>" + "</div>" * n
    rows = page_nodes(1, html)
    assert max(r[4] for r in rows) == n + 2 and rows[n][3] == n and rows[0][2] == n + 2
    # An end that fits nothing open costs nothing.
    assert len(page_nodes(1, "<div>" * n + "</p>" * n)) == n
    pages = spark.createDataFrame([(1, html)], "page_id long, text string")
    nodes = extract.shred_table(pages)
    got = dom.records(nodes, {"x": ((dom.inside(dom.match("div")), dom.pick("last"), dom.child(dom.match("b"))), "text"), "n": ((dom.inside(dom.match("div")),), "")}).first()
    assert got.x == ["x"] and len(got.n) == n
    assert nodes.agg(F.max("depth")).first()[0] == n + 2


def test_sibling_counts():
    rows = {r[1]: r for r in page_nodes(1, "<ul><li>a</li>t<b></b><li>c</li></ul><p>")}
    assert [(r[9], *r[14:17]) for r in rows.values() if r[6]] == [(0, 2, 1, 1), (0, 3, 1, 2), (1, 3, 1, 1), (2, 3, 2, 2), (1, 2, 1, 1)]


def chain_of(start, link, limit, revisit):
    out, seen, url = [start], set() if revisit else {start}, start
    while len(out) < limit and (n := link.get(url)) and n != url and n not in seen:
        out.append(n)
        seen.add(n)
        url = n
    return out


@pytest.mark.parametrize("limit, revisit", [(None, False), (None, True), (1, False), (7, False), (8, True)])
def test_chains_by_doubling(spark, limit, revisit):
    """Lines, loops, loops with a tail, self links and blanks against a walk."""
    rng = random.Random(7)
    link = {f"u{k}": f"u{k + 1}" for k in range(37)} | {f"r{k}": f"r{rng.randrange(40)}" for k in range(40)} | {"s": "s", "b": "", "t": "r1"}
    starts = [(k, u) for k, u in enumerate([*rng.sample(sorted(link), 30), "u0", "s", "b", "t", "unknown"])]
    links = spark.createDataFrame([*link.items(), ("t", None), ("u3", "u4")], "url string, next_url string")
    got = extract.follow_next(spark.createDataFrame(starts, "start_id long, url string"), links, limit, revisit).collect()
    want = {(k, n, u) for k, start in starts for n, u in enumerate(chain_of(start, link, limit or 10**9, revisit), 1)}
    assert {(r.start_id, r.page_no, r.url) for r in got} == want and len(got) == len(want)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    links = spark.range(10_000).selectExpr("concat('p', id) as url", "concat('p', id + 1) as next_url").filter("url <> 'p9999'")
    starts = spark.createDataFrame([(1, "p0"), (2, "p9990")], "start_id long, url string")
    rounds = []
    plain = extract.settle
    monkeypatch.setattr(extract, "settle", lambda df, label: rounds.append(label) or plain(df, label))
    got = {r[0]: (r[1], r[2]) for r in extract.follow_next(starts, links).groupBy("start_id").agg(F.count("*"), F.max("page_no")).collect()}
    assert got == {1: (10_000, 10_000), 2: (10, 10)}
    assert rounds.count("jumps") < 20


def test_joined_and_turned_lists(spark):
    html = [
        "<ul class=a><li>1</li><li>3</li><li>5</li></ul><ul class=b><li>2</li><li>4</li></ul>",
        "<ul class=b><li>7</li></ul>",
        "<p>none",
    ]
    pages = spark.createDataFrame([(k, k, 1, f"https://t.test/{k}", h) for k, h in enumerate(html)], "page_id long, book_id long, page int, final_url string, text string")
    nodes = extract.shred_table(pages)
    lists = tuple((dom.inside(dom.match("ul", c)), dom.inside(dom.match("li"))) for c in "ab")
    fields = {"title": extract.Field((), "text"), "url": extract.Field((), "text")}
    every = (dom.inside(dom.match("li")),)

    def titles(items):
        rows = extract.extract_toc(pages, nodes, extract.Spec(fields, items)).orderBy("book_id", "pos").collect()
        return ["".join(r.title for r in rows if r.book_id == b) for b in range(3)]

    assert titles(dom.Items(lists)) == ["13524", "7", ""]
    assert titles(dom.Items(lists, "weave")) == ["12345", "7", ""]
    assert titles(dom.Items(lists, "weave", reverse=True)) == ["54321", "7", ""]
    assert titles(dom.Items(lists, "first")) == ["135", "7", ""]
    assert titles(dom.Items((every, *lists), reverse=True)) == ["42531", "7", ""]
    a, b = (extract.Field(p) for p in lists)
    both = {"row": extract.Field(a.steps, also=(b,)), "turn": extract.Field(a.steps, also=(b,), weave=True, regexes=(("^", "x"),))}
    rows = {r.page_id: (r.row, r.turn) for r in extract._records(extract._about(pages), nodes, extract.Spec(both)).collect()}
    assert rows == {0: ("1\n3\n5\n2\n4", "x1\n2\nx3\n4\nx5"), 1: ("7", "7"), 2: ("", "")}
