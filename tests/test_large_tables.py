"""Steps that large tables made slow: what they carry, how often they run, and the same results."""

from pyspark.sql import functions as F

from folioflow.functions import jsons, urls
from folioflow.operators import search, shred
from folioflow.operators.alternatives import match_alternatives
from folioflow.plans import views
from folioflow.streaming import jobs, runner


def tables(spark, path):
    """Small tables with repeated parts, repeated lines and null keys."""
    parts = [(k, f"p{k}", f"Brand#{k % 3}", f"t{k % 2}", 20 + k) for k in range(1, 9)] + [(3, "p3b", "Brand#9", "t9", 30), (4, "p4", "Brand#1", "t0", 24), (None, "lost", "b", "t", 1)]
    lines = [(o, (o * 5 + k) % 9 or None, (o + k) % 4, k) for o in range(12) for k in range(4)]
    lines += lines[:7] + [(99, 3, None, 0)]
    frames = {
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "supplier": ([(s, f"s{s}", 0, 100.0 * s) for s in range(4)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "r")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def multiset(df):
    return sorted(map(repr, df.collect()))


def test_hits_number_keys_and_no_texts(spark, tmp_path, monkeypatch):
    d = tables(spark, tmp_path)
    carried = []

    def ordinal(df, *args, **kwargs):
        carried.extend(df.columns)
        return numbered(df, *args, **kwargs)

    numbered = views.ordinal
    monkeypatch.setattr(views, "ordinal", ordinal)
    got = views.load(spark, d, "hits")
    assert "name" not in carried and "kind" not in carried
    for t in ("part", "lineitem"):
        views.load(spark, d, t).createOrReplaceTempView(t)
    want = spark.sql(views.VIEWS["hits"])
    # Rows of one part key may take any of its places, so places are compared by source and link.
    rest = [c for c in want.columns if c != "item_pos"]
    assert multiset(got.select(*rest)) == multiset(want.select(*rest))
    places = lambda df: df.groupBy("source_id", "book_url").agg(F.sort_array(F.collect_list("item_pos")).alias("at"))
    assert multiset(places(got)) == multiset(places(want))
    assert multiset(views.load(spark, d, "hits", positions=False).select(*rest)) == multiset(want.select(*rest))


def test_found_reads_lines_twice_and_keeps_its_rows(spark, tmp_path):
    d = tables(spark, tmp_path)
    got = views.load(spark, d, "found", positions=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation [" in line and "l_orderkey" in line for line in plan.split("\n")) == 2
    want = views.load(spark, d, "found")
    assert got.columns == want.columns
    assert multiset(got.drop("item_pos")) == multiset(want.drop("item_pos"))


def test_stream_ranks_like_the_batch(spark, tmp_path):
    """Ties between sources are broken in locale order, in the stream as well."""
    books = spark.createDataFrame([(1, 0, "title", "ann")], "book_id long, source_id long, name string, author string")
    schema = "keyword string, source_id long, source_name string, book_url string, name string, author string, cover_url string, intro string"
    rows = [("title", s, name, f"/{s}", "title", "ann", "", "") for s, name in enumerate(["B", "a", "C", "b"], 1)]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
    found = spark.createDataFrame(rows, schema)
    stream = runner.read_landed(spark, f"{tmp_path}/landed", found.schema, files_per_batch=1)
    got = jobs.stream_alternatives(stream, books, limit=3)
    columns = ["book_id", "source_id", "book_url", "score", "rank"]
    want = match_alternatives(books, found, limit=3)
    assert multiset(got.select(*columns)) == multiset(want.select(*columns))


def test_links_of_any_length_and_form(spark):
    page = "https://s1.example.com/list/p1.html?x=1"
    long = "/" + "a" * 60_000
    forms = {
        long: "https://s1.example.com" + long, "../b.html": "https://s1.example.com/b.html", "./b?c=/..": "https://s1.example.com/list/b?c=/..",
        "/a/./b/..": "https://s1.example.com/a/", "?page=2": "https://s1.example.com/list/p1.html?page=2", "#t": "https://s1.example.com/list/p1.html?x=1#t",
        "//c.example.com/x": "https://c.example.com/x", "/ä b": "https://s1.example.com/%C3%A4%20b", "mailto:x": "", "x:y": "x:y", "b.html#a?b": "https://s1.example.com/list/b.html#a?b",
    }
    rows = spark.createDataFrame(list(forms.items()), "href string, want string").withColumn("page", F.lit(page))
    wrong = rows.withColumn("got", urls.abs_url(F.col("page"), F.col("href"))).filter("got <> want").collect()
    assert [(r.href[:30], r.got[:80]) for r in wrong] == []


def test_covers_are_completed_once(spark):
    columns = ["name", "author", "kind", "intro", "cover_url", "book_url", "word_count", "last_chapter", "page_url", "source_name"]
    df = spark.createDataFrame([(1, *["x"] * 10)], "source_id long, " + ", ".join(f"{c} string" for c in columns))
    plan = search.make_hit(df)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("\n")[0]
    assert "_cover" in top and "RLIKE" not in top


def test_loose_json_is_one_value_and_parsed_once(spark):
    texts = ['{"a":1}', "[1,2]", "1", '"x"', "null", "1,2", "1],[2", '{"a":1}x', 'cb({"a":[1]});', "x{}y[1]z", "}{", "", " [1] ", '{"a":1', f'["{jsons.END}"]', f'1,"{jsons.END}"', "nix", '{"a":1}],[{"b":2}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = jsons.parse_json_loose(F.col("t"))

    def plain(s):
        trim = lambda x: F.regexp_extract(x, r"(?s)^(.*[\]}])", 1)
        head = F.regexp_extract(s, r"(?s)([\[{].*)$", 1)
        return F.try_parse_json(F.try_element_at(F.filter(F.array(s, trim(s), head, trim(head)), jsons.is_json), F.lit(1)))

    rows = df.select("t", F.to_json(made).alias("got"), F.to_json(plain(jsons.strip_space(F.col("t")))).alias("want")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]


def test_json_members_are_read_at_once(spark):
    texts = ['{"a":{"b":"x"}}', '{"a":[{"b":1},{"b":2}]}', '{"a":{"b":null}}', '{"a":{"b":[1,{"c":2}]}}', '[{"a":{"b":1.5}}]', "{}", "3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", F.try_parse_json("t"))
    steps = [jsons.key("a"), jsons.key("b")]
    walked = [lambda n, s=s: s(n) for s in steps]  # without the name that tells a member
    assert jsons._straight(tuple(steps)) == '$["a"]["b"]' and jsons._straight(tuple(walked)) is None
    rows = df.select("t", jsons.path_text(F.col("v"), *steps).alias("got"), jsons.path_text(F.col("v"), *walked).alias("want")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]


def test_repeated_attributes_are_read_once(monkeypatch):
    calls, plain = [], shred.ATTR

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(plain, name)

    monkeypatch.setattr(shred, "ATTR", Counted())
    rows = shred.page_nodes(1, '<li class="item once" data-x="/a">t</li>' * 50)
    assert len(rows) == 100 and len(calls) <= 2
    assert rows[0][7] == [("class", "item once"), ("data-x", "/a")] and rows[98][14:17] == [50, 50, 50]


def test_texts_go_to_the_quality_tasks_once(spark, monkeypatch):
    from folioflow.llm import quality

    seen, score = [], quality.score
    monkeypatch.setattr(quality, "score", lambda docs, *args, **kwargs: seen.extend(docs.columns) or score(docs, *args, **kwargs))
    docs = spark.createDataFrame([(1, "a " * 30, "src0")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.stage(docs, labels).columns == docs.columns
    assert len(seen) == len(docs.columns)
