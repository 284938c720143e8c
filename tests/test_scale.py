"""Paths for hot groups against brute force on random rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_golden import HIT_SCHEMA

from folioflow.functions.ranking import match_score
from folioflow.operators import alternatives, library, merge
from folioflow.operators.numbering import ordinal, previous


def greedy(rows):
    """The merge rule row by row: (title, author, position) -> entries as lists of positions."""
    entries = []
    for title, author, pos in rows:
        home = next(
            (e for e in entries if e["t"] == title and (not e["k"] or not author or e["k"] in author or author in e["k"])), None
        )
        if home is None:
            home = {"t": title, "k": author, "p": []}
            entries.append(home)
        home["k"] = home["k"] or author
        home["p"].append(pos)
    return sorted(e["p"] for e in entries)


@pytest.mark.parametrize("seed, fold_limit", [(1, 256), (1, 2), (2, 3), (3, 0)])
def test_merge_equals_greedy_rule(spark, seed, fold_limit):
    rng = random.Random(seed)
    # One title holds half of all rows.
    rows = [
        ("hot" if rng.random() < 0.5 else rng.choice("uvw"), "".join(rng.choice("abc") for _ in range(rng.randint(0, 4))), i)
        for i in range(300)
    ]
    data = [(i, "s", 0, 0, 1, t, a, "", "", "", "", f"/{i}") for t, a, i in rows]
    members = merge.merge_members(spark.createDataFrame(data, HIT_SCHEMA), fold_limit)
    got = members.groupBy("title", "leader").agg(F.sort_array(F.collect_list("source_id")).alias("p")).collect()
    assert sorted(r.p for r in got) == greedy(rows)


def test_ordinal_and_previous_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", p) for i, p in enumerate(rng.sample(range(1_000_000), 3000))]
    df = spark.createDataFrame(rows, "k string, p long")
    w = Window.partitionBy("k").orderBy("p")
    want = df.withColumn("rn", F.row_number().over(w)).withColumn("pp", F.lag("p").over(w))
    # Narrow blocks, so that numbers and rows carry over block and upper-level borders.
    got = ordinal(df, ["k"], F.floor(F.col("p") / 3), [F.asc("p")], "rn")
    got = previous(got, ["k"], F.floor(F.col("p") / 3), "p", "pp")
    assert sorted(map(tuple, got.select("k", "p", "rn", "pp").collect())) == sorted(map(tuple, want.collect()))
    alone = ordinal(df, [], F.floor(F.col("p") / 3), [F.asc("p")], "rn").collect()
    assert sorted(r.rn for r in alone) == list(range(1, 3001))


@pytest.mark.parametrize("seed", [1, 2])
def test_alternatives_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    names = ["ab", "abc", "aabbaabb", "ba", "cd", "abababab"]
    authors = ["", "x", "xy", "xyz", "q", "zq"]
    found = [
        (rng.choice(["ab", "cd"]), s := rng.randrange(4), f"s{s}", f"/b/{rng.randrange(12)}", rng.choice(names), rng.choice(authors), rng.choice(["", "c"]), rng.choice(["", "i"]))
        for _ in range(400)
    ]
    books = [(i, rng.randrange(4), rng.choice(["ab", "cd"]), rng.choice(authors)) for i in range(30)]
    f = spark.createDataFrame(found, "keyword string, source_id long, source_name string, book_url string, name string, author string, cover_url string, intro string")
    b = spark.createDataFrame(books, "book_id long, source_id long, name string, author string")
    pairs = b.select("book_id", F.col("source_id").alias("own"), F.col("name").alias("tn"), F.col("author").alias("ta")).join(f, F.col("tn") == f.keyword)
    score = match_score(F.col("name"), F.col("author"), F.col("cover_url"), F.col("intro"), F.col("tn"), F.col("ta"))
    pairs = pairs.withColumn("score", score).filter((F.col("score") >= 45) & (F.col("source_id") != F.col("own")))
    best = pairs.groupBy("book_id", "source_id", "source_name", "book_url").agg(F.max("score").alias("score"))
    w = Window.partitionBy("book_id").orderBy(F.desc("score"), "source_name", "source_id", "book_url")
    want = best.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    got = alternatives.match_alternatives(b, f, limit=5)
    cols = ["book_id", "source_id", "book_url", "score", "rank"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_number_chapters_hot_book(spark):
    rows = [(1, p, i, f"t{p}-{i}", "", True) for p in range(3) for i in range(500)] + [(2, 0, 0, "x", "", True)]
    df = spark.createDataFrame(rows, "book_id long, page int, pos int, title string, url string, is_volume boolean")
    got = library.number_chapters(df, block=50).orderBy("book_id", "idx").collect()
    assert [r.title for r in got] == [r[3] for r in rows] and [r.idx for r in got[:1500]] == list(range(1500))


def test_row_caps_are_applied_before_the_shuffle(spark):
    from folioflow.operators.search import cap_per_source

    df = spark.range(1000).select((F.col("id") % 3).alias("source_id"), F.col("id").alias("item_pos"))
    plan = cap_per_source(df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
