"""Search over all sources: union, merge, rank, filter; alternatives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import ranking
from folioflow.operators import alternatives as alt
from folioflow.operators import merge, search
from folioflow.operators.library import progress_state
from folioflow.plans.columns import clean_author_sql, dedupe_key_sql, norm_keyword_sql, norm_title_sql
from folioflow.plans.registry import query
from folioflow.plans.views import load, sql_for

QUERY = "red"
ORDER = "weight desc, sort_order, source_id, item_pos"


def relevance_sql(q: str = QUERY) -> str:
    n, a = "lower(name)", "lower(author)"
    every = " and ".join(f"contains({n}, '{c}')" for c in sorted(set(q)))
    return f"""least(120, case when {n} = '{q}' then 100 when starts_with({n}, '{q}') then 82 when contains({n}, '{q}') then 62 when {every} then 28 else 0 end
      + case when {a} = '' then 0 when {a} = '{q}' then 95 when contains({a}, '{q}') then 52 when contains('{q}', {a}) then 30 else 0 end
      + case when cover_url <> '' then 2 else 0 end + case when intro <> '' then 2 else 0 end + case when last_chapter <> '' then 1 else 0 end)"""


SCORE = f"round({relevance_sql()} + least(8.0, weight / 25.0), 6)"
RICH = "(case when intro <> '' then 1 else 0 end + case when cover_url <> '' then 1 else 0 end + case when last_chapter <> '' then 1 else 0 end + case when kind <> '' then 1 else 0 end)"


def sources_ready(spark, d):
    return load(spark, d, "catalog").filter(F.col("enabled") & (F.col("search_url") != ""))


def ranked(spark, d):
    return search.union_hits(load(spark, d, "hits"), sources_ready(spark, d))


def scored(spark, d, hits=None):
    out = search.with_score(ranked(spark, d) if hits is None else hits, QUERY)
    return out.withColumn("score", F.round("score", 6))


# Hits -------------------------------------------------------------------------------


@query("make_hit", sql_for("hits", "sources", extra={
    "raw": "select h.*, s.name as source_name, s.url as site from hits h join sources s on h.source_id = s.id where h.item_pos % 11 <> 0",
}, body=f"""select concat(source_id, '|', site, book_url) as key, source_id, source_name, name, {clean_author_sql('author')} as author, case when cover_url = '' then '' else concat(site, cover_url) end as cover_url, concat(site, book_url) as book_url from raw"""))
def make_hit(spark, d):
    s = load(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "url")
    raw = load(spark, d, "hits").join(s, "source_id").select(
        "source_id", "source_name", F.concat("url", F.lit("/search?page=1")).alias("page_url"),
        F.when(F.col("item_pos") % 11 == 0, " \n").otherwise(F.concat(F.lit("　"), "name", F.lit(" "))).alias("name"),
        "author", "kind", "intro", "cover_url", "book_url", F.lit("").alias("word_count"), "last_chapter",
    )
    return search.make_hit(raw).select("key", "source_id", "source_name", "name", "author", "cover_url", "book_url")


@query("union_hits", sql_for("ranked_hits", body="select source_id, source_name, count(*) as n, max(item_pos) as last_pos, min(weight) as weight from ranked_hits group by source_id, source_name"))
def union_hits(spark, d):
    return ranked(spark, d).groupBy("source_id", "source_name").agg(
        F.count("*").alias("n"), F.max("item_pos").alias("last_pos"), F.min("weight").alias("weight")
    )


@query("cap_per_source", sql_for("hits", body="select source_id, item_pos, book_url from hits where item_pos <= 60"))
def cap_per_source(spark, d):
    return search.cap_per_source(load(spark, d, "hits")).select("source_id", "item_pos", "book_url")


@query("filter_exact", sql_for("hits", body=f"select source_id, item_pos, name, author from hits where {norm_keyword_sql('name')} = 'redring' or {norm_keyword_sql('author')} = 'redring'"))
def filter_exact(spark, d):
    return search.filter_exact(load(spark, d, "hits"), "《Red  Ring》！").select("source_id", "item_pos", "name", "author")


@query("relevance", sql_for("hits", body=f"select source_id, item_pos, {relevance_sql()} as relevance from hits"))
def relevance(spark, d):
    return search.with_relevance(load(spark, d, "hits"), QUERY).select("source_id", "item_pos", "relevance")


@query("final_score", sql_for("ranked_hits", body=f"select source_id, item_pos, {SCORE} as score from ranked_hits"))
def final_score(spark, d):
    return scored(spark, d).select("source_id", "item_pos", "score")


@query("bcast_weight", sql_for("hits", "sources", body="select h.source_id, h.item_pos, coalesce(s.weight, 0) as weight from hits h left join (select * from sources where enabled) s on h.source_id = s.id"))
def bcast_weight(spark, d):
    out = search.bcast_weight(load(spark, d, "hits"), load(spark, d, "sources").filter("enabled"))
    return out.select("source_id", "item_pos", "weight")


@query("has_more", sql_for("hits", body="select source_id, count(*) >= 20 as has_more from hits group by source_id"))
def has_more(spark, d):
    return search.has_more(load(spark, d, "hits", positions=False))


@query("search_source_stats", sql_for("catalog", "hits", body="""select c.id as source_id, c.name as source_name, c.last_test_ok as ok, case when c.last_test_ok then coalesce(h.n, 0) else 0 end as hit_count, c.respond_time as elapsed, case when c.last_test_ok then '' else c.last_test_error end as error
from catalog c left join (select source_id, count(*) as n from hits where name = '《red ring》' group by source_id) h on h.source_id = c.id where c.enabled"""))
def search_source_stats(spark, d):
    runs = load(spark, d, "catalog").filter("enabled").select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("last_test_ok").alias("ok"),
        F.col("respond_time").alias("elapsed"), F.col("last_test_error").alias("error"),
    )
    return search.search_source_stats(load(spark, d, "hits", positions=False).filter(F.col("name") == "《red ring》"), runs)


# Merge ------------------------------------------------------------------------------

AK = norm_keyword_sql(clean_author_sql("author"))
MERGE_STEPS = {
    "keyed": f"select *, {norm_title_sql('name')} as title, {AK} as ak, row_number() over (order by {ORDER}) as pos from ranked_hits",
    "firsts": "select title, ak, min(pos) as pos from keyed where title <> '' and ak <> '' group by title, ak",
    "lists": "select title, list([ak] order by pos) as ks from firsts group by title",
    "leads": """select title, ks, list_reduce(ks, lambda acc, x: case when len(list_filter(acc, lambda a: contains(a, x[1]) or contains(x[1], a))) > 0 then acc else list_concat(acc, x) end) as ls from lists""",
    "labels": """select title, k[1] as ak, list_filter(ls, lambda a: contains(a, k[1]) or contains(k[1], a))[1] as leader from (select title, ls, unnest(ks) as k from leads) u""",
    "members": """select m.*, coalesce(l.leader, g.ls[1], '') as leader from keyed m left join labels l on m.title = l.title and m.ak = l.ak left join leads g on m.title = g.title where m.title <> ''""",
    "reps": f"select *, row_number() over (partition by title, leader order by {RICH} desc, pos) as rn, count(*) over (partition by title, leader) as origin_count from members",
    "firstn": "select title, leader, string_agg(concat(source_id, '|', book_url), ',' order by pos) as origins from (select *, row_number() over (partition by title, leader order by pos) as o from members) x where o <= 12 group by title, leader",
}
ENTRY = "r.name, r.author, r.source_id, r.book_url, r.origin_count, f.origins"


def entry_columns(df):
    origins = F.array_join(
        F.transform("origins", lambda o: F.concat(o["source_id"].cast("string"), F.lit("|"), o["book_url"])), ","
    )
    return df.withColumn("origins", origins)


ALL_ORIGINS = "select title, leader, string_agg(concat(source_id, '|', book_url), ',' order by pos) as origins from members group by title, leader"


@query("merge_hits", sql_for("ranked_hits", extra={**MERGE_STEPS, "firstn": ALL_ORIGINS}, body=f"select {ENTRY} from reps r join firstn f on r.title = f.title and r.leader = f.leader where rn = 1"))
def merge_hits(spark, d):
    entries = merge.merge_hits(ranked(spark, d), origin_limit=None, origin_fields=["source_id", "book_url"])
    return entry_columns(entries).select(
        "name", "author", "source_id", "book_url", "origin_count", "origins"
    )


@query("pick_representative", sql_for("ranked_hits", extra=MERGE_STEPS, body="select title, name, author, source_id, book_url, kind, intro, cover_url, last_chapter, count_all as origin_count from (select *, count(*) over (partition by title) as count_all, row_number() over (partition by title order by " + RICH + " desc, pos) as r1 from members) m where r1 = 1"))
def pick_representative(spark, d):
    members = merge.merge_members(ranked(spark, d))
    return merge.pick_representative(members, ["title"]).drop("source_name", "weight")


@query("cap_origins", sql_for("ranked_hits", extra=MERGE_STEPS, body="select title, leader, origins from firstn"))
def cap_origins(spark, d):
    members = merge.merge_members(ranked(spark, d))
    return entry_columns(merge.cap_origins(members, ["title", "leader"]))


SIMPLE_STEPS = {
    "keyed": f"select *, {dedupe_key_sql('name', 'author')} as merge_key, {SCORE} as score, row_number() over (order by {ORDER}) as pos from ranked_hits",
    "merged": "select *, row_number() over (partition by merge_key order by score desc, pos) as rn, count(*) over (partition by merge_key) as item_count, max(case when cover_url <> '' then 1 else 0 end) over (partition by merge_key) = 1 as any_cover from keyed",
}
SIMPLE = ["merge_key", "name", "author", "source_id", "book_url", "score", "item_count", "any_cover"]


@query("merge_hits_simple", sql_for("ranked_hits", extra=SIMPLE_STEPS, body=f"select {', '.join(SIMPLE)} from merged where rn = 1"))
def merge_hits_simple(spark, d):
    return merge.merge_hits_simple(scored(spark, d)).select(*SIMPLE)


@query("filter_cover", sql_for("ranked_hits", extra=SIMPLE_STEPS, body=f"select {', '.join(SIMPLE)} from merged where rn = 1 and any_cover"))
def filter_cover(spark, d):
    return merge.filter_cover(merge.merge_hits_simple(scored(spark, d))).select(*SIMPLE)


TOP_SQL = """select name, author, source_id, source_name, book_url, score, origin_count, cast(place as int) as place from (
 select *, row_number() over (order by score desc, source_name, source_id, book_url) as place from scored) t where place <= 240"""


def _placed(best):
    """The rows with the place they have in the list, as a proof of its order."""
    place = F.row_number().over(Window.orderBy(*search.best_first()))
    return best.select("name", "author", "source_id", "source_name", "book_url", "score", "origin_count", place.alias("place"))


@query("top_search", sql_for("ranked_hits", extra={**MERGE_STEPS, "scored": f"select *, {SCORE} as score from reps where rn = 1"}, body=TOP_SQL))
def top_search(spark, d):
    entries = merge.merge_hits(ranked(spark, d))
    return _placed(search.top_search(scored(spark, d, entries)))


@query("sort_modes", sql_for("ranked_hits", extra=SIMPLE_STEPS, body="select merge_key, name, weight from merged where rn = 1"))
def sort_modes(spark, d):
    merged = merge.merge_hits_simple(scored(spark, d))
    return search.sort_modes(merged, "name").select("merge_key", "name", "weight")


@query("multi_search", sql_for("ranked_hits", extra={
    "keyed": f"select *, {dedupe_key_sql('name', 'author')} as merge_key, {SCORE} as score, row_number() over (order by {ORDER}) as pos from ranked_hits where item_pos <= 60",
    "scored": "select *, item_count as origin_count from (select *, row_number() over (partition by merge_key order by score desc, pos) as rn, count(*) over (partition by merge_key) as item_count from keyed) m where rn = 1",
}, body=TOP_SQL))
def multi_search(spark, d):
    hits = search.union_hits(search.cap_per_source(load(spark, d, "hits")), sources_ready(spark, d))
    merged = merge.merge_hits_simple(scored(spark, d, hits)).withColumnRenamed("item_count", "origin_count")
    return _placed(search.top_search(merged))


# Alternatives -----------------------------------------------------------------------


def match_sql(cn: str, ca: str, tn: str, ta: str, cover: str = "cover_url <> ''", intro: str = "intro <> ''") -> str:
    hits = f"len(list_filter(string_split({cn}, ''), lambda c: contains({tn}, c)))"
    return f"""greatest(0, least(100,
      case when {cn} = '' or {tn} = '' then 0 when {cn} = {tn} then 70 when contains({cn}, {tn}) or contains({tn}, {cn}) then 48 else cast(floor(30 * {hits} / greatest(length({tn}), 1) + 0.5) as int) end
      + case when {ca} = '' or {ta} = '' then 0 when {ca} = {ta} then 25 when contains({ca}, {ta}) or contains({ta}, {ca}) then 12 else 0 end
      + case when {cover} then 3 else 0 end + case when {intro} then 2 else 0 end))"""


@query("match_score", sql_for("found", extra={"k": f"select *, {norm_keyword_sql('name')} as cn, {norm_keyword_sql('author')} as ca, {norm_keyword_sql('keyword')} as tn from found"}, body=f"select source_id, item_pos, keyword, min({match_sql('cn', 'ca', 'tn', 'ca')}) as score from k group by source_id, item_pos, keyword"))
def match_score(spark, d):
    out = load(spark, d, "found").withColumn("score", ranking.match_score(
        F.col("name"), F.col("author"), F.col("cover_url"), F.col("intro"), F.col("keyword"), F.col("author")
    ))
    return out.groupBy("source_id", "item_pos", "keyword").agg(F.min("score").alias("score"))


FOUND_STEPS = {
    "k": f"select distinct source_id, source_name, book_url, keyword, {norm_keyword_sql('name')} as cn, {norm_keyword_sql('author')} as ca, {norm_keyword_sql('keyword')} as tn, cover_url <> '' as hc, intro <> '' as hi from found",
    "scored": f"select *, {match_sql('cn', 'ca', 'tn', 'ta', 'hc', 'hi')} as score from (select *, '' as ta from k) x",
}


@query("filter_threshold", sql_for("found", extra=FOUND_STEPS, body="select keyword, count(*) as n, sum(score) as total from scored where score >= 45 group by keyword"))
def filter_threshold(spark, d):
    found = load(spark, d, "found", positions=False).withColumn("score", ranking.match_score(
        F.col("name"), F.col("author"), F.col("cover_url"), F.col("intro"), F.col("keyword"), F.lit("")
    ))
    kept = alt.filter_threshold(found.drop("item_pos").distinct())
    return kept.groupBy("keyword").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total"))


@query("dedupe_candidates", sql_for("found", extra=FOUND_STEPS, body="select source_id, book_url, keyword, cast(score as int) as score from (select *, row_number() over (partition by source_id, book_url order by score desc, keyword desc) as rn from scored) s where rn = 1"))
def dedupe_candidates(spark, d):
    found = load(spark, d, "found", positions=False).withColumn("score", ranking.match_score(
        F.col("name"), F.col("author"), F.col("cover_url"), F.col("intro"), F.col("keyword"), F.lit("")
    ))
    best = alt.dedupe_candidates(found.select("source_id", "book_url", "keyword", "score"), [F.col("keyword")])
    return best.select("source_id", "book_url", "keyword", "score")


@query("merge_alternatives", sql_for("hits", body="select source_id, book_url, greatest(item_pos % 50, item_pos % 40) as score, case when item_pos % 40 > item_pos % 50 then 'new' else 'old' end as origin from hits"))
def merge_alternatives(spark, d):
    hits = load(spark, d, "hits")
    old = hits.select("source_id", "book_url", (F.col("item_pos") % 50).alias("score"), F.lit("old").alias("origin"))
    new = hits.select("source_id", "book_url", (F.col("item_pos") % 40).alias("score"), F.lit("new").alias("origin"))
    return alt.merge_alternatives(old, new).select("source_id", "book_url", "score", "origin")


BOOK_MATCH = {
    **FOUND_STEPS,
    "targets": f"select distinct {norm_keyword_sql('name')} as tn, {norm_keyword_sql('author')} as ta from books",
    "cands": f"select t.tn, t.ta, source_id, source_name, book_url, max({match_sql('cn', 'ca', 't.tn', 't.ta', 'hc', 'hi')}) as score from k join targets t on k.tn = t.tn group by t.tn, t.ta, source_id, source_name, book_url",
    "ranked": f"select b.id as book_id, c.source_id, c.book_url, cast(c.score as int) as score, cast(row_number() over (partition by b.id order by c.score desc, c.source_name, c.source_id, c.book_url) as int) as rank from books b join cands c on {norm_keyword_sql('b.name')} = c.tn and {norm_keyword_sql('b.author')} = c.ta where c.source_id <> b.source_id and c.score >= 45",
}


@query("match_alternatives", sql_for("found", "books", extra=BOOK_MATCH, body="select book_id, source_id, book_url, score, rank from ranked where rank <= 40"))
def match_alternatives(spark, d):
    books = load(spark, d, "books").select(F.col("id").alias("book_id"), "source_id", "name", "author")
    out = alt.match_alternatives(books, load(spark, d, "found", positions=False))
    return out.select("book_id", "source_id", "book_url", "score", "rank")


@query("top_alternatives", sql_for("hits", "sources", body="""select source_id as book_id, book_url, score, cast(rank as int) as rank from (
 select h.source_id, h.book_url, h.item_pos % 50 as score, row_number() over (partition by h.source_id order by h.item_pos % 50 desc, s.name, h.source_id, h.book_url) as rank from hits h join sources s on h.source_id = s.id) t where rank <= 40"""))
def top_alternatives(spark, d):
    s = load(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    cand = load(spark, d, "hits").join(s, "source_id").select(
        F.col("source_id").alias("book_id"), "source_id", "source_name", "book_url", (F.col("item_pos") % 50).alias("score")
    )
    return alt.top_alternatives(cand).select("book_id", "book_url", "score", "rank")


@query("pick_sources", sql_for("catalog", body="""select id, name from (select * from catalog where enabled and id <> 3
 order by case when last_test_at is not null and not last_test_ok then 1 else 0 end, weight desc, case when respond_time > 0 and respond_time < 1500 then 0 else 1 end, respond_time, id limit 40) c where search_url <> ''"""))
def pick_sources(spark, d):
    return alt.pick_sources(load(spark, d, "catalog"), own_source=3).select("id", "name")


@query("rebind_source", sql_for("books", "chapters", "progress", extra={
    "moves": "select id as book_id, source_id + 1 as new_source_id, concat(book_url, '?n') as new_book_url from books",
    "n": "select book_id, count(*) as n from chapters group by book_id",
    "m": """select v.book_id, v.new_source_id as source_id, v.new_book_url as book_url, v.new_book_url as toc_url, n.n,
      case when coalesce(n.n, 0) > 0 and p.percent > 0 then least(n.n - 1, floor(p.percent / 100.0 * n.n)) else p.chapter_index end as chapter_index,
      case when coalesce(n.n, 0) > 0 and p.percent > 0 then 0.0 else p.chapter_pos end as chapter_pos
      from moves v left join n on n.book_id = v.book_id left join progress p on p.book_id = v.book_id""",
}, body="select m.book_id, m.source_id, m.book_url, m.toc_url, cast(m.chapter_index as int) as chapter_index, cast(m.chapter_pos as double) as chapter_pos, c.title as chapter_title from m left join chapters c on c.book_id = m.book_id and c.idx = m.chapter_index"))
def rebind_source(spark, d):
    books = load(spark, d, "books").withColumnRenamed("id", "book_id")
    moves = books.select(
        "book_id", (F.col("source_id") + 1).alias("new_source_id"), F.concat("book_url", F.lit("?n")).alias("new_book_url")
    )
    progress = progress_state(load(spark, d, "progress_events"))
    return alt.rebind_source(books.select("book_id"), moves, load(spark, d, "chapters"), progress)
