"""Books, chapters, shelf, progress, bookmarks and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions.ranking import overall_percent as percent_of
from folioflow.operators import catalog
from folioflow.operators import library as lib
from folioflow.plans.registry import query
from folioflow.plans.views import load, sql_for

BOOK_TEXT = ["name", "author", "kind", "intro", "cover", "last_chapter", "word_count"]


@query("join_book_view", sql_for("books", "sources", "chapters", "shelf", extra={"few": "select * from sources where id % 9 <> 4"}, body="select b.id, b.name, coalesce(s.name, '(书源已删除)') as source_name, coalesce(c.n, 0) as chapter_count, h.book_id is not null as in_shelf from books b left join few s on s.id = b.source_id left join (select book_id, count(*) as n from chapters group by book_id) c on c.book_id = b.id left join (select distinct book_id from shelf) h on h.book_id = b.id"))
def join_book_view(spark, d):
    few = load(spark, d, "sources").filter(F.col("id") % 9 != 4)
    out = lib.join_book_view(load(spark, d, "books"), few, load(spark, d, "chapters"), load(spark, d, "shelf"))
    return out.select("id", "name", "source_name", "chapter_count", "in_shelf")


@query("book_view", sql_for("books", "sources", "chapters", "shelf", body="select source_name, count(*) as books, sum(chapter_count) as chapters, count(*) filter (where in_shelf) as on_shelf from (select coalesce(s.name, '(书源已删除)') as source_name, coalesce(c.n, 0) as chapter_count, h.book_id is not null as in_shelf from books b left join sources s on s.id = b.source_id left join (select book_id, count(*) as n from chapters group by book_id) c on c.book_id = b.id left join shelf h on h.book_id = b.id) v group by source_name"))
def book_view(spark, d):
    view = lib.join_book_view(load(spark, d, "books"), load(spark, d, "sources"), load(spark, d, "chapters"), load(spark, d, "shelf"))
    return view.groupBy("source_name").agg(
        F.count("*").alias("books"), F.sum("chapter_count").alias("chapters"), F.count_if("in_shelf").alias("on_shelf")
    )


@query("join_shelf", sql_for("shelf", "books", "progress", body="select s.book_id, b.name, s.group_name, s.sort_order, s.added_at, p.chapter_index, cast(p.read_seconds as bigint) as read_seconds from shelf s join books b on b.id = s.book_id left join progress p on p.book_id = s.book_id"))
def join_shelf(spark, d):
    progress = lib.progress_state(load(spark, d, "progress_events"))
    return lib.join_shelf(load(spark, d, "shelf"), load(spark, d, "books"), progress).select(
        "book_id", "name", "group_name", "sort_order", "added_at", "chapter_index", "read_seconds"
    )


@query("join_cached_flag", sql_for("chapters", "contents", body="select c.book_id, c.idx, c.title, t.book_id is not null as cached from chapters c left join (select distinct book_id, idx from contents) t on t.book_id = c.book_id and t.idx = c.idx"))
def join_cached_flag(spark, d):
    return lib.join_cached_flag(load(spark, d, "chapters"), load(spark, d, "contents")).select("book_id", "idx", "title", "cached")


@query("anti_pending", sql_for("chapters", "contents", extra={"t": "select book_id, cast(count(*) as int) as total from chapters group by book_id", "b": "select book_id, total, greatest(0, least(1, greatest(total - 1, 0))) as low from t"}, body="select c.book_id, c.idx, c.url from chapters c join b on b.book_id = c.book_id where c.idx between b.low and greatest(b.low, least(5, b.total - 1)) and c.url <> '' and not exists (select 1 from contents x where x.book_id = c.book_id and x.idx = c.idx)"))
def anti_pending(spark, d):
    return lib.anti_pending(load(spark, d, "chapters"), load(spark, d, "contents"), 1, 5).select("book_id", "idx", "url")


@query("cache_state", sql_for("books", "chapters", "contents", body="select b.id, coalesce(t.n, 0) as cached, coalesce(c.n, 0) as total from books b left join (select book_id, count(*) as n from contents group by book_id) t on t.book_id = b.id left join (select book_id, count(*) as n from chapters group by book_id) c on c.book_id = b.id"))
def cache_state(spark, d):
    return lib.cache_state(load(spark, d, "books"), load(spark, d, "chapters"), load(spark, d, "contents"))


@query("count_children", sql_for("books", "bookmarks", body="select b.id, coalesce(m.n, 0) as bookmarks from books b left join (select book_id, count(*) as n from bookmarks group by book_id) m on m.book_id = b.id"))
def count_children(spark, d):
    return lib.count_children(load(spark, d, "books").select("id"), load(spark, d, "bookmarks"), "bookmarks")


@query("needs_info", sql_for("books", body="select id from books where toc_url = '' or intro = '' or id % 4 = 0"))
def needs_info(spark, d):
    cover = F.when(F.col("id") % 4 == 0, "").otherwise("/c.jpg")
    return lib.needs_info(load(spark, d, "books").withColumn("cover", cover)).select("id")


@query("patch_nonblank", sql_for("books", body="select id, case when id % 2 = 0 then concat('new ', id) else name end as name, author, case when id % 2 = 0 or id % 3 = 0 then 2 else 1 end as updated_at, case when id % 3 = 0 then 'patched' else intro end as intro from books"))
def patch_nonblank(spark, d):
    books = load(spark, d, "books").withColumn("updated_at", F.lit(1))
    patch = books.select(
        "id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new "), F.col("id").cast("string"))).otherwise("  ").alias("name"),
        F.lit("").alias("author"), F.when(F.col("id") % 3 == 0, "patched").alias("intro"),
    )
    out = catalog.patch_nonblank(books, patch, "id", ["name", "author", "intro"], F.lit(2))
    return out.select("id", "name", "author", "updated_at", "intro")


RESOLVE_STEPS = {
    "stored": "select b.id, b.source_id, concat(s.url, b.book_url) as book_url, b.name, b.author, b.kind, b.intro, b.toc_url from books b join sources s on s.id = b.source_id",
    "came": "select h.source_id, concat(s.url, h.book_url) as book_url, h.name, h.author, h.kind, h.intro, h.cover_url from hits h join sources s on s.id = h.source_id",
    "merged": """select s.id, coalesce(s.source_id, c.source_id) as source_id, coalesce(s.book_url, c.book_url) as book_url, coalesce(s.name, c.name) as name, coalesce(s.intro, c.intro) as intro0, coalesce(s.toc_url, '') as toc0,
      case when s.id is not null then '' else c.cover_url end as cover0 from stored s full join came c on s.source_id = c.source_id and s.book_url = c.book_url""",
    "lacking": "select *, (toc0 = '' or intro0 = '' or cover0 = '') and source_id % 2 = 0 as lack from merged",
}


@query("resolve_book", sql_for("books", "hits", "sources", extra=RESOLVE_STEPS, body="select id, source_id, book_url, name, case when lack then 'about' else intro0 end as intro, case when lack or toc0 = '' then book_url else toc0 end as toc_url, id is null as is_new from lacking"))
def resolve_book(spark, d):
    sources = load(spark, d, "sources")
    blank = {c: F.lit("") for c in ("cover", "last_chapter", "word_count")}
    books = load(spark, d, "books").withColumns(blank)
    hits = load(spark, d, "hits").withColumn("cover", F.col("cover_url")).withColumn("word_count", F.lit(""))
    details = load(spark, d, "hits", positions=False).filter(F.col("source_id") % 2 == 0).select(
        "source_id", "book_url", *[F.lit("").alias(c) for c in ("name", "author", "kind", "cover", "last_chapter", "word_count", "toc_url")],
        F.lit("about").alias("intro"),
    )
    out = lib.resolve_book(books, hits, sources, details)
    return out.select("id", "source_id", "book_url", "name", "intro", "toc_url", "is_new")


@query("toc_candidates", sql_for("books", "sources", extra={
    "c": "select b.id, case when b.id % 7 = 0 then '' when b.id % 5 = 0 then '' else b.toc_url end as toc, concat(s.url, b.book_url) as own, concat(s.url, '/fresh/', b.id) as fresh from books b join sources s on s.id = b.source_id",
}, body="select id, case when toc <> '' and id % 3 = 0 then toc when id % 2 = 0 then own when id % 11 = 0 then fresh else '' end as toc_url, case when toc <> '' and id % 3 = 0 then 30 when id % 2 = 0 then 20 when id % 11 = 0 then 10 else 0 end as chapters, case when (toc <> '' and id % 3 = 0) or id % 2 = 0 or id % 11 = 0 then '' else 'RULE_ERROR' end as error from c"))
def toc_candidates(spark, d):
    sources, books = load(spark, d, "sources"), load(spark, d, "books")
    i = F.col("id")
    broken = F.when(i % 5 == 0, F.concat(F.lit('["'), "toc_url", F.lit('"]'))).otherwise(F.col("toc_url"))
    own = books.join(sources.select(i.alias("source_id"), F.col("url").alias("site")), "source_id")
    counts = (
        books.filter((i % 3 == 0) & (F.col("toc_url") != "")).select(F.col("toc_url").alias("url"), F.lit(30).alias("chapters"))
        .unionByName(own.filter(i % 2 == 0).select(F.concat("site", "book_url").alias("url"), F.lit(20).alias("chapters")))
        .unionByName(own.select(F.concat("site", F.lit("/fresh/"), i.cast("string")).alias("url"), F.when(i % 11 == 0, 10).otherwise(0).alias("chapters")))
    )
    fresh = books.select("id", F.concat(F.lit("/fresh/"), i.cast("string")).alias("fresh_url"))
    out = lib.toc_candidates(books.withColumn("toc_url", broken), sources, counts, fresh)
    return out.withColumn("chapters", F.col("chapters").cast("int"))


# Chapters ---------------------------------------------------------------------------


@query("search_chapters", sql_for("chapters", body="select book_id, idx, title from (select *, row_number() over (partition by book_id order by idx) as rn from chapters where title ilike '%EN%') c where rn <= 300"))
def search_chapters(spark, d):
    return lib.search_chapters(load(spark, d, "chapters"), " EN ").select("book_id", "idx", "title")


@query("filter_toc", sql_for("chapters", body="select book_id, idx, title from chapters where contains(lower(title), 'er')"))
def filter_toc(spark, d):
    return lib.filter_toc(load(spark, d, "chapters"), "ER", descending=True).select("book_id", "idx", "title")


# Contents pages as a crawler lands them: 20 rows a page, the last link repeated on the next page.
TOC_ROWS = """select l_suppkey as book_id, cast(floor((item_pos - 1) / 20) as int) as page, cast((item_pos - 1) % 20 as int) as pos, case when item_pos % 50 = 0 then ' ' else name end as title, case when item_pos % 30 = 0 then '' else concat('/c/', cast(item_pos % 70 as varchar(9))) end as url, case when item_pos % 40 = 1 then '是' else 'no' end as is_volume_text from (select source_id as l_suppkey, item_pos, name from hits) h"""


def toc_rows(spark, d):
    load(spark, d, "hits").createOrReplaceTempView("hits")
    return spark.sql(TOC_ROWS)


DEDUPED = {
    "rows_": TOC_ROWS,
    "ranked": "select *, row_number() over (partition by book_id, url order by page, pos) as rn from rows_ where trim(title) <> ''",
    "kept": "select book_id, page, pos, title, url, case when url = '' then true else is_volume_text = '是' end as is_volume from ranked where url = '' or rn = 1",
}


@query("dedupe_chapters", sql_for("hits", extra=DEDUPED, body="select * from kept"))
def dedupe_chapters(spark, d):
    return lib.dedupe_chapters(toc_rows(spark, d))


@query("number_chapters", sql_for("hits", extra=DEDUPED, body="select book_id, cast(row_number() over (partition by book_id order by page, pos) - 1 as int) as idx, title, url, is_volume from kept"))
def number_chapters(spark, d):
    return lib.number_chapters(lib.dedupe_chapters(toc_rows(spark, d))).select("book_id", "idx", "title", "url", "is_volume")


@query("chapter_neighbors", sql_for("chapters", body="select book_id, idx, coalesce(lag(idx) over (partition by book_id order by idx), -1) as prev_index, coalesce(lead(idx) over (partition by book_id order by idx), -1) as next_index, cast(count(*) over (partition by book_id) as int) as total from chapters"))
def chapter_neighbors(spark, d):
    return lib.chapter_neighbors(load(spark, d, "chapters"))


# Shelf ------------------------------------------------------------------------------


@query("group_counts", sql_for("shelf", body="select group_name, count(*) as n from shelf group by group_name union all select '*', count(*) from shelf"))
def group_counts(spark, d):
    return lib.group_counts(load(spark, d, "shelf"))


@query("next_sort_order", sql_for("shelf", "books", extra={
    "new": "select b.id as book_id, cast(row_number() over (order by b.id) + (select coalesce(max(sort_order), 0) from shelf) as int) as sort_order from books b where b.id not in (select book_id from shelf)",
}, body="select book_id, case when book_id % 2 = 0 then 'again' else group_name end as group_name, sort_order from shelf union all select book_id, case when book_id % 2 = 0 then 'again' else '' end, sort_order from new"))
def next_sort_order(spark, d):
    added = load(spark, d, "books").select(
        F.col("id").alias("book_id"), F.when(F.col("id") % 2 == 0, "again").otherwise("").alias("group_name"),
        F.lit(5).cast("long").alias("added_at"),
    )
    return lib.next_sort_order(load(spark, d, "shelf"), added).select("book_id", "group_name", "sort_order")


@query("patch_shelf", sql_for("shelf", body="select book_id, case when book_id % 2 = 0 then 'g' else group_name end as group_name, case when book_id % 3 = 0 then 9 else sort_order end as sort_order, added_at from shelf"))
def patch_shelf(spark, d):
    shelf = load(spark, d, "shelf")
    patch = shelf.select(
        "book_id", F.when(F.col("book_id") % 2 == 0, "g").alias("group_name"), F.when(F.col("book_id") % 3 == 0, 9).alias("sort_order")
    )
    return lib.patch_shelf(shelf, patch)


# Progress ---------------------------------------------------------------------------


@query("progress_state", sql_for("progress", "progress_events", body="select p.book_id, p.chapter_index, p.chapter_title, p.chapter_pos, p.percent, cast(p.read_seconds as bigint) as read_seconds, m.updated_at from progress p join (select book_id, max(ts) as updated_at from progress_events group by book_id) m on m.book_id = p.book_id"))
def progress_state(spark, d):
    return lib.progress_state(load(spark, d, "progress_events"))


@query("heartbeat_seconds", sql_for("progress_events", extra={
    "t": "select book_id, ts, lag(ts) over (partition by book_id order by ts) as prev from progress_events",
    "g": "select book_id, floor((epoch_us(ts) - epoch_us(prev)) / 1000000.0 + 0.5) as delta from t",
}, body="select book_id, cast(sum(case when delta > 0 and delta < 600 then delta else 0 end) as bigint) as seconds, count(*) as ticks from g group by book_id"))
def heartbeat_seconds(spark, d):
    return lib.heartbeat_seconds(load(spark, d, "progress_events"))


@query("overall_percent", sql_for("bookmarks", "chapters", body="select b.id, round(least(greatest((b.chapter_index + b.pos) / case when coalesce(c.n, 0) = 0 then 1 else c.n end, 0.0), 1.0), 6) as percent from bookmarks b left join (select book_id, count(*) as n from chapters group by book_id) c on c.book_id = b.book_id"))
def overall_percent(spark, d):
    totals = load(spark, d, "chapters").groupBy("book_id").agg(F.count("*").alias("n"))
    rows = load(spark, d, "bookmarks").join(totals, "book_id", "left")
    return rows.select("id", F.round(percent_of(F.col("chapter_index"), F.col("pos"), F.col("n")), 6).alias("percent"))


# Bookmarks, history, counters -------------------------------------------------------


@query("order_bookmarks", sql_for("bookmarks", body="select id, book_id, chapter_index, pos, created_at from bookmarks order by created_at desc, id desc limit 500"))
def order_bookmarks(spark, d):
    newest = lib.newest_bookmarks(load(spark, d, "bookmarks"))
    return lib.order_bookmarks(newest).select("id", "book_id", "chapter_index", "pos", "created_at")


@query("filter_notes", sql_for("bookmarks", body="select id, book_id, note from bookmarks where trim(note) <> ''"))
def filter_notes(spark, d):
    return lib.filter_notes(load(spark, d, "bookmarks")).select("id", "book_id", "note")


@query("patch_bookmark", sql_for("bookmarks", body="select id, case when id % 2 = 0 then 'n' else note end as note, case when id % 3 = 0 then 't' else text end as text from bookmarks"))
def patch_bookmark(spark, d):
    marks = load(spark, d, "bookmarks")
    patch = marks.select("id", F.when(F.col("id") % 2 == 0, "n").alias("note"), F.when(F.col("id") % 3 == 0, "t").alias("text"))
    return lib.patch_bookmark(marks, patch).select("id", "note", "text")


@query("latest_history", sql_for("search_history", body="select id, keyword, type, created_at from (select *, row_number() over (partition by keyword, type order by created_at desc, id desc) as rn from search_history where trim(keyword) <> '') h where rn = 1 order by created_at desc, id desc limit 200"))
def latest_history(spark, d):
    return lib.latest_history(load(spark, d, "search_history"))


@query("recent_history", sql_for("search_history", body="select id, keyword, type, created_at from search_history order by created_at desc, id desc limit 20"))
def recent_history(spark, d):
    return lib.recent_history(load(spark, d, "search_history"))


@query("service_stats", sql_for("sources", "books", "shelf", "contents", "bookmarks", "progress", "search_history", body="""select (select count(*) from sources) as source_total, (select count(*) from sources where enabled) as source_enabled, (select count(*) from books) as book_total, (select count(*) from shelf) as shelf_total,
 (select count(*) from contents) as chapter_cached, (select count(*) from bookmarks) as bookmark_total, (select cast(coalesce(sum(read_seconds), 0) as bigint) from progress) as read_seconds, (select count(*) from search_history) as search_total"""))
def service_stats(spark, d):
    t = {n: load(spark, d, n) for n in ("sources", "books", "shelf", "contents", "bookmarks", "search_history")}
    return lib.service_stats(
        t["sources"], t["books"], t["shelf"], t["contents"], t["bookmarks"],
        lib.progress_state(load(spark, d, "progress_events")), t["search_history"],
    )
