"""Books, chapters, shelf, progress, bookmarks, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import not_blank, strip_space, text_or_blank
from folioflow.functions.urls import book_url, url_valid
from folioflow.operators.catalog import apply_patch, first_rows
from folioflow.operators.numbering import ordinal, previous

SOURCE_GONE = "(书源已删除)"
HISTORY_KEPT = 200
CHAPTER_HITS = 300
GLOBAL_BOOKMARKS = 500


# Books -----------------------------------------------------------------------------


def count_children(books: DataFrame, children: DataFrame, out: str, key: str = "book_id") -> DataFrame:
    """Books with the number of their child rows; counted before the join."""
    counts = children.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(out))
    return books.join(counts, "id", "left").withColumn(out, F.coalesce(out, F.lit(0)))


def join_book_view(books: DataFrame, sources: DataFrame, chapters: DataFrame, shelf: DataFrame) -> DataFrame:
    """Public book rows: source name, chapter count, shelf flag."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    on_shelf = shelf.select(F.col("book_id").alias("id")).distinct().withColumn("_s", F.lit(True))
    out = count_children(books, chapters, "chapter_count")
    return (
        out.join(names, "source_id", "left")
        .join(on_shelf, "id", "left")
        .withColumn("source_name", F.coalesce("source_name", F.lit(SOURCE_GONE)))
        .withColumn("in_shelf", F.coalesce("_s", F.lit(False)))
        .drop("_s")
    )


def needs_info(books: DataFrame) -> DataFrame:
    """Books without contents link, intro or cover."""
    blank = [text_or_blank(F.col(c)) == "" for c in ("toc_url", "intro", "cover")]
    return books.filter(blank[0] | blank[1] | blank[2])


def resolve_book(books: DataFrame, hits: DataFrame, sources: DataFrame, details: DataFrame) -> DataFrame:
    """Upsert hits into the books on (source_id, book_url) and fill in details.

    Links are completed first. A book stored under the relative form of a link moves to the
    complete one. ``details`` (source_id, book_url and the nine fields) never blanks a field.
    """
    base = sources.select(F.col("id").alias("source_id"), F.col("url").alias("_site"))
    text_cols = ["name", "author", "kind", "intro", "cover", "last_chapter", "word_count"]

    def complete(df: DataFrame) -> DataFrame:
        return (
            df.join(base, "source_id")
            .withColumn("_raw", strip_space(text_or_blank(F.col("book_url"))))
            .filter(F.col("_raw") != "")
            .withColumn("book_url", book_url(F.col("_raw"), F.col("_site")))
        )

    stored = complete(books)
    # Two stored forms of one link: the complete one is the book.
    keep = F.min_by(
        F.struct("id", *text_cols, "toc_url"), F.struct((F.col("_raw") != F.col("book_url")), F.col("id"))
    )
    stored = stored.groupBy("source_id", "book_url").agg(keep.alias("b")).select("source_id", "book_url", "b.*")
    incoming = complete(hits).groupBy("source_id", "book_url").agg(
        F.min_by(F.struct(*[text_or_blank(F.col(c)).alias(c) for c in text_cols]), "item_pos").alias("h")
    )
    extra = complete(details).groupBy("source_id", "book_url").agg(
        F.first(F.struct(*[text_or_blank(F.col(c)).alias(c) for c in [*text_cols, "toc_url"]])).alias("d")
    )
    merged = stored.join(incoming, ["source_id", "book_url"], "full").join(extra, ["source_id", "book_url"], "left")
    old = {c: F.coalesce(F.col(c), F.col(f"h.{c}"), F.lit("")) for c in text_cols}
    lacking = (
        (text_or_blank(F.col("toc_url")) == "") | (old["intro"] == "") | (old["cover"] == "")
    ) & F.col("d").isNotNull()

    def enriched(c: str) -> Column:
        return F.when(lacking & not_blank(F.col(f"d.{c}")), F.col(f"d.{c}")).otherwise(old[c])

    toc = text_or_blank(F.col("toc_url"))
    new_toc = (
        F.when(lacking & not_blank(F.col("d.toc_url")), F.col("d.toc_url"))
        .when(lacking | (toc == ""), F.col("book_url"))
        .otherwise(toc)
    )
    return merged.select(
        "id", "source_id", "book_url", *[enriched(c).alias(c) for c in text_cols], new_toc.alias("toc_url"),
        F.col("id").isNull().alias("is_new"),
    )


def toc_candidates(books: DataFrame, sources: DataFrame, toc_counts: DataFrame, refreshed: DataFrame) -> DataFrame:
    """First contents link of each book that has chapters.

    Tried in order: the stored link when it is valid, the book link, the refreshed link.
    ``toc_counts``: url, chapters. ``refreshed``: id, fresh_url. Books without any http(s)
    link are reported as broken records.
    """
    site = sources.select(F.col("id").alias("source_id"), F.col("url").alias("_site"))
    c = books.join(site, "source_id").join(refreshed, "id", "left")
    toc = F.when(url_valid(F.col("toc_url")), book_url(F.col("toc_url"), F.col("_site"))).otherwise("")
    own = book_url(F.col("book_url"), F.col("_site"))
    fresh = book_url(F.coalesce("fresh_url", F.lit("")), F.col("_site"))
    c = c.select("id", F.array(toc, own).alias("first"), fresh.alias("fresh"))
    usable = F.exists("first", lambda u: u.rlike("(?i)^https?://"))
    c = c.select("id", usable.alias("usable"), F.posexplode(F.concat("first", F.array("fresh"))).alias("priority", "url"))
    tried = c.join(toc_counts.filter(F.col("chapters") > 0), "url", "left")
    hit = F.col("usable") & F.col("chapters").isNotNull() & (F.col("url") != "")
    best = F.min_by(F.when(hit, F.struct("url", "chapters")), F.when(hit, F.col("priority")))
    return tried.groupBy("id").agg(best.alias("b"), F.max("usable").alias("usable")).select(
        "id",
        F.coalesce("b.url", F.lit("")).alias("toc_url"),
        F.coalesce("b.chapters", F.lit(0)).cast("long").alias("chapters"),
        F.when(~F.col("usable"), "BOOK_RECORD_BROKEN").when(F.col("b").isNull(), "RULE_ERROR").otherwise("").alias("error"),
    )


def delete_books(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given books."""
    out = {}
    for name, df in tables.items():
        key = "id" if name == "books" else "book_id"
        out[name] = df.join(ids.select(F.col("id").alias(key)), key, "left_anti")
    return out


# Chapters --------------------------------------------------------------------------


def join_cached_flag(chapters: DataFrame, contents: DataFrame) -> DataFrame:
    """Chapters with whether their text is stored."""
    stored = contents.select("book_id", "idx").distinct().withColumn("_c", F.lit(True))
    return (
        chapters.join(stored, ["book_id", "idx"], "left")
        .withColumn("cached", F.coalesce("_c", F.lit(False)))
        .drop("_c")
    )


def anti_pending(chapters: DataFrame, contents: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Chapters in [start, end] with a link and without stored text; bounds clamped to the list."""
    totals = chapters.groupBy("book_id").agg(F.count("*").cast("int").alias("total"))
    last = F.greatest(F.col("total") - 1, F.lit(0))
    low = F.greatest(F.lit(0), F.least(F.lit(start), last))
    high = F.greatest(low, F.least(F.lit(end) if end is not None else last, F.col("total") - 1))
    picked = chapters.join(totals, "book_id").filter(F.col("idx").between(low, high) & (text_or_blank(F.col("url")) != ""))
    return picked.drop("total").join(contents.select("book_id", "idx"), ["book_id", "idx"], "left_anti")


def cache_state(books: DataFrame, chapters: DataFrame, contents: DataFrame) -> DataFrame:
    """Stored and total chapters per book."""
    out = count_children(books.select("id"), contents, "cached")
    return count_children(out, chapters, "total")


def search_chapters(chapters: DataFrame, q: str, limit: int | None = CHAPTER_HITS) -> DataFrame:
    """Chapters whose title contains the text, the first ``limit`` per book (None: all)."""
    kw = q.strip()
    if not kw:
        return chapters.limit(0)
    w = Window.partitionBy("book_id").orderBy("idx")
    found = chapters.filter(F.col("title").ilike(f"%{kw}%"))
    if limit is None:
        return found
    return found.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def filter_toc(chapters: DataFrame, text: str, descending: bool = False) -> DataFrame:
    """Chapters whose title contains the text, in list order or reversed."""
    found = chapters.filter(F.lower(text_or_blank(F.col("title"))).contains(text.lower()))
    return found.orderBy("book_id", F.desc("idx") if descending else F.asc("idx"))


def dedupe_chapters(rows: DataFrame) -> DataFrame:
    """First row per link in page order; rows without a link are volume titles and stay.

    ``rows``: book_id, page, pos, title, url, is_volume_text.
    """
    named = rows.withColumn("title", strip_space(text_or_blank(F.col("title")))).filter(F.col("title") != "")
    yes = strip_space(text_or_blank(F.col("is_volume_text"))).rlike("(?i)^(true|1|是|yes)$")
    linked = (
        named.filter(F.col("url") != "")
        .groupBy("book_id", "url")
        .agg(F.min(F.struct("page", "pos", "title", yes.alias("is_volume"))).alias("c"))
        .select("book_id", "c.page", "c.pos", "c.title", "url", "c.is_volume")
    )
    volumes = named.filter(F.col("url") == "").select(
        "book_id", "page", "pos", "title", "url", F.lit(True).alias("is_volume")
    )
    return linked.unionByName(volumes)


def number_chapters(rows: DataFrame, block: int = 10000) -> DataFrame:
    """0-based index in (page, pos) order per book."""
    blocks = F.col("page").cast("long") * 1_000_000 + F.floor(F.col("pos") / block)
    numbered = ordinal(rows, ["book_id"], blocks, [F.asc("page"), F.asc("pos")], "_n")
    return numbered.withColumn("idx", (F.col("_n") - 1).cast("int")).drop("_n", "page", "pos")


def chapter_neighbors(chapters: DataFrame) -> DataFrame:
    """Previous and next index (-1 at the ends) and the total.

    Indexes are consecutive, so counts are enough and no book has to be sorted.
    """
    totals = chapters.groupBy("book_id").agg(F.count("*").cast("int").alias("total"))
    idx, nxt = F.col("idx"), F.col("idx") + 1
    return chapters.join(totals, "book_id").select(
        "book_id", "idx",
        F.when(idx > 0, idx - 1).otherwise(-1).alias("prev_index"),
        F.when(nxt < F.col("total"), nxt).otherwise(-1).alias("next_index"),
        "total",
    )


# Shelf -----------------------------------------------------------------------------


def join_shelf(shelf: DataFrame, books: DataFrame, progress: DataFrame) -> DataFrame:
    """Shelf entries with their book and reading state, in shelf order."""
    b = books.select(F.col("id").alias("book_id"), "name", "author")
    return (
        shelf.join(b, "book_id")
        .join(progress.select("book_id", "chapter_index", "read_seconds"), "book_id", "left")
        .orderBy("sort_order", F.desc("added_at"), "book_id")
    )


def group_counts(shelf: DataFrame) -> DataFrame:
    """Shelf entries per group, with the total under ``*`` and the ungrouped under a blank."""
    g = text_or_blank(F.col("group_name")).alias("group_name")
    return shelf.select(g).rollup("group_name").agg(F.count("*").alias("n"), F.grouping("group_name").alias("all")).select(
        F.when(F.col("all") == 1, "*").otherwise(F.col("group_name")).alias("group_name"), "n"
    )


def next_sort_order(shelf: DataFrame, added: DataFrame, block: int = 65536) -> DataFrame:
    """The shelf after adding books (book_id, group_name, added_at).

    New entries continue after the highest sort order, in book_id order; books already on
    the shelf only take over a non-empty group.
    """
    top = shelf.agg(F.coalesce(F.max("sort_order"), F.lit(0))).scalar()
    again = added.select("book_id", F.nullif(text_or_blank(F.col("group_name")), F.lit("")).alias("group_name"))
    kept = apply_patch(shelf, again, "book_id", ["group_name"])
    new = added.join(shelf.select("book_id"), "book_id", "left_anti")
    new = ordinal(new, [], F.floor(F.col("book_id") / block), [F.asc("book_id")], "_n")
    new = new.select(
        "book_id", text_or_blank(F.col("group_name")).alias("group_name"),
        (top + F.col("_n")).cast("int").alias("sort_order"), "added_at",
    )
    return kept.select(*new.columns).unionByName(new)


def patch_shelf(shelf: DataFrame, patch: DataFrame) -> DataFrame:
    return apply_patch(shelf, patch, "book_id", ["group_name", "sort_order"])


# Progress --------------------------------------------------------------------------


# Position fields and what a book has before any event gave them.
POSITION = {"chapter_index": 0, "chapter_title": "", "chapter_pos": 0.0, "percent": 0.0}


def progress_state(events: DataFrame) -> DataFrame:
    """Reading state per book: the latest given value of each position field, and the counted seconds.

    A field that an event leaves out keeps its earlier value, each on its own; one that
    no event has keeps its start value. All parts are partial aggregates, so a
    book with a third of all events is reduced before the shuffle.
    """

    def last(name: str, start: object) -> Column:
        if name not in events.columns:
            return F.lit(start).alias(name)
        at = F.when(F.col(name).isNotNull(), F.struct("ts", "event_id"))
        return F.coalesce(F.max_by(name, at), F.lit(start)).alias(name)

    counted = F.when((F.col("add_seconds") > 0) & (F.col("add_seconds") < 3600), F.col("add_seconds")).otherwise(0)
    return events.groupBy("book_id").agg(
        *(last(name, start) for name, start in POSITION.items()),
        F.sum(counted).cast("long").alias("read_seconds"),
        F.max("ts").alias("updated_at"),
    )


def heartbeat_seconds(ticks: DataFrame, block_seconds: int = 900) -> DataFrame:
    """Reading seconds per book from visible ticks; gaps of 600 s and more do not count.

    A book's ticks are cut into blocks of ``block_seconds``, so one that holds a third of all is spread over tasks.
    """
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    prev = previous(ticks, ["book_id"], F.floor(seconds / block_seconds), "ts", "prev_ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))
    delta = F.floor(micros / 1_000_000 + 0.5)
    counted = F.when((delta > 0) & (delta < 600), delta).otherwise(0)
    return prev.groupBy("book_id").agg(F.sum(counted).cast("long").alias("seconds"), F.count("*").alias("ticks"))


# Bookmarks and history -------------------------------------------------------------


def order_bookmarks(bookmarks: DataFrame) -> DataFrame:
    """Bookmarks of each book in reading order."""
    return bookmarks.orderBy("book_id", "chapter_index", "pos", "id")


def newest_bookmarks(bookmarks: DataFrame, limit: int = GLOBAL_BOOKMARKS) -> DataFrame:
    return bookmarks.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def filter_notes(bookmarks: DataFrame) -> DataFrame:
    return bookmarks.filter(not_blank(F.col("note")))


def patch_bookmark(bookmarks: DataFrame, patch: DataFrame) -> DataFrame:
    return apply_patch(bookmarks, patch, "id", ["note", "text"])


def latest_history(history: DataFrame, kept: int = HISTORY_KEPT) -> DataFrame:
    """Newest entry per (keyword, type), the newest ``kept`` of them; blank keywords are ignored."""
    kw = strip_space(text_or_blank(F.col("keyword")))
    rows = history.withColumn("keyword", kw).filter(F.col("keyword") != "")
    newest = rows.groupBy("keyword", "type").agg(F.max(F.struct("created_at", "id")).alias("h"))
    return newest.select("h.id", "keyword", "type", "h.created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(kept)


def recent_history(history: DataFrame, limit: int | None = 20) -> DataFrame:
    """The newest ``limit`` entries; None means all."""
    return first_rows(history, [F.desc("created_at"), F.desc("id")], limit)


def service_stats(
    sources: DataFrame, books: DataFrame, shelf: DataFrame, contents: DataFrame,
    bookmarks: DataFrame, progress: DataFrame, history: DataFrame,
) -> DataFrame:
    """The eight service counters in one row."""
    parts = [
        sources.agg(F.count("*").alias("a"), F.count_if("enabled").alias("b")).selectExpr(
            "stack(2, 'source_total', a, 'source_enabled', b) as (metric, value)"
        ),
        progress.agg(F.coalesce(F.sum("read_seconds"), F.lit(0)).cast("long").alias("value")).select(
            F.lit("read_seconds").alias("metric"), "value"
        ),
    ]
    tables = {"book_total": books, "shelf_total": shelf, "chapter_cached": contents, "bookmark_total": bookmarks, "search_total": history}
    for name, df in tables.items():
        parts.append(df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = ["source_total", "source_enabled", "book_total", "shelf_total", "chapter_cached", "bookmark_total", "read_seconds", "search_total"]
    return rows.agg(*[F.sum(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
