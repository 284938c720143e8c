"""Search hits: projection, caps, ranking, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import ranking
from folioflow.functions.text import clean_author, not_blank, strip_space, text_or_blank
from folioflow.functions.urls import abs_url, book_url
from folioflow.operators.catalog import first_rows

SEARCH_CAP = 60
ORIGIN_CAP = 12
TOP_FACTOR = 4


def make_hit(df: DataFrame) -> DataFrame:
    """Extracted fields to hits: blank names dropped, author cleaned, links completed.

    Needs source_id, source_name, page_url and the eight extracted text fields; other
    columns pass through.
    """
    fields = ["name", "author", "kind", "intro", "cover_url", "book_url", "word_count", "last_chapter"]
    rest = [c for c in df.columns if c not in fields]
    trimmed = {f: strip_space(text_or_blank(F.col(f))) for f in fields}
    cover = abs_url(F.col("page_url"), F.col("cover_url"))
    link = book_url(F.col("book_url"), F.col("page_url"))
    out = df.filter(not_blank(F.col("name"))).select(
        *rest,
        trimmed["name"].alias("name"),
        clean_author(F.col("author")).alias("author"),
        trimmed["kind"].alias("kind"),
        trimmed["intro"].alias("intro"),
        trimmed["cover_url"].alias("cover_url"),
        cover.alias("_cover"),
        link.alias("_link"),
        trimmed["word_count"].alias("word_count"),
        trimmed["last_chapter"].alias("last_chapter"),
    )
    # The completed links are used several times and computed once.
    full = F.when(F.col("_cover") != "", F.col("_cover")).otherwise(F.col("cover_url")).alias("cover_url")
    return out.select(
        F.concat(F.col("source_id").cast("string"), F.lit("|"), F.col("_link")).alias("key"),
        *[full if c == "cover_url" else F.col(c) for c in out.columns if c not in ("_link", "_cover")],
        F.when(F.col("_link") != "", F.col("_link")).otherwise(F.col("page_url")).alias("book_url"),
    )


def union_hits(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits of all given sources with what fixes their order: weight, sort order, source, position."""
    return hits.join(
        sources.select(
            F.col("id").alias("source_id"), F.col("name").alias("source_name"), "weight", "sort_order"
        ),
        "source_id",
    )


def first_wins() -> list[Column]:
    """Sort columns under which the largest row is the first in source order."""
    return [F.col("weight"), -F.col("sort_order"), -F.col("source_id"), -F.col("item_pos")]


def cap_per_source(hits: DataFrame, limit: int = SEARCH_CAP, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """At most ``limit`` hits per source in page order.

    A row_number filter is pushed below the shuffle by Spark, so each map task sends at
    most ``limit`` rows of a source, however large the source is.
    """
    w = Window.partitionBy(*keys).orderBy("item_pos")
    return hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def with_relevance(hits: DataFrame, query: str) -> DataFrame:
    return hits.withColumn(
        "relevance",
        ranking.relevance(
            F.col("name"), F.col("author"), F.col("cover_url"), F.col("intro"), F.col("last_chapter"), query
        ),
    )


def with_score(hits: DataFrame, query: str) -> DataFrame:
    """Relevance plus the weight bonus of the (representative) source."""
    scored = with_relevance(hits, query)
    return scored.withColumn("score", ranking.final_score(F.col("relevance"), F.col("weight"))).drop("relevance")


def bcast_weight(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Look up the weight of each hit's source.

    No broadcast hint: Spark broadcasts the side when its measured size is under the
    configured limit and shuffles otherwise.
    """
    weights = sources.select(F.col("id").alias("source_id"), "weight")
    return hits.join(weights, "source_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def filter_exact(hits: DataFrame, query: str, kind: str = "all") -> DataFrame:
    return hits.filter(ranking.exact_match(F.col("name"), F.col("author"), query, kind))


def best_first() -> list[Column]:
    """Best rows first: score, then source name in locale order, the source and the link."""
    name = F.col("source_name")
    return [F.desc("score"), F.collate(name, "UNICODE").asc(), name.asc(), F.asc("source_id"), F.asc("book_url")]


def top_search(scored: DataFrame, limit: int | None = 60, factor: int = TOP_FACTOR) -> DataFrame:
    """Best rows in order: ``factor`` times ``limit`` of them, all if ``limit`` is None."""
    return first_rows(scored, best_first(), None if limit is None else limit * factor)


def sort_modes(entries: DataFrame, mode: str = "score") -> DataFrame:
    """Order merged entries by score, by source weight, or by name in Chinese collation."""
    tie = [F.asc("name"), F.asc("author")]
    if mode == "name":
        return entries.orderBy(F.collate(F.col("name"), "zh"), *tie)
    if mode == "weight":
        return entries.orderBy(F.desc("weight"), *tie)
    return entries.orderBy(F.desc("score"), *tie)


def has_more(hits: DataFrame, page: int = 20) -> DataFrame:
    """Per source whether a further result page is likely."""
    return hits.groupBy("source_id").agg((F.count("*") >= page).alias("has_more"))


def search_source_stats(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """Per searched source: ok, hits, time, error. Sources without hits appear with 0.

    ``runs`` has one row per searched source (source_id, source_name, ok, elapsed, error).
    """
    counts = hits.groupBy("source_id").agg(F.count("*").alias("hit_count"))
    return runs.join(counts, "source_id", "left").select(
        "source_id",
        "source_name",
        "ok",
        F.when(F.col("ok"), F.coalesce("hit_count", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("hit_count"),
        "elapsed",
        F.when(F.col("ok"), F.lit("")).otherwise(text_or_blank(F.col("error"))).alias("error"),
    )
