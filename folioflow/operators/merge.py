"""Merging of hits that describe the same title across sources.

Inside a title the rule is greedy in input order: a hit joins the first entry
whose author is compatible (either is empty, or one contains the other). Which entry a
hit joins depends on its author key alone:

* an entry without an author can only be the first one, and it takes the first author
  that comes up, so from then on all entry keys are fixed;
* entries are only ever appended, so a key that once found its entry finds it again.

So hits are first reduced to the distinct author keys of a title with their first
positions (map-side combined), the greedy rule runs over those, and the label is joined
back. No task ever sees all hits of a title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import ranking
from folioflow.functions.text import author_key, dedupe_key, norm_title, parts_of_lengths
from folioflow.operators.search import ORIGIN_CAP, first_wins
from folioflow.session import settle

# Titles with more distinct authors than this are settled in rounds instead of one fold.
FOLD_LIMIT = 256

HIT = ["source_id", "source_name", "book_url", "name", "author", "kind", "intro", "cover_url", "last_chapter"]
ORDER = ["weight", "sort_order", "source_id", "item_pos"]


def _position() -> Column:
    """Sorts like the input order."""
    return F.struct((-F.col("weight")).alias("w"), "sort_order", "source_id", "item_pos")


def keyed_hits(hits: DataFrame) -> DataFrame:
    """Hits with title and author key, blank titles dropped, written once.

    The keys are read three times below and the members twice; reading a written table with
    only the needed columns costs less than making the hits again each time.
    """
    keyed = hits.withColumn("title", norm_title(F.col("name"))).withColumn("ak", author_key(F.col("author")))
    return settle(keyed.filter(F.col("title") != ""), "keyed-hits")


def author_keys(keyed: DataFrame) -> DataFrame:
    """Distinct non-empty author keys per title with their first position."""
    return keyed.filter(F.col("ak") != "").groupBy("title", "ak").agg(F.min(_position()).alias("pos"))


def _compatible(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def leaders_by_fold(keys: DataFrame) -> DataFrame:
    """Greedy rule as a fold over the ordered keys of a title; only for titles of a checked size."""
    ordered = keys.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("pos", "ak"))).alias("ks"))

    def step(acc: Column, k: Column) -> Column:
        taken = F.exists(acc, lambda lead: _compatible(lead["ak"], k["ak"]))
        return F.when(taken, acc).otherwise(F.array_append(acc, k))

    start = F.slice(F.col("ks"), 1, 0)
    folded = ordered.withColumn("leads", F.aggregate("ks", start, step))
    return folded.select("title", "leads", F.explode("ks").alias("k")).select(
        "title",
        F.col("k.ak").alias("ak"),
        F.filter("leads", lambda lead: _compatible(lead["ak"], F.col("k.ak")))[0]["ak"].alias("leader"),
    )


def compatible_pairs(keys: DataFrame) -> DataFrame:
    """Pairs (ak, earlier compatible key) found by equality on substrings, never by pairing a group.

    The number of pairs is bounded by the substrings of the author keys, not by the
    square of the group.
    """
    parts = parts_of_lengths(keys, keys.select("title", F.col("ak").alias("part")), ["title"], "ak", "part")
    parts = parts.select("title", F.col("ak").alias("long"), F.col("pos").alias("long_pos"), "part")
    shorts = keys.select("title", F.col("ak").alias("part"), F.col("pos").alias("part_pos"))
    both = parts.join(shorts, ["title", "part"]).filter(F.col("long") != F.col("part"))
    later_long = F.col("long_pos") > F.col("part_pos")
    return both.select(
        "title",
        F.when(later_long, F.col("long")).otherwise(F.col("part")).alias("ak"),
        F.when(later_long, F.col("part")).otherwise(F.col("long")).alias("earlier"),
        F.when(later_long, F.col("part_pos")).otherwise(F.col("long_pos")).alias("earlier_pos"),
    )


def leaders_by_rounds(keys: DataFrame) -> DataFrame:
    """The greedy rule for titles with very many authors, settled in parallel rounds.

    A key leads when every earlier compatible key is known to follow another one; it
    follows its earliest leader once everything before that leader is settled. Each round
    settles at least the earliest open key of every title, and in practice nearly all.
    """
    pairs = settle(compatible_pairs(keys), "merge-pairs")
    state = settle(keys.select("title", "ak", F.lit(None).cast("string").alias("leader")), "merge-state")
    while True:
        known = state.select("title", F.col("ak").alias("earlier"), F.col("leader").alias("earlier_leader"))
        seen = (
            pairs.join(known, ["title", "earlier"])
            .groupBy("title", "ak")
            .agg(
                F.min(F.when(F.col("earlier_leader").isNull(), F.col("earlier_pos"))).alias("open_pos"),
                F.min(
                    F.when(
                        F.col("earlier_leader") == F.col("earlier"), F.struct(F.col("earlier_pos"), F.col("earlier"))
                    )
                ).alias("lead"),
            )
        )
        settled_lead = F.col("lead").isNotNull() & (
            F.col("open_pos").isNull() | (F.col("open_pos") > F.col("lead.earlier_pos"))
        )
        nxt = state.join(seen, ["title", "ak"], "left").select(
            "title",
            "ak",
            F.when(F.col("leader").isNotNull(), F.col("leader"))
            .when(settled_lead, F.col("lead.earlier"))
            .when(F.col("lead").isNull() & F.col("open_pos").isNull(), F.col("ak"))
            .alias("leader"),
        )
        state = settle(nxt, "merge-state")
        if state.filter(F.col("leader").isNull()).isEmpty():
            return state


def author_leaders(keys: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """(title, ak, leader): the author key of the entry each author key belongs to."""
    sizes = keys.groupBy("title").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > fold_limit).select("title")
    if large.isEmpty():
        return leaders_by_fold(keys)
    large = settle(large, "merge-large")
    small_part = leaders_by_fold(keys.join(large, "title", "left_anti"))
    return small_part.unionByName(leaders_by_rounds(keys.join(large, "title", "left_semi")))


def merge_members(hits: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Every hit with the entry it belongs to: (title, leader). Blank titles are dropped."""
    keyed = keyed_hits(hits)
    keys = author_keys(keyed)
    leaders = author_leaders(keys, fold_limit)
    # Hits without an author go to the first entry of their title, which is led by its first author.
    first = keys.groupBy("title").agg(F.min_by("ak", "pos").alias("leader")).withColumn("ak", F.lit(""))
    labels = leaders.unionByName(first.select("title", "ak", "leader"))
    return keyed.join(labels, ["title", "ak"], "left").withColumn("leader", F.coalesce("leader", F.lit(""))).drop("ak")


def pick_representative(members: DataFrame, keys: list[str]) -> DataFrame:
    """The richest hit of each entry, the first one on ties, with the number of origins."""
    rich = ranking.richness(F.col("intro"), F.col("cover_url"), F.col("last_chapter"), F.col("kind"))
    best = F.max_by(F.struct(*HIT, "weight"), F.struct(rich, *first_wins()))
    return members.groupBy(*keys).agg(best.alias("rep"), F.count("*").alias("origin_count")).select(
        *keys, "rep.*", "origin_count"
    )


def cap_origins(
    members: DataFrame, keys: list[str], limit: int | None = ORIGIN_CAP, fields: list[str] | None = None
) -> DataFrame:
    """The first origins of each entry in order, as an array of at most ``limit``; of all if ``limit`` is None.

    The row_number filter keeps ``limit`` rows per entry in each map task, so an entry with
    millions of origins costs no more than a small one. Without a limit an entry's origins are
    one array, as long as the entry is; ``fields`` (all of ``HIT`` by default) keeps it narrow. All
    origins stay available as the rows of ``merge_members``.
    """
    fields = fields or HIT
    order = [F.desc("weight"), F.asc("sort_order"), F.asc("source_id"), F.asc("item_pos")]
    w = Window.partitionBy(*keys).orderBy(*order)
    few = members.withColumn("_rn", F.row_number().over(w))
    if limit is not None:
        few = few.filter(F.col("_rn") <= limit)
    origin = F.struct(F.col("_rn").alias("pos"), *fields)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list(origin)).alias("origins"))


def merge_hits(
    hits: DataFrame,
    dedupe: bool = True,
    fold_limit: int = FOLD_LIMIT,
    origin_limit: int | None = ORIGIN_CAP,
    origin_fields: list[str] | None = None,
) -> DataFrame:
    """Merged entries: representative, number of origins, first origins (all if ``origin_limit`` is None).

    ``hits`` come from ``union_hits``. Without ``dedupe`` every hit is an entry of its own.
    """
    if not dedupe:
        own = F.array(F.struct(F.lit(1).alias("pos"), *(origin_fields or HIT)))
        return hits.select(*HIT, "weight", F.lit(1).cast("long").alias("origin_count"), own.alias("origins"))
    members = merge_members(hits, fold_limit)
    keys = ["title", "leader"]
    origins = cap_origins(members, keys, origin_limit, origin_fields)
    return pick_representative(members, keys).join(origins, keys).drop(*keys)


def merge_hits_simple(hits: DataFrame) -> DataFrame:
    """Merge on the strict title and author key; the best-scored hit stands for the entry."""
    keyed = hits.withColumn("merge_key", dedupe_key(F.col("name"), F.col("author")))
    cover = F.max(F.coalesce(F.col("cover_url"), F.lit("")) != "")
    best = F.max_by(F.struct(*HIT, "weight", "score"), F.struct(F.col("score"), *first_wins()))
    return keyed.groupBy("merge_key").agg(
        best.alias("best"), F.count("*").alias("item_count"), cover.alias("any_cover")
    ).select("merge_key", "best.*", "item_count", "any_cover")


def filter_cover(merged: DataFrame) -> DataFrame:
    """Entries of which any item has a cover."""
    return merged.filter(F.col("any_cover"))
