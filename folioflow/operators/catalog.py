"""Source catalogue: filters, paging, groups, partial updates, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import not_blank, strip_space, text_or_blank
from folioflow.operators.numbering import ordinal

GROUP_SEPARATORS = "[,;，；]"
UNGROUPED = "未分组"

# Columns added to older catalogues, with their defaults.
HEALTH_COLUMNS = [
    ("last_test_at", "timestamp_ntz", None),
    ("last_test_ok", "boolean", False),
    ("last_test_count", "int", 0),
    ("last_test_error", "string", ""),
]


def evolve_schema(df: DataFrame, columns: list[tuple[str, str, object]]) -> DataFrame:
    """Add missing columns with their defaults; existing columns stay. Safe to repeat."""
    have = set(df.columns)
    return df.select("*", *[F.lit(v).cast(t).alias(n) for n, t, v in columns if n not in have])


def group_tokens(c: Column) -> Column:
    """The tokens of a multi-valued group field."""
    return F.filter(F.transform(F.split(text_or_blank(c), GROUP_SEPARATORS), strip_space), lambda t: t != "")


def was_tested() -> Column:
    return F.col("last_test_at").isNotNull()


def test_status() -> Column:
    return F.when(~was_tested(), "untested").when(F.col("last_test_ok"), "ok").otherwise("fail")


def filter_sources(
    sources: DataFrame, q: str = "", group: str = "", enabled: bool | None = None, status: str = ""
) -> DataFrame:
    """Sources that meet all given conditions; ``%`` and ``_`` in the texts stay wildcards."""
    out = sources
    if q:
        like = f"%{q}%"
        out = out.filter(
            F.col("name").ilike(like) | F.col("url").ilike(like) | F.col("comment").ilike(like) | F.col("group_name").ilike(like)
        )
    if group:
        out = out.filter(F.col("group_name").ilike(f"%{group}%"))
    if enabled is not None:
        out = out.filter(F.col("enabled") == enabled)
    if status in ("ok", "fail", "untested"):
        out = out.filter(test_status() == status)
    return out


def filter_groups(sources: DataFrame, wanted: list[str]) -> DataFrame:
    """Sources of which one group token equals a wanted group."""
    names = [w.strip() for w in wanted if w.strip()]
    return sources.filter(F.arrays_overlap(group_tokens(F.col("group_name")), F.array(*map(F.lit, names))))


def source_order() -> list[Column]:
    return [F.desc("weight"), F.asc("sort_order"), F.asc("id")]


def first_rows(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of an order; None means all of them."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def page_sources(sources: DataFrame, page: int = 1, limit: int | None = 20) -> DataFrame:
    """One page of ``limit`` rows in catalogue order, with the total of the filtered list on each row.

    ``limit`` None puts all sources on one page.
    """
    total = sources.agg(F.count("*").alias("total")).scalar()
    ordered = sources.orderBy(*source_order())
    if limit is not None:
        ordered = ordered.offset((max(page, 1) - 1) * limit).limit(limit)
    return ordered.withColumn("total", total)


def enabled_sources(sources: DataFrame, limit: int | None = 500) -> DataFrame:
    """First ``limit`` enabled sources (None: all), of which the searchable ones are kept."""
    return first_rows(sources.filter("enabled"), source_order(), limit).filter(F.col("search_url") != "")


def collect_scope(
    sources: DataFrame, ids: DataFrame | None = None, limit: int | None = 4000, **conditions: object
) -> DataFrame:
    """Sources a batch job works on: the given ids, else the first ``limit`` of a filter (None: all)."""
    if ids is not None:
        return sources.join(ids.select("id").distinct(), "id", "left_semi")
    return first_rows(filter_sources(sources, **conditions), source_order(), limit)


def semi_scope(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows whose id is in the scope; an empty scope leaves none."""
    return rows.join(scope.select("id"), "id", "left_semi")


def distinct_groups(table: DataFrame) -> DataFrame:
    return table.select(F.explode(group_tokens(F.col("group_name"))).alias("group_name")).distinct()


def group_members(sources: DataFrame) -> DataFrame:
    """All sources of every group field: group_label, pos (catalogue order from 1), id, name and the group's members.

    One row per member, so a group of any size is spread over rows and tasks.
    """
    g = F.when(text_or_blank(F.col("group_name")) != "", F.col("group_name")).otherwise(UNGROUPED)
    labelled = sources.select(g.alias("group_label"), "id", "name", "weight", "sort_order")
    counts = labelled.groupBy("group_label").agg(F.count("*").alias("members"))
    placed = ordinal(labelled, ["group_label"], -F.col("weight").cast("long"), source_order(), "pos")
    return placed.join(counts, "group_label").select("group_label", "pos", "id", "name", "members")


def apply_patch(table: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite the given columns where the patch row has a value; other rows stay."""
    marked = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = table.join(marked, key, "left")
    return joined.select(
        *[F.coalesce(f"_p_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns]
    )


def patch_source(sources: DataFrame, patch: DataFrame) -> DataFrame:
    return apply_patch(sources, patch, "id", ["enabled", "weight", "group_name", "sort_order"])


def patch_nonblank(table: DataFrame, patch: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """Update fields whose patch is not blank, with the text as given; ``updated_at`` moves only when one was."""
    marked = patch.select(key, *[F.when(not_blank(F.col(c)), F.col(c)).alias(f"_p_{c}") for c in columns])
    joined = table.join(marked, key, "left")
    touched = F.coalesce(*[F.col(f"_p_{c}") for c in columns]).isNotNull()
    out = [F.coalesce(f"_p_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns if c != "updated_at"]
    return joined.select(*out, F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"))


def select_scope_ops(sources: DataFrame, chosen: DataFrame, op: str, group: str = "") -> DataFrame:
    """Ids after a selection command on the chosen ids."""
    ids = sources.select("id")
    if op == "enabled":
        return sources.filter("enabled").select("id")
    if op == "all":
        return ids
    if op == "clear":
        return ids.limit(0)
    if op == "invert":
        return ids.join(chosen, "id", "left_anti")
    if op == "only_ok":
        return sources.filter(test_status() == "ok").select("id")
    if op == "minus_failed":
        return chosen.join(sources.filter(test_status() == "fail").select("id"), "id", "left_anti")
    if op == "toggle_group":
        # Whole group chosen: take it out; otherwise add it.
        members = sources.filter(F.col("group_name") == group).select("id")
        missing = members.join(chosen, "id", "left_anti").agg(F.count("*")).scalar()
        added = chosen.unionByName(members).distinct().filter(missing > 0)
        removed = chosen.join(members, "id", "left_anti").filter(missing == 0)
        return added.unionByName(removed)
    raise ValueError(f"unknown selection command: {op}")


def source_view(sources: DataFrame) -> DataFrame:
    """Public row of a source."""
    return sources.select(
        "id", "name", "url", "group_name", "enabled", "weight", "sort_order", "comment", "respond_time",
        F.coalesce("last_test_ok", F.lit(False)).alias("last_test_ok"),
        F.coalesce("last_test_count", F.lit(0)).alias("last_test_count"),
        F.coalesce("last_test_error", F.lit("")).alias("last_test_error"),
        test_status().alias("test_status"),
        (text_or_blank(F.col("search_url")) != "").alias("searchable"),
    )


def delete_by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The table without the given ids."""
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti")
