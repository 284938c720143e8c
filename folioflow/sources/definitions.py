"""Source definitions: reading, tolerant normalisation, import, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.jsons import is_json
from folioflow.functions.text import let, strip_space, text_or_blank
from folioflow.functions.urls import base_url
from folioflow.operators.catalog import apply_patch
from folioflow.operators.numbering import ordinal
from folioflow.session import settle

MAP = "map<string,string>"

# Accepted names of each field, lower case without separators.
FIELD_ALIASES = {
    "name": ["booksourcename", "name", "sourcename", "title", "bookname"],
    "url": ["booksourceurl", "url", "sourceurl", "host", "site", "baseurl"],
    "group": ["booksourcegroup", "group", "groups", "category", "tag"],
    "type": ["booksourcetype", "type", "sourcetype"],
    "comment": ["booksourcecomment", "comment", "desc", "description", "remark"],
    "enabled": ["enabled", "enable", "isenabled", "status"],
    "weight": ["weight", "priority", "order"],
    "search_url": ["searchurl", "search", "searchuri"],
    "explore_url": ["exploreurl", "explore", "findurl"],
    "header": ["header", "headers", "httpheader"],
    "login_url": ["loginurl"],
    "variable": ["variable", "variables", "varlist"],
    "js_lib": ["jslib"],
    "rule_search": ["rulesearch", "searchrule"],
    "rule_explore": ["ruleexplore", "explorerule"],
    "rule_book_info": ["rulebookinfo", "bookinforule", "bookrule"],
    "rule_toc": ["ruletoc", "tocrule", "chapterrule"],
    "rule_content": ["rulecontent", "contentrule", "content"],
    "last_update_time": ["lastupdatetime", "updatetime"],
    "respond_time": ["respondtime", "responsetime"],
    "concurrent_rate": ["concurrentrate"],
    "enabled_explore": ["enabledexplore"],
}
FALSE_WORDS = ["false", "0", "no", "off", "disabled"]
TRUE_WORDS = ["true", "1", "yes", "on", "enabled"]
WRAPPERS = ["bookSources", "sources", "data", "list", "items"]

NO_NAME = "缺少书源名称(bookSourceName)"
NO_URL = "缺少书源地址(bookSourceUrl)"
NO_SEARCH = "既没有 searchUrl 也没有 exploreUrl，无法搜索"
NO_TOC = "缺少目录规则(ruleToc)，无法获取章节列表"
NO_CONTENT = "缺少正文规则(ruleContent)，无法阅读"


# Values ----------------------------------------------------------------------------


def as_object(c: Column) -> Column:
    """An object or the JSON text of one, single quotes tolerated, else an empty map.

    Members stay in document order.
    """
    s = strip_space(text_or_blank(c))
    fixed = F.translate(s, "'", '"')
    out = F.when(s.startswith("{") & is_json(s), F.from_json(s, MAP)).when(
        fixed.startswith("{") & is_json(fixed), F.from_json(fixed, MAP)
    )
    return F.coalesce(out, F.create_map().cast(MAP))


def as_bool(c: Column, default: bool = True) -> Column:
    s = F.lower(strip_space(text_or_blank(c)))
    number = s.try_cast("double")
    return (
        F.when(s.isin(FALSE_WORDS) | (number == 0), False)
        .when(s.isin(TRUE_WORDS), True)
        .otherwise(default)
    )


def as_int(c: Column, default: int = 0) -> Column:
    digits = F.regexp_extract(text_or_blank(c), r"^\s*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(default).cast("long"))


def kv_lines(c: Column) -> Column:
    """JSON, or lines ``key=value`` (``//`` in front allowed), to a map."""
    return _lines_to_map(c, r"^\s*(?://)?\s*([A-Za-z0-9_.-]+)\s*=\s*(.*)$")


def header_lines(c: Column) -> Column:
    """JSON, or lines ``Name: value``, to a map."""
    return _lines_to_map(c, r"^\s*[\"']?([A-Za-z0-9_-]+)[\"']?\s*[:=]\s*[\"']?([^\"',]*?)[\"']?\s*,?\s*$")


def _lines_to_map(c: Column, pattern: str) -> Column:
    s = strip_space(text_or_blank(c))
    lines = F.filter(F.split(s, r"\r?\n"), lambda x: x.rlike(pattern))
    pairs = F.transform(
        lines,
        lambda x: F.struct(F.regexp_extract(x, pattern, 1), strip_space(F.regexp_extract(x, pattern, 2))),
    )
    parsed = as_object(s)
    return F.when(F.size(parsed) > 0, parsed).otherwise(F.map_from_entries(pairs))


# Reading ---------------------------------------------------------------------------


def read_source_files(spark: SparkSession, path: str) -> DataFrame:
    """Definition files, one row per file. A file is one subscription, so it fits a row."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )


def read_sources(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, text) to source rows (doc_id, pos, raw).

    Tried in order: the whole text as JSON, the span between the outermost brackets, one
    object per line. Known wrapper members are unwrapped and non-objects dropped.
    """
    s, body = F.col("s"), F.col("body")
    lines = F.filter(F.transform(F.split(s, r"\r?\n"), strip_space), lambda x: x.startswith("{"))
    rows = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r",\s*$", "")), is_json)
    inner = let(
        F.from_json(body, MAP),
        lambda m: F.coalesce(*[F.when(~F.coalesce(m[w], F.lit("")).isin("", "0", "false", "null"), m[w]) for w in WRAPPERS]),
    )
    listed = (
        F.when(body.isNull(), rows)
        .when(body.startswith("["), F.from_json(body, "array<string>"))
        .when(F.ltrim("inner").startswith("["), F.from_json("inner", "array<string>"))
        .otherwise(F.array(body))
    )
    out = docs.select("doc_id", F.regexp_replace(strip_space(text_or_blank(F.col("text"))), r"^\x{feff}", "").alias("s"))
    out = out.withColumn("cut", F.regexp_extract(s, r"(?s)([\[{].*[\]}])", 1))
    out = out.withColumn("body", F.when(is_json(s), s).when(is_json(F.col("cut")), F.col("cut")))
    out = out.withColumn("inner", F.when(body.startswith("{"), inner))
    return out.select("doc_id", F.posexplode(listed).alias("pos", "raw")).filter(F.ltrim("raw").rlike(r"^[\[{]"))


def read_source_arrays(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """Definition files of any size that are one JSON array each, as source rows (doc_id, pos, raw), read by many tasks.

    Files are split at commas, so their byte ranges go to different tasks. Whether a comma parts two items is known from the depth
    of brackets and from being inside a string or not at its place; both are running sums over the pieces of a byte range, made for
    either start, to which the sums of the ranges before are added. No row holds more than one item. ``level`` is the depth of
    the items: 1 for a plain array, 2 for an array that is the only member of an object. Other values than objects are dropped.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("n"), "value",
    )
    # Escaped signs are taken out first; what is left of a piece behind its last quote is inside or outside a string.
    bare = F.regexp_replace("value", r"(?s)\\.", "")

    def depth(text: Column) -> Column:
        plain = F.regexp_replace(text, r'(?s)"[^"]*("|\z)', "")
        return F.regexp_count(plain, F.lit(r"[\[{]")) - F.regexp_count(plain, F.lit(r"[\]}]"))

    inside = F.when(bare.contains('"'), depth(F.regexp_replace(bare, r'(?s)^[^"]*"', ""))).otherwise(0)
    pieces = settle(pieces.withColumns({"quotes": F.regexp_count(bare, F.lit('"')), "d_out": depth(bare), "d_in": inside}), "pieces")

    def running(c: str, *by: str, last: int = 0) -> Column:
        over = Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, last)
        return F.coalesce(F.sum(c).over(over), F.lit(0))

    here = ["doc_id", "range", "n"]
    rows = pieces.withColumn("odd", running("quotes", *here, last=-1) % 2)
    out, within = F.col("d_out"), F.col("d_in")
    rows = rows.withColumns({"step_0": F.when(F.col("odd") == 0, out).otherwise(within), "step_1": F.when(F.col("odd") == 0, within).otherwise(out)})
    rows = rows.withColumns({"sum_0": running("step_0", *here), "sum_1": running("step_1", *here), "odd_after": (F.col("odd") + F.col("quotes")) % 2})
    sums = rows.groupBy("doc_id", "range").agg(*[F.sum(c).alias(c) for c in ("quotes", "step_0", "step_1")])
    sums = sums.withColumn("start_odd", running("quotes", "doc_id", "range", last=-1) % 2)
    sums = sums.withColumn("whole", F.when(F.col("start_odd") == 0, F.col("step_0")).otherwise(F.col("step_1")))
    starts = sums.select("doc_id", "range", "start_odd", running("whole", "doc_id", "range", last=-1).alias("start_depth"))
    rows = rows.join(starts, ["doc_id", "range"])
    after = F.col("start_depth") + F.when(F.col("start_odd") == 0, F.col("sum_0")).otherwise(F.col("sum_1"))
    parts = (after == level) & ((F.col("start_odd") + F.col("odd_after")) % 2 == 0)
    rows = settle(rows.select(*here, "value", after.alias("depth"), parts.cast("long").alias("ends")), "pieces")
    local = rows.withColumn("item", running("ends", *here, last=-1))
    earlier = rows.groupBy("doc_id", "range").agg(F.sum("ends").alias("ends")).select("doc_id", "range", running("ends", "doc_id", "range", last=-1).alias("before"))
    items = local.join(earlier, ["doc_id", "range"]).groupBy("doc_id", (F.col("item") + F.col("before")).alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("range", "n", "value"))).alias("p"), F.min("depth").alias("least")
    )
    text = strip_space(F.array_join(F.transform("p", lambda x: x["value"]), ","))
    text = F.when(F.col("pos") == 0, F.regexp_replace(text, r"(?s)^\x{feff}?[^\[]*\[", "")).otherwise(text)
    text = F.when(F.col("least") < level, F.regexp_replace(text, r"\]\s*" + r"\}\s*" * (level - 1) + r"[\s,]*\z", "")).otherwise(text)
    return items.select("doc_id", F.col("pos").cast("int").alias("pos"), strip_space(text).alias("raw")).filter(F.col("raw").startswith("{"))


def normalize_source(rows: DataFrame) -> DataFrame:
    """Tolerant raw JSON (``raw``) to canonical columns, with issues and usability.

    A field takes the first member in document order whose name is one of its aliases.
    """
    members = F.transform(
        F.map_entries(as_object(F.col("raw"))),
        lambda e: F.struct(
            F.lower(F.regexp_replace(e["key"], r"[_\s-]", "")).alias("k"), e["value"].alias("v")
        ),
    )
    df = rows.withColumn("_m", members)

    def pick(field: str) -> Column:
        return F.try_element_at(F.filter("_m", lambda e: e["k"].isin(FIELD_ALIASES[field])), F.lit(1))["v"]

    def text(field: str) -> Column:
        return strip_space(text_or_blank(pick(field)))

    rules = ["rule_search", "rule_explore", "rule_book_info", "rule_toc", "rule_content"]
    rest = [c for c in rows.columns]
    df = df.select(
        *rest,
        text("name").alias("name"),
        base_url(pick("url")).alias("url"),
        text("group").alias("group_name"),
        as_int(pick("type")).cast("int").alias("type"),
        text("comment").alias("comment"),
        as_bool(pick("enabled")).alias("enabled"),
        as_int(pick("weight")).cast("int").alias("weight"),
        pick("search_url").alias("_search"),
        text("explore_url").alias("explore_url"),
        as_object(pick("header")).alias("header"),
        text("login_url").alias("login_url"),
        text("variable").alias("variable"),
        text("js_lib").alias("js_lib"),
        *[as_object(pick(r)).alias(r) for r in rules],
        as_int(pick("last_update_time")).alias("last_update_time"),
        as_int(pick("respond_time")).alias("respond_time"),
        text("concurrent_rate").alias("concurrent_rate"),
        as_bool(pick("enabled_explore")).alias("enabled_explore"),
    )
    search = strip_space(F.coalesce("_search", F.col("rule_search")["searchUrl"], F.lit("")))
    df = df.withColumn("search_url", search).drop("_search")
    return source_capability(df)


def source_capability(df: DataFrame) -> DataFrame:
    """Capability flags, issues and usability from the canonical columns.

    Older definitions keep contents and chapter rules in the search rules; they are copied.
    """

    def fallback(rule: str, member: str) -> Column:
        value = text_or_blank(F.col("rule_search")[member])
        borrowed = F.create_map(F.lit(member), value)
        return F.when((F.size(rule) == 0) & (value != ""), borrowed).otherwise(F.col(rule))

    df = df.withColumn("rule_content", fallback("rule_content", "content"))
    df = df.withColumn("rule_toc", fallback("rule_toc", "chapterList"))
    df = df.withColumns(
        {
            "can_search": F.col("search_url") != "",
            "can_book_info": F.size("rule_book_info") > 0,
            "can_toc": F.size("rule_toc") > 0,
            "can_content": F.size("rule_content") > 0,
        }
    )
    no_way = (F.col("search_url") == "") & (F.col("explore_url") == "")
    checks = [
        (F.col("name") == "", NO_NAME), (F.col("url") == "", NO_URL), (no_way, NO_SEARCH),
        (~F.col("can_toc"), NO_TOC), (~F.col("can_content"), NO_CONTENT),
    ]
    issues = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in checks]), lambda x: x.isNotNull())
    return df.withColumn("issues", issues).withColumn(
        "usable", (F.col("name") != "") & (F.col("url") != "") & ~no_way
    )


# Import ----------------------------------------------------------------------------

CATALOG = ["name", "url", "group_name", "type", "enabled", "weight", "comment", "raw", "last_update_time"]


def union_imports(*parts: DataFrame) -> DataFrame:
    """Rows of several inputs in order: the input number goes in front of the position."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def apply_import_options(rows: DataFrame, group: str = "", enabled: bool | None = None) -> DataFrame:
    """The ``group`` and ``enabled`` options of an import override the definitions."""
    if group:
        rows = rows.withColumn("group_name", F.lit(group))
    if enabled is not None:
        rows = rows.withColumn("enabled", F.lit(enabled)).withColumn("enabled_explore", F.lit(enabled))
    return rows


def import_actions(catalog: DataFrame, rows: DataFrame, mode: str = "append") -> DataFrame:
    """What happens to each row: added, updated, skipped or failed.

    ``rows`` are normalised and ordered by ``pos``.
    """
    present = catalog.select("name", "url").distinct().withColumn("_old", F.lit(mode != "replace"))
    first = rows.groupBy("name", "url").agg(F.min("pos").alias("_first"))
    repeat = "updated" if mode == "merge" else "skipped"
    action = (
        F.when(F.col("url") == "", "failed")
        .when(F.coalesce("_old", F.lit(False)) | (F.col("pos") != F.col("_first")), repeat)
        .otherwise("added")
    )
    joined = rows.join(first, ["name", "url"]).join(present, ["name", "url"], "left")
    return joined.withColumn("action", action).drop("_old", "_first")


def import_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def upsert_sources(catalog: DataFrame, rows: DataFrame, mode: str = "append", block: int = 65536) -> DataFrame:
    """The catalogue after an import; the key is (name, url).

    append keeps what exists, merge overwrites it with the last row, replace starts empty.
    The winning row of a key is a partial aggregate, so a key with very many rows is
    reduced in the map tasks.
    """
    usable = rows.filter(F.col("url") != "")
    pick = F.max_by if mode == "merge" else F.min_by
    winner = usable.groupBy("name", "url").agg(
        pick(F.struct(*[c for c in CATALOG if c not in ("name", "url")]), "pos").alias("w"), F.min("pos").alias("first_pos")
    )
    winner = winner.select("name", "url", "w.*", "first_pos")
    base = catalog.limit(0) if mode == "replace" else catalog
    columns = ["id", *CATALOG, "sort_order"]
    kept = base.select(*columns)
    if mode == "merge":
        update = winner.join(base.select("id", "name", "url"), ["name", "url"])
        kept = apply_patch(kept, update, "id", ["group_name", "type", "enabled", "weight", "comment", "raw", "last_update_time"])
    new = winner.join(base.select("name", "url"), ["name", "url"], "left_anti")
    new = ordinal(new, [], F.floor(F.col("first_pos") / block), [F.asc("first_pos")], "_n")
    top = base.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = new.withColumn("id", top + F.col("_n")).withColumn("sort_order", F.lit(0))
    return kept.unionByName(new.select(*columns))


def update_source(catalog: DataFrame, patches: DataFrame) -> DataFrame:
    """Shallow-merge patch JSON (id, patch) over the stored raw JSON and normalise again."""
    joined = catalog.select("id", "raw").join(patches, "id")
    merged = F.map_concat(as_object(F.col("raw")), as_object(F.col("patch")))
    # Values that are JSON themselves are kept as text; reading them back accepts both.
    return normalize_source(joined.select("id", F.to_json(merged).alias("raw")))


def export_sources(catalog: DataFrame) -> DataFrame:
    """Canonical definition rows; missing fields fall back to the raw JSON."""
    raw = as_object(F.col("raw"))
    df = catalog.withColumn("_r", raw)

    def member(name: str, default: str = "") -> Column:
        return F.coalesce(F.col("_r")[name], F.lit(default))

    def or_raw(column: str, name: str) -> Column:
        return F.when(text_or_blank(F.col(column)) != "", F.col(column)).otherwise(member(name))

    return df.select(
        or_raw("comment", "bookSourceComment").alias("bookSourceComment"),
        or_raw("group_name", "bookSourceGroup").alias("bookSourceGroup"),
        F.col("name").alias("bookSourceName"),
        F.coalesce("type", F.lit(0)).alias("bookSourceType"),
        F.col("url").alias("bookSourceUrl"),
        F.coalesce(as_int(F.col("_r")["customOrder"], None), F.col("sort_order").cast("long"), F.lit(0)).alias("customOrder"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        (member("enabledExplore", "true") != "false").alias("enabledExplore"),
        member("header").alias("header"),
        member("loginUrl").alias("loginUrl"),
        F.coalesce("weight", F.lit(0)).alias("weight"),
        member("variable").alias("variable"),
        F.coalesce("last_update_time", F.lit(0)).alias("lastUpdateTime"),
        F.when(F.coalesce("respond_time", F.lit(0)) == 0, 180000).otherwise(F.col("respond_time")).alias("respondTime"),
        member("searchUrl").alias("searchUrl"),
        member("exploreUrl").alias("exploreUrl"),
        *[member(r, "{}").alias(r) for r in ("ruleSearch", "ruleExplore", "ruleBookInfo", "ruleToc", "ruleContent")],
    )


def write_export(catalog: DataFrame, path: str) -> None:
    export_sources(catalog).write.mode("overwrite").json(path)
