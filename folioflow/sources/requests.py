"""Request planning: which address to fetch for which source, keyword and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.codec import TRANSCODED, charset_name, encode_keyword
from folioflow.functions.jsons import is_json
from folioflow.functions.text import strip_space, text_or_blank
from folioflow.functions.urls import abs_url
from folioflow.operators.catalog import source_order
from folioflow.sources.definitions import as_object

OTHER_GROUP = "分类"
OPTION_SPLIT = r"(?s)^(.*),(\{.*)$"


def split_options(c: Column) -> tuple[Column, Column]:
    """Split ``url,{options}`` at the last ``,{``; text whose options do not parse is all URL."""
    s = strip_space(text_or_blank(c))
    tail = F.regexp_extract(s, OPTION_SPLIT, 2)
    valid = (tail != "") & (is_json(tail) | is_json(F.translate(tail, "'", '"')))
    url = F.when(valid, F.regexp_extract(s, OPTION_SPLIT, 1)).otherwise(s)
    return url, F.when(valid, as_object(tail)).otherwise(F.create_map().cast("map<string,string>"))


def first_address(c: Column) -> Column:
    """The first search address: everything when it has options, else the first line.

    Line breaks inside ``{{ }}`` do not end a line.
    """
    s = strip_space(text_or_blank(c))
    url, _ = split_options(s)
    line = strip_space(F.regexp_extract(s, r"^((?:\{\{(?s:.*?)\}\}|[^\r\n])*)", 1))
    return F.when(url != s, s).otherwise(line)


def fill_template(c: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{name}}`` by the given values; other expressions stay."""
    out = c
    for name, value in values.items():
        out = F.regexp_replace(out, r"\{\{\s*" + name + r"\s*\}\}", "{{" + name + "}}")
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def fill_once(c: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{name}}`` by the given values in one pass; a placeholder inside a value is plain text."""
    parts = F.split(c, r"(?=\{\{)|(?<=\}\})")

    def filled(p: Column) -> Column:
        out = p
        for name, value in values.items():
            out = F.when(p.rlike(r"^\{\{\s*" + name + r"\s*\}\}$"), value).otherwise(out)
        return out

    return F.array_join(F.transform(parts, filled), "")


def plan_requests(sources: DataFrame, keywords: list[str], pages: list[int] = (1,)) -> DataFrame:
    """One request row per source, keyword and page.

    The keywords of a search are a short argument list, so each source row is expanded in
    place; there is no join. ``sources``: id, url, search_url, header (map), charset.
    """
    asked = sources.filter(strip_space(text_or_blank(F.col("search_url"))) != "")
    expanded = asked.select(
        "*", F.explode(F.array(*map(F.lit, keywords))).alias("keyword")
    ).select("*", F.explode(F.array(*map(F.lit, pages))).alias("page"))

    df = expanded.withColumn("_first", first_address(F.col("search_url")))
    raw_url, opts = split_options(F.col("_first"))
    df = df.withColumns({"_raw": raw_url, "_opts": opts})
    charset = F.coalesce(F.col("_opts")["charset"], text_or_blank(F.col("charset")))
    coded = F.when(charset_name(charset).isin(TRANSCODED), encode_keyword(F.col("keyword"), charset)).otherwise(
        F.col("keyword")
    )
    df = df.withColumn("_coded", coded)
    values = {
        "key": F.col("_coded"),
        "searchKey": F.col("keyword"),
        "page": F.col("page").cast("string"),
        "baseUrl": F.col("url"),
        "sourceUrl": F.col("url"),
    }
    body = fill_once(F.coalesce(F.col("_opts")["body"], F.lit("")), values)
    address = fill_template(strip_space(F.col("_raw")), values)
    df = df.withColumns({"_body": body, "_address": address, "_charset": charset})
    has_body = F.col("_body") != ""
    method = F.upper(
        F.coalesce(F.nullif(F.col("_opts")["method"], F.lit("")), F.when(has_body, "POST").otherwise("GET"))
    )
    headers = F.map_filter(
        F.map_concat(F.coalesce("header", F.create_map().cast("map<string,string>")), as_object(F.col("_opts")["headers"])),
        lambda k, v: F.coalesce(v, F.lit("")) != "",
    )
    typed = F.exists(F.map_keys(headers), lambda k: F.lower(k) == "content-type")
    kind = F.when(F.ltrim("_body").rlike(r"^[\[{]"), "application/json;charset=UTF-8").otherwise(
        "application/x-www-form-urlencoded;charset=UTF-8"
    )
    headers = F.when(has_body & ~typed, F.map_concat(headers, F.create_map(F.lit("Content-Type"), kind))).otherwise(headers)
    return df.select(
        F.col("id").alias("source_id"),
        "keyword",
        "page",
        abs_url(F.col("url"), F.col("_address")).alias("request_url"),
        method.alias("method"),
        F.col("_body").alias("body"),
        headers.alias("headers"),
        F.col("_charset").alias("charset"),
    )


def parse_explore(c: Column) -> Column:
    """Category list to (title, url): a JSON array, else lines ``title::url`` or bare links."""
    s = strip_space(text_or_blank(c))
    listed = F.transform(
        F.from_json(s, "array<map<string,string>>"),
        lambda m: F.struct(
            strip_space(F.coalesce(m["title"], m["name"], F.lit(""))).alias("title"),
            strip_space(F.coalesce(m["url"], F.lit(""))).alias("url"),
        ),
    )
    pattern = r"^(.*?)::(.*)$"

    def line_group(t: Column) -> Column:
        title = strip_space(F.regexp_extract(t, pattern, 1))
        url = strip_space(F.regexp_extract(t, pattern, 2))
        return F.struct(
            F.when((url != "") & (title != ""), title).otherwise(OTHER_GROUP).alias("title"),
            F.when(url != "", url).otherwise(t).alias("url"),
        )

    lines = F.filter(F.transform(F.split(s, r"\r?\n"), strip_space), lambda t: t != "")
    return F.when(
        s.startswith("[") & is_json(s), F.filter(listed, lambda g: g["url"] != "")
    ).otherwise(F.transform(lines, line_group))


def cap_explore(sources: DataFrame, max_sources: int = 6, max_groups: int = 3) -> DataFrame:
    """First groups of the first sources that have any, in catalogue order."""
    groups = sources.withColumn("_g", parse_explore(F.col("explore_url"))).filter(F.size("_g") > 0)
    few = groups.orderBy(*source_order()).limit(max_sources)
    return few.select(
        F.col("id").alias("source_id"), "name", F.posexplode(F.slice("_g", 1, max_groups)).alias("group_pos", "g")
    ).select("source_id", "name", "group_pos", "g.title", "g.url")


def keep_filled(groups: DataFrame, hits: DataFrame) -> DataFrame:
    """Explore groups that returned hits."""
    return groups.join(hits.select("source_id", "title").distinct(), ["source_id", "title"], "left_semi")


RULE_FIELDS = ["bookList", "name", "author", "kind", "wordCount", "lastChapter", "intro", "coverUrl", "bookUrl"]
# Other names a rule field may have.
RULE_ALIASES = {"name": ["bookName"], "kind": ["category"], "coverUrl": ["cover"], "bookUrl": ["url"]}


def join_rules(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages with the extraction rules of their source; explore rules fall back to search rules."""

    def rule(field: str) -> Column:
        names = [field, *RULE_ALIASES.get(field, [])]
        tries = [F.col(block)[n] for n in names for block in ("rule_explore", "rule_search")]
        return F.coalesce(*[F.nullif(strip_space(text_or_blank(t)), F.lit("")) for t in tries], F.lit(""))

    rules = sources.select(F.col("id").alias("source_id"), *[rule(f).alias(f"rule_{f}") for f in RULE_FIELDS])
    return pages.join(rules, "source_id")
