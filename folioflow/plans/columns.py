"""Column functions over hits, texts, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import clean, codec, jsons, lists, text, urls
from folioflow.functions.entities import unescape_html
from folioflow.operators.extract import clean_html
from folioflow.plans.registry import query
from folioflow.plans.views import load, sql_for
from folioflow.schemas import struct
from folioflow.sources.definitions import header_lines, kv_lines

SP = text.SPACE
PUNCT = text.char_class(text.KEYWORD_PUNCTUATION).replace("'", "''")
WRAP = text.char_class(text.TITLE_WRAPPERS)
MERGE_PUNCT = text.char_class(text.MERGE_PUNCTUATION).replace("'", "''")
ONE_SPACE = r"regexp_replace(regexp_replace(text, '[\t\n\r\f\x{0b}\x{a0}\x{3000}]+', ' ', 'g'), ' {2,}', ' ', 'g')"
ONE_BLANK = r"regexp_replace(regexp_replace(l, '[\t\f\x{0b}]+', ' ', 'g'), ' {2,}', ' ', 'g')"
FULL, HALF = text.FULL_WIDTH, text.HALF_WIDTH.replace("'", "''")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def norm_keyword_sql(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace(translate({x}, '{FULL}', '{HALF}'), '[{SP}]', '', 'g'), '{PUNCT}', '', 'g'))"


def norm_title_sql(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '{WRAP}', '', 'g'), '[{SP}]', '', 'g'))"


def clean_author_sql(x: str) -> str:
    a = f"regexp_replace({x}, '\\r?\\n+', ' ', 'g')"
    a = f"regexp_replace({a}, '^[{SP}]*作[{SP}]*者[{SP}]*[:：][{SP}]*', '')"
    a = f"regexp_replace({a}, '^[{SP}]*著[{SP}]*者[{SP}]*[:：][{SP}]*', '')"
    a = f"regexp_replace({a}, '[{SP}]*[著作]$', '')"
    return strip_sql(f"regexp_replace({a}, '[{SP}]+', ' ', 'g')")


def dedupe_key_sql(name: str, author: str) -> str:
    def norm(x: str) -> str:
        return f"lower(regexp_replace(regexp_replace({x}, '{MERGE_PUNCT}', '', 'g'), '[{SP}]', '', 'g'))"

    return f"concat({norm(name)}, '::', {norm(author)})"


# Normalisers ------------------------------------------------------------------------


@query("norm_keyword", sql_for("texts", body=f"select doc_id, md5({norm_keyword_sql('text')}) as text_key, {norm_keyword_sql('title')} as title_key from texts"))
def norm_keyword(spark, d):
    return load(spark, d, "texts").select(
        "doc_id", F.md5(text.norm_keyword(F.col("text"))).alias("text_key"), text.norm_keyword(F.col("title")).alias("title_key")
    )


@query("norm_title", sql_for("hits", body=f"select source_id, item_pos, {norm_title_sql('name')} as title from hits"))
def norm_title(spark, d):
    return load(spark, d, "hits").select("source_id", "item_pos", text.norm_title(F.col("name")).alias("title"))


@query("clean_author", sql_for("hits", body=f"select source_id, item_pos, {clean_author_sql('author')} as author from hits"))
def clean_author(spark, d):
    return load(spark, d, "hits").select("source_id", "item_pos", text.clean_author(F.col("author")).alias("author"))


@query("dedupe_key", sql_for("hits", body=f"select source_id, item_pos, {dedupe_key_sql('name', 'author')} as merge_key from hits"))
def dedupe_key(spark, d):
    return load(spark, d, "hits").select(
        "source_id", "item_pos", text.dedupe_key(F.col("name"), F.col("author")).alias("merge_key")
    )


@query("tidy", f"select doc_id, md5({strip_sql(ONE_SPACE)}) as tidy_text from documents")
def tidy(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.tidy(F.col("text"))).alias("tidy_text"))


@query("escape_html", """select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as escaped from pages""")
def escape_html(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped"))


@query(
    "unescape_html",
    # In these pages the only ambiguous chain is &amp;, which is decoded last.
    """select page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&')) as plain from pages""",
)
def unescape(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(unescape_html(F.col("html"))).alias("plain"))


@query("count_words", f"select doc_id, len(regexp_extract_all(text, '[{text.CJK}]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+')) as words from documents")
def count_words(spark, d):
    return load(spark, d, "documents").select("doc_id", text.count_words(F.col("text")).cast("long").alias("words"))


@query(
    "split_long",
    """with l as (select doc_id, text, list_transform(string_split(text, chr(10)), lambda x: {'done': []::varchar[], 'cur': x}) as ls from documents),
    p as (select doc_id, case when length(text) <= 2000 then [text] else list_append(
      list_reduce(ls, lambda a, x: case when a.cur <> '' and length(a.cur) + length(x.cur) + 1 > 2000
        then {'done': list_append(a.done, a.cur), 'cur': x.cur}
        else {'done': a.done, 'cur': case when a.cur = '' then x.cur else concat(a.cur, chr(10), x.cur) end} end).done,
      list_reduce(ls, lambda a, x: case when a.cur <> '' and length(a.cur) + length(x.cur) + 1 > 2000
        then {'done': a.done, 'cur': x.cur}
        else {'done': a.done, 'cur': case when a.cur = '' then x.cur else concat(a.cur, chr(10), x.cur) end} end).cur) end as ps from l)
    select doc_id, cast(len(list_filter(ps, lambda x: x <> '' or len(ps) = 1)) as bigint) as pieces, md5(array_to_string(list_filter(ps, lambda x: x <> '' or len(ps) = 1), '|')) as content from p""",
)
def split_long(spark, d):
    pieces = text.split_long(F.col("text"), 2000)
    return load(spark, d, "documents").withColumn("ps", pieces).select(
        "doc_id", F.size("ps").cast("long").alias("pieces"), F.md5(F.array_join("ps", "|")).alias("content")
    )


AD_SQL = " or ".join("regexp_matches(s, '" + p.replace("'", "''") + "')" for p in text.AD_LINE_PATTERNS)


@query(
    "is_ad_line",
    sql_for(
        "texts",
        extra={"lines": f"select doc_id, {strip_sql('l')} as s from (select doc_id, unnest(string_split(text, chr(10))) as l from texts) t"},
        body=f"select doc_id, count(*) as line_count, count(*) filter (where s = '' or (length(s) <= 80 and ({AD_SQL}))) as ads from lines group by doc_id",
    ),
)
def is_ad_line(spark, d):
    lines = load(spark, d, "texts").select("doc_id", F.split("text", "\n").alias("ls"))
    return lines.select(
        "doc_id",
        F.size("ls").cast("long").alias("line_count"),
        F.size(F.filter("ls", lambda x: text.is_ad_line(x))).cast("long").alias("ads"),
    )


@query(
    "clean_content",
    sql_for(
        "texts",
        extra={
            "raw": """select doc_id, split_part(text, chr(10), 1) as alias, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{4,}', '#', 'g'), '&nbsp;', ' ', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&amp;', '&', 'gi'), '\\r\\n?', chr(10), 'g'), chr(10))) as l, unnest(range(1, 1 + len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))))) as n from texts""",
            "lines": f"select doc_id, n, {strip_sql(ONE_BLANK)} as s, {strip_sql('alias')} as a from raw",
            "good": f"select *, s = a or regexp_replace(s, '[{SP}]', '', 'g') = regexp_replace(a, '[{SP}]', '', 'g') and a <> '' as is_alias from lines where s <> '' and not (length(s) <= 80 and ({AD_SQL}))",
            "counted": "select *, coalesce(sum(case when is_alias then 0 else 1 end) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as before from good",
            "kept": "select doc_id, string_agg(s, chr(10) order by n) as c from counted where not is_alias or before > 1 group by doc_id",
        },
        body=f"select t.doc_id, md5(coalesce({strip_sql('c')}, '')) as content from texts t left join kept k on t.doc_id = k.doc_id",
    ),
)
def clean_content(spark, d):
    texts = load(spark, d, "texts").select(
        F.col("doc_id").alias("page_id"), "text", F.substring_index("text", "\n", 1).alias("first_line")
    )
    out = clean_html(texts, lambda: [F.col("first_line")], "[0-9]{4,}###")
    return out.select(F.col("page_id").alias("doc_id"), F.md5("content").alias("content"))


@query("fold_script", "select doc_id, md5(translate(text, 'éèêçà', 'eeeca')) as folded from documents")
def fold_script(spark, d):
    pairs = dict(zip("éèêçà", "eeeca"))
    return load(spark, d, "documents").select("doc_id", F.md5(text.fold_script(F.col("text"), pairs)).alias("folded"))


@query("regex_chain", r"select doc_id, md5(regexp_replace(regexp_replace(text, '([A-Za-z]+)tion', '\1TION', 'g'), '(?i)the[ ]+', '_', 'g')) as out from documents")
def regex_chain(spark, d):
    rules = [(r"([A-Za-z]+)tion", "$1TION"), ("([", "x"), (r"(?i)the[ ]+", "_")]
    return load(spark, d, "documents").select("doc_id", F.md5(text.regex_chain(F.col("text"), rules)).alias("out"))


LINES_SQL = "select doc_id, string_split(text, chr(10)) as ls from texts"


@query(
    "pick_index",
    sql_for(
        "texts",
        extra={"l": LINES_SQL},
        body="select doc_id, " + ", ".join(
            f"md5(array_to_string({e}, '|')) as {n}"
            for n, e in {
                "first": "ls[1:1]", "last_one": "ls[-1:-1]", "third_back": "case when len(ls) >= 3 then ls[-3:-3] else [] end",
                "two": "ls[1:2]", "last_two": "case when len(ls) > 2 then ls[-2:] else ls end", "rest": "ls[2:]",
            }.items()
        ) + " from l",
    ),
)
def pick_index(spark, d):
    ls = F.col("ls")
    specs = {
        "first": lists.pick_at(ls, 0), "last_one": lists.pick_at(ls, -1), "third_back": lists.pick_at(ls, -3),
        "two": lists.pick_slice(ls, 0, 2), "last_two": lists.pick_slice(ls, -1, -2), "rest": lists.exclude_at(ls, 0),
    }
    rows = load(spark, d, "texts").select("doc_id", F.split("text", "\n").alias("ls"))
    return rows.select("doc_id", *[F.md5(F.array_join(c, "|")).alias(n) for n, c in specs.items()])


@query("exclude_two", sql_for("texts", extra={"l": LINES_SQL}, body="select doc_id, md5(array_to_string(case when len(ls) > 2 then ls[2:len(ls)-1] else [] end, '|')) as ends_cut, md5(array_to_string(list_concat(ls[2:2], ls[4:]), '|')) as first_and_third_cut from l"))
def exclude_two(spark, d):
    rows = load(spark, d, "texts").select("doc_id", F.split("text", "\n").alias("ls"))
    return rows.select(
        "doc_id",
        F.md5(F.array_join(lists.exclude_two(F.col("ls"), 0, -1), "|")).alias("ends_cut"),
        F.md5(F.array_join(lists.exclude_two(F.col("ls"), 0, 1), "|")).alias("first_and_third_cut"),
    )


@query("reverse_list", sql_for("texts", extra={"l": LINES_SQL}, body="select doc_id, md5(array_to_string(list_reverse(ls), '|')) as out from l"))
def reverse_list(spark, d):
    rows = load(spark, d, "texts").select("doc_id", F.split("text", "\n").alias("ls"))
    return rows.select("doc_id", F.md5(F.array_join(lists.reverse_list(F.col("ls")), "|")).alias("out"))


@query("first_nonempty", sql_for("hits", body="select source_id, item_pos, case when intro <> '' then intro when cover_url <> '' then cover_url when last_chapter <> '' then last_chapter else '' end as v from hits"))
def first_nonempty(spark, d):
    return load(spark, d, "hits").select(
        "source_id", "item_pos", text.first_nonempty(F.col("intro"), F.col("cover_url"), F.col("last_chapter")).alias("v")
    )


@query("concat_lines", sql_for("hits", body="select source_id, item_pos, concat_ws(chr(10), nullif(intro, ''), nullif(cover_url, ''), nullif(last_chapter, '')) as v from hits"))
def concat_lines(spark, d):
    return load(spark, d, "hits").select(
        "source_id", "item_pos", text.concat_lines(F.col("intro"), F.col("cover_url"), F.col("last_chapter")).alias("v")
    )


@query(
    "interleave_chars",
    sql_for(
        "hits",
        extra={"o": "select source_id, item_pos, case when length(name) >= length(author) then name else author end as a, case when length(name) >= length(author) then author else name end as b from hits"},
        body="select source_id, item_pos, case when b = '' then a else array_to_string(flatten(list_transform(list_zip(string_split(a, ''), string_split(b, '')), lambda z: [coalesce(z[1], ''), coalesce(z[2], '')])), '') end as v from o",
    ),
)
def interleave_chars(spark, d):
    return load(spark, d, "hits").select(
        "source_id", "item_pos", text.interleave_chars(F.col("name"), F.col("author")).alias("v")
    )


# URLs -------------------------------------------------------------------------------

PAGE_LINKS = """select h.source_id, h.item_pos, concat(s.url, '/list/p', cast(h.item_pos % 3 as varchar(9)), '.html?x=1') as page_url, s.url as site, cast(h.item_pos % 9 as int) as form, case h.item_pos % 9 when 0 then h.book_url when 1 then concat('.', h.book_url) when 2 then concat('..', h.book_url) when 3 then concat('//cdn.example.com', h.book_url) when 4 then 'javascript:void(0)' when 5 then '#' when 6 then concat('https://x.example.com', h.book_url) when 7 then concat('c', h.book_url) else '?page=2' end as href, h.book_url from hits h join sources s on h.source_id = s.id"""
LINKS_WITH = {"links": PAGE_LINKS}
ABS_CASE = "case form when 0 then concat(site, book_url) when 1 then concat(site, '/list', book_url) when 2 then concat(site, book_url) when 3 then concat('https://cdn.example.com', book_url) when 4 then '' when 5 then '' when 6 then href when 7 then concat(site, '/list/c', book_url) else concat(split_part(page_url, '?', 1), '?page=2') end"


def links(spark, d):
    load(spark, d, "hits").createOrReplaceTempView("hits")
    load(spark, d, "sources").createOrReplaceTempView("sources")
    return spark.sql(PAGE_LINKS)


@query("abs_url", sql_for("hits", "sources", extra=LINKS_WITH, body=f"select source_id, item_pos, {ABS_CASE} as url from links"))
def abs_url(spark, d):
    return links(spark, d).select("source_id", "item_pos", urls.abs_url(F.col("page_url"), F.col("href")).alias("url"))


@query("book_url", sql_for("hits", "sources", extra=LINKS_WITH, body=f"select source_id, item_pos, case when form in (0, 1, 2, 3) then {ABS_CASE} else href end as url from links"))
def book_url(spark, d):
    return links(spark, d).select("source_id", "item_pos", urls.book_url(F.col("href"), F.col("page_url")).alias("url"))


@query("url_valid", sql_for("hits", "sources", extra=LINKS_WITH, body="select source_id, item_pos, form = 6 as valid, form not in (3, 6) as broken from links"))
def url_valid(spark, d):
    broken = F.concat(F.lit('["'), F.col("page_url"), F.lit('"]'))
    return links(spark, d).select(
        "source_id", "item_pos", urls.url_valid(F.col("href")).alias("valid"),
        (~urls.url_valid(broken) & ~F.col("href").rlike("//")).alias("broken"),
    )


@query("host_of", "select page_id, case when split_part(split_part(url, '://', 2), '/', 1) = '' then '—' else split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1) end as host from pages")
def host_of(spark, d):
    return load(spark, d, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"))


@query("base_url", "select page_id, concat('https://', split_part(split_part(url, '://', 2), '/', 1)) as from_bare, concat(split_part(url, '://', 1), '://', split_part(split_part(url, '://', 2), '/', 1)) as from_url from pages")
def base_url(spark, d):
    return load(spark, d, "pages").select(
        "page_id",
        urls.base_url(F.regexp_replace("url", "^https?://", "//")).alias("from_bare"),
        urls.base_url(F.col("url")).alias("from_url"),
    )


@query("unescape_slashes", "select page_id, url as unescaped from pages")
def unescape_slashes(spark, d):
    return load(spark, d, "pages").select(
        "page_id", urls.unescape_slashes(F.replace("url", F.lit("/"), F.lit("\\/"))).alias("unescaped")
    )


@query("first_url", r"""select page_id, regexp_extract(concat('go to "', url, '" or ', html), 'https?://[^\s"''<>\\]+') as link, replace(url, '/', '/') as unescaped from pages""")
def first_url(spark, d):
    return load(spark, d, "pages").select(
        "page_id",
        urls.first_url(F.concat(F.lit('go to "'), F.col("url"), F.lit('" or '), F.col("html"))).alias("link"),
        urls.unescape_slashes(F.replace("url", F.lit("/"), F.lit("\\/"))).alias("unescaped"),
    )


# JSON -------------------------------------------------------------------------------

EVENT_JSON = """concat('{"code":0,"data":{"list":[{"k":', cast(user_id as string), ',"t":"', event_type, '"},', props, '],"k":"top"}}')"""
K = "json_extract_string(props, '$.k')"


def event_docs(spark, d):
    return load(spark, d, "events").withColumn("body", F.expr(EVENT_JSON)).withColumn("v", F.try_parse_json("body"))


@query("json_path", f"select event_id, concat('[', user_id, ',', {K}, ']') as ks, {K} as last_k, event_type as first_t, cast(user_id as varchar) as sliced, '' as missing from events")
def json_path(spark, d):
    p = jsons.path_text
    v, data, items = F.col("v"), jsons.key("data"), jsons.key("list")
    return event_docs(spark, d).select(
        "event_id",
        p(v, data, items, jsons.wildcard(), jsons.key("k")).alias("ks"),
        p(v, data, items, jsons.index(-1), jsons.key("k")).alias("last_k"),
        p(v, data, items, jsons.key("t")).alias("first_t"),
        p(v, data, items, jsons.span(0, 1), jsons.key("k")).alias("sliced"),
        p(v, data, jsons.key("nope")).alias("missing"),
    )


@query("json_recursive", f"""select event_id, concat(user_id, ',', {K}, ',"top"') as ks from events""")
def json_recursive(spark, d):
    docs = event_docs(spark, d)
    return docs.select("event_id", F.array_join(jsons.json_recursive(F.col("body"), "k"), ",").alias("ks"))


@query("json_filter", f"""select event_id, case when {K} = '50' and user_id = 50 then '[50,50]' when {K} = '50' or user_id = 50 then '50' else '' end as equal_k, case when user_id > 50 and cast({K} as int) > 50 then concat('[', user_id, ',', {K}, ']') when user_id > 50 then cast(user_id as varchar) when cast({K} as int) > 50 then {K} else '' end as high_k, cast(user_id as varchar) as with_t from events""")
def json_filter(spark, d):
    v, items = F.col("v"), (jsons.key("data"), jsons.key("list"))

    def kept(test):
        return jsons.path_text(v, *items, jsons.where(test), jsons.key("k"))

    return event_docs(spark, d).select(
        "event_id",
        kept(lambda x: jsons.compare(jsons.field(x, "k"), "==", "50")).alias("equal_k"),
        kept(lambda x: jsons.compare(jsons.field(x, "k"), ">", 50)).alias("high_k"),
        kept(lambda x: jsons.exists(x, "t")).alias("with_t"),
    )


@query("parse_json_loose", f"select event_id, {K} as k, event_id % 3 < 2 as parsed from events where event_id % 3 < 2 union all select event_id, null, false from events where event_id % 3 = 2")
def parse_json_loose(spark, d):
    form = F.col("event_id") % 3
    body = (
        F.when(form == 0, F.concat(F.lit("callback("), F.col("props"), F.lit(");")))
        .when(form == 1, F.concat(F.col("props"), F.lit(" // end")))
        .otherwise(F.lit("no json here"))
    )
    v = jsons.parse_json_loose(body)
    return load(spark, d, "events").select(
        "event_id", F.try_variant_get(v, "$.k", "string").alias("k"), v.isNotNull().alias("parsed")
    )


@query("merge_json", f"select event_id, {K} as theme_size, event_type as theme_font, cast(user_id as varchar) as width from events")
def merge_json(spark, d):
    schema = struct(theme=struct(size=T.StringType(), font=T.StringType()), width=T.StringType())
    base = F.concat(F.lit('{"theme":{"size":1,"font":"'), F.col("event_type"), F.lit('"},"width":'), F.col("user_id").cast("string"), F.lit("}"))
    patch = F.concat(F.lit('{"theme":{"size":'), F.get_json_object("props", "$.k"), F.lit('},"width":null}'))
    m = jsons.merge_json(base, patch, schema)
    return load(spark, d, "events").withColumn("m", m).select(
        "event_id", F.col("m.theme.size").alias("theme_size"), F.col("m.theme.font").alias("theme_font"), F.col("m.width").alias("width")
    )


@query("kv_lines", f"select event_id, event_type as a, {K} as b, cast(user_id as varchar) as agent from events")
def kv_lines_query(spark, d):
    k = F.get_json_object("props", "$.k")
    lines = F.concat(F.lit("a="), F.col("event_type"), F.lit("\n//b = "), k, F.lit(" \nnoise"))
    quoted = F.concat(F.lit("{'a':'"), F.col("event_type"), F.lit("','b':'"), k, F.lit("'}"))
    values = kv_lines(F.when(F.col("event_id") % 2 == 0, lines).otherwise(quoted))
    headers = header_lines(F.concat(F.lit("User-Agent: "), F.col("user_id").cast("string"), F.lit("\nReferer: x")))
    return load(spark, d, "events").withColumns({"m": values, "h": headers}).select(
        "event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("h")["User-Agent"].alias("agent")
    )


# Encodings --------------------------------------------------------------------------


@query("hash_encode", "select doc_id, base64(encode(text)) as b64, lower(hex(encode(text))) as hexed, text as from_b64, text as from_hex, md5(text) as m, sha1(text) as s1, sha256(text) as s256 from documents")
def hash_encode(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", codec.base64_encode(F.col("text")).alias("b64"), codec.hex_encode(t).alias("hexed"),
        codec.base64_decode(codec.base64_encode(t)).alias("from_b64"), codec.hex_decode(codec.hex_encode(t)).alias("from_hex"),
        codec.md5(F.col("text")).alias("m"), codec.sha1(F.col("text")).alias("s1"), codec.sha256(F.col("text")).alias("s256"),
    )


@query("time_format", "select event_id, strftime(ts, '%Y/%m/%d %H:%M') as shown, strftime(ts, '%Y-%m-%d %H:%M:%S') as full_form from events")
def time_format(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return load(spark, d, "events").select(
        "event_id", codec.time_format(ms).alias("shown"),
        codec.time_format(F.floor(ms / 1000), "yyyy-MM-dd HH:mm:ss").alias("full_form"),
    )


@query("encode_keyword", """with c as (select distinct name from (select case when p_partkey % 5 = 0 then concat('《', p_name, '》') else p_name end as name from part) t)
select name, replace(replace(replace(name, ' ', '%20'), '《', '%A1%B6'), '》', '%A1%B7') as gbk, replace(replace(replace(name, ' ', '%20'), '《', '%E3%80%8A'), '》', '%E3%80%8B') as utf8 from c""")
def encode_keyword(spark, d):
    names = load(spark, d, "part").select(
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("《"), "p_name", F.lit("》"))).otherwise(F.col("p_name")).alias("name")
    ).distinct()
    return names.select(
        "name", codec.encode_keyword(F.col("name"), F.lit("gb2312")).alias("gbk"), codec.encode_keyword(F.col("name"), F.lit("")).alias("utf8")
    )
