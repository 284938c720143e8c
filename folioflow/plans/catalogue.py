"""Source catalogue: definitions, imports, filters, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import catalog, health
from folioflow.plans.registry import query
from folioflow.plans.views import load, sql_for
from folioflow.session import scratch_path
from folioflow.sources import definitions as defs
from folioflow.sources import requests

# Raw definitions as people share them: four spellings, derived from the sources.
RAW_DEFS = """select id, case id % 4
 when 0 then concat('{"bookSourceName":" ', name, ' ","bookSourceUrl":"', url, '/path/","bookSourceGroup":"', group_name, '","enabled":"off","weight":"', cast(weight as string), 'kg","searchUrl":"/s?q={{key}}","ruleToc":{"chapterList":".l"},"ruleContent":{"content":"#c"},"lastUpdateTime":', cast(id * 1000 as string), '}')
 when 1 then concat('{"Source_Name":"', name, '","name":"second","HOST":"', replace(url, 'https://', ''), '","tag":"', group_name, '","is-enabled":1,"priority":', cast(weight as string), '.9,"rule_search":"{', chr(39), 'content', chr(39), ':', chr(39), '#c', chr(39), ',', chr(39), 'chapterList', chr(39), ':', chr(39), '.l', chr(39), '}","search-url":"', url, '/find"}')
 when 2 then concat('{"title":"', name, '","url":"","comment":"no address","ruleSearch":{"searchUrl":"/q"}}')
 else concat('{"sourcename":"', name, '","site":"HTTP://S', cast(id as string), '.example.com:80/x?y","exploreUrl":"all::/all","enable":"weird","customOrder":', cast(id as string), ',"respondTime":700}') end as raw from sources"""

EXPECTED = """select id,
 name, case id % 4 when 2 then '' when 3 then concat('http://s', id, '.example.com') else url end as url,
 case when id % 4 in (0, 1) then group_name else '' end as group_name,
 id % 4 <> 0 as enabled, case when id % 4 in (0, 1) then weight else 0 end as weight,
 case id % 4 when 0 then '/s?q={{key}}' when 1 then concat(url, '/find') when 2 then '/q' else '' end as search_url,
 case when id % 4 = 3 then 'all::/all' else '' end as explore_url,
 case when id % 4 = 0 then id * 1000 else 0 end as last_update_time,
 id % 4 <> 3 as can_search, false as can_book_info, id % 4 in (0, 1) as can_toc, id % 4 in (0, 1) as can_content,
 id % 4 <> 2 as usable, cast(case id % 4 when 2 then 3 when 3 then 2 else 0 end as int) as issue_count from sources"""


def raw_defs(spark, d):
    load(spark, d, "sources").createOrReplaceTempView("sources")
    return spark.sql(RAW_DEFS)


def normalized(spark, d):
    return defs.normalize_source(raw_defs(spark, d))


@query("read_sources", sql_for("sources", extra={"e": EXPECTED}, body="select cast(floor(id / 10) as int) as doc_id, count(*) as n, sum(length(name)) as chars from e group by 1"))
def read_sources(spark, d):
    # One shared text per ten sources, in the forms people paste: wrapped, listed, with prose, line by line.
    rows = raw_defs(spark, d).withColumn("doc_id", F.floor(F.col("id") / 10).cast("int"))
    texts = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "raw"))).alias("r"))
    listed = F.array_join(F.transform("r", lambda x: x["raw"]), ",")
    form = F.col("doc_id") % 4
    text = (
        F.when(form == 0, F.concat(F.lit('﻿{"bookSources":['), listed, F.lit(',"junk",7]}')))
        .when(form == 1, F.concat(F.lit("["), listed, F.lit("]")))
        .when(form == 2, F.concat(F.lit("try these: ["), listed, F.lit("] thanks")))
        .otherwise(F.concat(F.array_join(F.transform("r", lambda x: x["raw"]), ",\n"), F.lit(",\nbye]")))
    )
    found = defs.normalize_source(defs.read_sources(texts.select("doc_id", text.alias("text"))))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("name")).alias("chars"))


@query("read_source_arrays", sql_for("sources", extra={"e": EXPECTED}, body="select count(*) as n, cast(sum(length(name)) as bigint) as chars, cast(sum(weight) as bigint) as weight, count(*) filter (where enabled) as enabled from e"))
def read_source_arrays(spark, d):
    # All sources in one file that is a single array, read in byte ranges.
    rows = raw_defs(spark, d)
    last = rows.agg(F.max("id")).first()[0]
    raw = F.when(F.col("id") == last, F.concat("raw", F.lit("]"))).otherwise(F.col("raw"))
    folder = scratch_path(spark, "source-array")
    first = spark.range(1).select(F.lit("[7").alias("value"), F.lit(-1).cast("long").alias("id"))
    rows.select(raw.alias("value"), F.col("id").cast("long").alias("id")).unionByName(first).coalesce(1).sortWithinPartitions("id").select("value").write.option("lineSep", ",\n").text(folder)
    found = defs.normalize_source(defs.read_source_arrays(spark, folder))
    return found.agg(F.count("*").alias("n"), F.sum(F.length("name")).alias("chars"), F.sum("weight").alias("weight"), F.count_if("enabled").alias("enabled"))


NORMAL = ["id", "name", "url", "group_name", "enabled", "weight", "search_url", "explore_url", "last_update_time"]


@query("normalize_source", sql_for("sources", extra={"e": EXPECTED}, body=f"select {', '.join(NORMAL)} from e"))
def normalize_source(spark, d):
    return normalized(spark, d).select(*NORMAL)


CAPABLE = ["id", "can_search", "can_book_info", "can_toc", "can_content", "usable", "issue_count"]


@query("source_capability", sql_for("sources", extra={"e": EXPECTED}, body=f"select {', '.join(CAPABLE)} from e"))
def source_capability(spark, d):
    return normalized(spark, d).withColumn("issue_count", F.size("issues")).select(*CAPABLE)


@query("coerce_values", """select event_id, case event_id % 7 when 0 then false when 1 then true when 2 then false when 3 then true when 4 then true when 5 then false else true end as flag,
 case event_id % 7 when 6 then 7 else cast(floor(value) as bigint) end as number, event_type as member from events""")
def coerce_values(spark, d):
    words = F.array(*map(F.lit, ["false", "Yes ", "0", "on", "", "DISABLED", "maybe"]))
    form = (F.col("event_id") % 7).cast("int")
    number = F.when(form == 6, F.lit("none")).otherwise(F.concat(F.col("value").cast("string"), F.lit("px")))
    obj = F.concat(F.lit("{'t':'"), F.col("event_type"), F.lit("'}"))
    return load(spark, d, "events").select(
        "event_id", defs.as_bool(words[form]).alias("flag"), defs.as_int(number, 7).alias("number"),
        defs.as_object(obj)["t"].alias("member"),
    )


# Import -----------------------------------------------------------------------------

# The catalogue holds a part of the sources; the import brings all of them, twice.
OLD_SQL = "select id, name, url, group_name, 0 as type, enabled, weight, '' as comment, '{}' as raw, cast(0 as bigint) as last_update_time, sort_order from sources where weight > 40"
ROWS_SQL = "select id * 2 as pos, name, case when id % 4 = 2 then '' else url end as url, 'first' as group_name, enabled, 1 as weight from sources union all select id * 2 + 1, name, case when id % 4 = 2 then '' else url end, 'second', enabled, 2 from sources"
IMPORT_STEPS = {"old": OLD_SQL, "incoming": ROWS_SQL}


def old_catalog(spark, d):
    load(spark, d, "sources").createOrReplaceTempView("sources")
    return spark.sql(OLD_SQL)


def incoming(spark, d):
    load(spark, d, "sources").createOrReplaceTempView("sources")
    return spark.sql(ROWS_SQL).withColumns(
        {"type": F.lit(0), "comment": F.lit(""), "raw": F.lit("{}"), "last_update_time": F.lit(0).cast("long")}
    )


ACTIONS_SQL = "select i.name, i.pos, case when i.url = '' then 'failed' when o.id is not null or i.pos <> min(i.pos) over (partition by i.name, i.url) then '{repeat}' else 'added' end as action from incoming i left join old o on o.name = i.name and o.url = i.url"


@query("import_sources", sql_for("sources", extra=IMPORT_STEPS, body=ACTIONS_SQL.format(repeat="skipped")))
def import_sources(spark, d):
    return defs.import_actions(old_catalog(spark, d), incoming(spark, d)).select("name", "pos", "action")


@query("import_counts", sql_for("sources", extra={**IMPORT_STEPS, "a": ACTIONS_SQL.format(repeat="updated")}, body="select action, count(*) as n from a group by action"))
def import_counts(spark, d):
    return defs.import_counts(defs.import_actions(old_catalog(spark, d), incoming(spark, d), "merge"))


UPSERT = ["id", "name", "url", "group_name", "weight"]


@query("upsert_sources", sql_for("sources", extra={
    **IMPORT_STEPS,
    "last": "select * from (select *, row_number() over (partition by name, url order by pos desc) as rn, min(pos) over (partition by name, url) as first_pos from incoming where url <> '') t where rn = 1",
    "kept": "select o.id, o.name, o.url, coalesce(l.group_name, o.group_name) as group_name, coalesce(l.weight, o.weight) as weight from old o left join last l on l.name = o.name and l.url = o.url",
    "fresh": "select (select coalesce(max(id), 0) from old) + row_number() over (order by l.first_pos) as id, l.name, l.url, l.group_name, l.weight from last l left join old o on l.name = o.name and l.url = o.url where o.id is null",
}, body="select id, name, url, group_name, weight from kept union all select id, name, url, group_name, weight from fresh"))
def upsert_sources(spark, d):
    return defs.upsert_sources(old_catalog(spark, d), incoming(spark, d), "merge").select(*UPSERT)


@query("union_imports", sql_for("sources", extra=IMPORT_STEPS, body="select part, count(*) as n, max(pos) as last_pos from (select 0 as part, pos from incoming union all select 1, pos from incoming where weight = 2) u group by part"))
def union_imports(spark, d):
    rows = incoming(spark, d)
    both = defs.union_imports(rows, rows.filter(F.col("weight") == 2))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query("update_source", sql_for("sources", extra={"e": EXPECTED}, body="select id, case when id % 4 = 0 then concat('new ', id) when id % 4 = 1 then name else name end as name, url, search_url, case when id % 4 = 2 then 'note' else '' end as comment from e"))
def update_source(spark, d):
    cat = raw_defs(spark, d)
    form = F.col("id") % 4
    patch = (
        F.when(form == 0, F.concat(F.lit('{"bookSourceName":"new '), F.col("id").cast("string"), F.lit('"}')))
        .when(form == 2, '{"comment":"note"}')
        .otherwise("{}")
    )
    return defs.update_source(cat, cat.select("id", patch.alias("patch"))).select("id", "name", "url", "search_url", "comment")


@query("export_sources", sql_for("sources", extra={"e": EXPECTED}, body="""select name as "bookSourceName", url as "bookSourceUrl", group_name as "bookSourceGroup", case when id % 4 = 3 then id else 5 end as "customOrder", enabled, true as "enabledExplore", cast(case when id % 4 = 3 then 700 else 180000 end as bigint) as "respondTime", case id % 4 when 0 then '{"chapterList":".l"}' else '{}' end as "ruleToc", weight from e"""))
def export_sources(spark, d):
    cat = normalized(spark, d).withColumn("sort_order", F.lit(5))
    return defs.export_sources(cat).select(
        "bookSourceName", "bookSourceUrl", "bookSourceGroup", "customOrder", "enabled", "enabledExplore", "respondTime", "ruleToc", "weight"
    )


# Requests ---------------------------------------------------------------------------

PLAN_SOURCES = """select id, url, case id % 3 when 0 then concat('/s?q={{key}}&p={{ page }}', chr(10), '/second') when 1 then concat(url, '/post,{"method":"post","body":"kw={{key}}&from={{baseUrl}}","charset":"gbk"}') else concat('/x,{', chr(39), 'headers', chr(39), ':{', chr(39), 'A', chr(39), ':', chr(39), 'b', chr(39), '}}') end as search_url from sources"""


@query("plan_requests", sql_for("sources", extra={"k": "select unnest(['red ring', '斗破']) as keyword, unnest(['red%20ring', '%B6%B7%C6%C6']) as gbk, unnest(['red%20ring', '%E6%96%97%E7%A0%B4']) as utf8", "p": "select unnest([1, 2]) as page"}, body="""
select id as source_id, keyword, page, case id % 3 when 0 then concat(url, '/s?q=', utf8, '&p=', page) when 1 then concat(url, '/post') else concat(url, '/x') end as request_url,
 case when id % 3 = 1 then 'POST' else 'GET' end as method, case when id % 3 = 1 then concat('kw=', gbk, '&from=', url) else '' end as body,
 case id % 3 when 1 then 'application/x-www-form-urlencoded;charset=UTF-8' when 2 then 'b' else '' end as header, case when id % 3 = 1 then 'gbk' else '' end as charset
from sources cross join k cross join p"""))
def plan_requests(spark, d):
    load(spark, d, "sources").createOrReplaceTempView("sources")
    asked = spark.sql(PLAN_SOURCES).withColumns(
        {"header": F.create_map().cast("map<string,string>"), "charset": F.lit("")}
    )
    plan = requests.plan_requests(asked, ["red ring", "斗破"], [1, 2])
    return plan.withColumn("header", F.coalesce(F.col("headers")["Content-Type"], F.col("headers")["A"], F.lit(""))).drop("headers")


EXPLORE = """select id, name, weight, sort_order, case id % 4 when 0 then '[{"title":" A ","url":"/a"},{"name":"B","url":"/b"},{"title":"none"}]' when 1 then concat('C::/c', chr(10), '::/d', chr(10), ' ', chr(10), '/e', chr(10), 'F::/f') when 2 then '' else '/only' end as explore_url from sources"""
GROUPS = {"g": """select id, cast(unnest(range(0, n)) as int) as group_pos, unnest(titles) as title, unnest(urls) as url, weight, sort_order, name from (select *, len(titles) as n from (select *, case id % 4 when 0 then ['A', 'B'] when 1 then ['C', '分类', '分类', 'F'] when 2 then [] else ['分类'] end as titles, case id % 4 when 0 then ['/a', '/b'] when 1 then ['/c', '/d', '/e', '/f'] when 2 then [] else ['/only'] end as urls from sources) t) u"""}


def explore_sources(spark, d):
    load(spark, d, "sources").createOrReplaceTempView("sources")
    return spark.sql(EXPLORE)


@query("parse_explore", sql_for("sources", extra=GROUPS, body="select id, group_pos, title, url from g"))
def parse_explore(spark, d):
    groups = requests.parse_explore(F.col("explore_url"))
    return explore_sources(spark, d).select("id", F.posexplode(groups).alias("group_pos", "g")).select("id", "group_pos", "g.title", "g.url")


@query("cap_explore", sql_for("sources", extra={**GROUPS, "few": "select id from sources where id % 4 <> 2 order by weight desc, sort_order, id limit 6"}, body="select g.id as source_id, g.name, g.group_pos, g.title, g.url from g where g.id in (select id from few) and g.group_pos < 3"))
def cap_explore(spark, d):
    return requests.cap_explore(explore_sources(spark, d))


@query("join_rules", sql_for("page_rows", "sources", body="""select p.page_id, p.source_id, case when p.source_id % 2 = 0 then '.ex' else '.se' end as list_rule, '.n' as name_rule, case when p.source_id % 2 = 0 then 'ex-kind' else '' end as kind_rule
 from (select page_id, page_id % (select count(*) from sources) as source_id from page_rows) p join sources s on s.id = p.source_id"""))
def join_rules(spark, d):
    sources = load(spark, d, "sources")
    even = F.col("id") % 2 == 0
    explore = F.when(even, F.expr("map('bookList', '.ex', 'category', 'ex-kind', 'name', ' ')")).otherwise(F.expr("map('name', '')"))
    rules = sources.select("id", explore.alias("rule_explore"), F.expr("map('bookList', '.se', 'bookName', '.n')").alias("rule_search"))
    n = sources.agg(F.count("*")).scalar()
    pages = load(spark, d, "page_rows").select("page_id", (F.col("page_id") % n).alias("source_id"))
    return requests.join_rules(pages, rules).select(
        "page_id", "source_id", F.col("rule_bookList").alias("list_rule"), F.col("rule_name").alias("name_rule"), F.col("rule_kind").alias("kind_rule")
    )


# Catalogue --------------------------------------------------------------------------


def cat(spark, d):
    return load(spark, d, "catalog")


@query("evolve_schema", sql_for("sources", body="select id, name, cast(null as timestamp) as last_test_at, false as last_test_ok, 0 as last_test_count, '' as last_test_error from sources"))
def evolve_schema(spark, d):
    once = catalog.evolve_schema(load(spark, d, "sources"), catalog.HEALTH_COLUMNS)
    twice = catalog.evolve_schema(once, catalog.HEALTH_COLUMNS)
    return twice.select("id", "name", "last_test_at", "last_test_ok", "last_test_count", "last_test_error")


@query("source_view", sql_for("catalog", body="select id, name, respond_time, last_test_ok, last_test_count, last_test_error, case when last_test_at is null then 'untested' when last_test_ok then 'ok' else 'fail' end as test_status, search_url <> '' as searchable from catalog"))
def source_view(spark, d):
    return catalog.source_view(cat(spark, d)).select(
        "id", "name", "respond_time", "last_test_ok", "last_test_count", "last_test_error", "test_status", "searchable"
    )


@query("filter_sources", sql_for("catalog", body="select id, name from catalog where (name ilike '%SUPPLIER#%1%' or url ilike '%SUPPLIER#%1%' or comment ilike '%SUPPLIER#%1%' or group_name ilike '%SUPPLIER#%1%') and group_name ilike '%a%' and enabled and last_test_at is not null and last_test_ok"))
def filter_sources(spark, d):
    return catalog.filter_sources(cat(spark, d), "SUPPLIER#%1", "a", True, "ok").select("id", "name")


@query("filter_groups", sql_for("catalog", body="select id, group_name from catalog where list_has_any(string_split(group_name, ';'), ['ASIA', 'NATION_3'])"))
def filter_groups(spark, d):
    return catalog.filter_groups(cat(spark, d), ["ASIA", " NATION_3", ""]).select("id", "group_name")


@query("page_sources", sql_for("catalog", body="select id, name, (select count(*) from catalog where enabled) as total from (select * from catalog where enabled order by weight desc, sort_order, id limit 20 offset 20) p"))
def page_sources(spark, d):
    return catalog.page_sources(cat(spark, d).filter("enabled"), 2, 20).select("id", "name", "total")


@query("enabled_sources", sql_for("catalog", body="select id, name from (select * from catalog where enabled order by weight desc, sort_order, id limit 500) c where search_url <> ''"))
def enabled_sources(spark, d):
    return catalog.enabled_sources(cat(spark, d)).select("id", "name")


@query("collect_scope", sql_for("catalog", body="select id from (select * from catalog where last_test_at is null order by weight desc, sort_order, id limit 4000) c"))
def collect_scope(spark, d):
    return catalog.collect_scope(cat(spark, d), status="untested").select("id")


@query("semi_scope", sql_for("catalog", "health_runs", body="select id, name from catalog where last_test_at is not null and not last_test_ok and id in (select source_id from health_runs where hit_count > 50)"))
def semi_scope(spark, d):
    scope = load(spark, d, "health_runs").filter(F.col("hit_count") > 50).select(F.col("source_id").alias("id")).distinct()
    return catalog.semi_scope(health.invalid_sources(cat(spark, d)), scope).select("id", "name")


@query("anti_delete", sql_for("books", "chapters", "bookmarks", extra={"gone": "select id from books where source_id % 3 = 0"}, body="""select 'books' as part, count(*) as n from books where id not in (select id from gone)
 union all select 'chapters', count(*) from chapters where book_id not in (select id from gone) union all select 'bookmarks', count(*) from bookmarks where book_id not in (select id from gone)"""))
def anti_delete(spark, d):
    from folioflow.operators.library import delete_books

    tables = {n: load(spark, d, n) for n in ("books", "chapters", "bookmarks")}
    gone = tables["books"].filter(F.col("source_id") % 3 == 0).select("id")
    left = delete_books(tables, gone)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("distinct_groups", sql_for("catalog", body="select distinct trim(g) as group_name from (select unnest(string_split(group_name, ';')) as g from catalog) t where trim(g) <> ''"))
def distinct_groups(spark, d):
    return catalog.distinct_groups(cat(spark, d))


@query("group_members", sql_for("catalog", extra={"g": "select *, case when id % 5 = 0 then '未分组' else group_name end as group_label from catalog", "r": "select *, row_number() over (partition by group_label order by weight desc, sort_order, id) as rn, count(*) over (partition by group_label) as members from g"}, body="select group_label, rn as pos, id, name, members from r"))
def group_members(spark, d):
    rows = cat(spark, d).withColumn("group_name", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("group_name")))
    return catalog.group_members(rows)


@query("patch_source", sql_for("catalog", body="select id, case when id % 3 = 0 then false else enabled end as enabled, case when id % 2 = 0 then 77 else weight end as weight, group_name from catalog"))
def patch_source(spark, d):
    c = cat(spark, d)
    patch = c.select(
        "id", F.when(F.col("id") % 3 == 0, False).alias("enabled"), F.when(F.col("id") % 2 == 0, 77).alias("weight"),
        F.lit(None).cast("string").alias("group_name"), F.lit(None).cast("int").alias("sort_order"),
    )
    return catalog.patch_source(c, patch).select("id", "enabled", "weight", "group_name")


CHOSEN = {"chosen": "select id from catalog where weight > 20"}
GROUP_OF_FIRST = "ASIA"


@query("select_scope_ops", sql_for("catalog", extra={
    **CHOSEN, "g": "select min(group_name) as g from catalog",
    "toggled": "select id from chosen where (select count(*) from catalog where group_name = (select g from g) and id not in (select id from chosen)) > 0 or id not in (select id from catalog where group_name = (select g from g)) union select id from catalog where group_name = (select g from g) and (select count(*) from catalog where group_name = (select g from g) and id not in (select id from chosen)) > 0",
}, body="""select 'invert' as op, id from catalog where id not in (select id from chosen)
 union all select 'only_ok', id from catalog where last_test_at is not null and last_test_ok
 union all select 'minus_failed', id from chosen where id not in (select id from catalog where last_test_at is not null and not last_test_ok)
 union all select 'enabled', id from catalog where enabled union all select 'toggle_group', id from toggled"""))
def select_scope_ops(spark, d):
    c = cat(spark, d)
    chosen = c.filter(F.col("weight") > 20).select("id")
    group = c.agg(F.min("group_name")).first()[0]
    out = None
    for op in ("invert", "only_ok", "minus_failed", "enabled", "toggle_group"):
        part = catalog.select_scope_ops(c, chosen, op, group).select(F.lit(op).alias("op"), "id")
        out = part if out is None else out.unionByName(part)
    return out


# Health -----------------------------------------------------------------------------


@query("health_check", sql_for("sources", "hits", extra={
    "h": "select source_id, name, row_number() over (partition by source_id order by item_pos) as rn from hits where name like '%red%'",
    "a": "select source_id, count(*) filter (where rn <= 10) as n, string_agg(name, '|' order by rn) filter (where rn <= 3) as samples from h group by source_id",
}, body="""select s.id as source_id, coalesce(a.n, 0) > 0 and s.id % 13 <> 0 as ok, case when s.id % 13 = 0 then 0 else coalesce(a.n, 0) end as hit_count, case when s.id % 13 = 0 then '' else coalesce(a.samples, '') end as samples,
 case when s.id % 13 = 0 then 'timeout' when coalesce(a.n, 0) = 0 then '搜索成功但未解析出任何结果，请检查 bookList 及字段规则' else '' end as error from sources s left join a on a.source_id = s.id"""))
def health_check(spark, d):
    runs = load(spark, d, "sources").select(
        F.col("id").alias("source_id"), F.when(F.col("id") % 13 == 0, "timeout").otherwise("").alias("error")
    )
    return health.health_check(runs, load(spark, d, "hits").filter(F.col("name").contains("red")))


@query("health_summary", sql_for("health_runs", body="select count(*) as total, count(*) filter (where ok) as ok, count(*) filter (where not ok) as fail from health_runs"))
def health_summary(spark, d):
    return health.health_summary(load(spark, d, "health_runs"))


@query("record_health", sql_for("catalog", "health_runs", body="select c.id, c.last_test_at, c.last_test_ok, c.last_test_count, c.last_test_error, coalesce(h.elapsed, 0) as respond_time from catalog c left join health_runs h on h.source_id = c.id and h.tested_at = c.last_test_at"))
def record_health(spark, d):
    s = catalog.evolve_schema(load(spark, d, "sources").withColumn("respond_time", F.lit(0)), catalog.HEALTH_COLUMNS)
    return health.record_health(s, load(spark, d, "health_runs")).select(
        "id", "last_test_at", "last_test_ok", "last_test_count", "last_test_error", "respond_time"
    )


@query("health_stats", sql_for("catalog", body="select count(*) as total, count(*) filter (where last_test_at is not null and last_test_ok) as ok, count(*) filter (where last_test_at is not null and not last_test_ok) as fail, count(*) filter (where last_test_at is null) as untested from catalog"))
def health_stats(spark, d):
    return health.health_stats(cat(spark, d))


@query("invalid_sources", sql_for("catalog", body="select id, name, last_test_error from catalog where last_test_at is not null and not last_test_ok and enabled"))
def invalid_sources(spark, d):
    return health.invalid_sources(cat(spark, d), enabled_only=True).select("id", "name", "last_test_error")
