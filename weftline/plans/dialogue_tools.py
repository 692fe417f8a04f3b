"""Queries of the catalog checks, gates, tool calls, dialogue judging and training examples."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocab import OCCASIONS, STYLES
from weftline.operators import checks, evaluate, metrics
from weftline.operators import dialogue as dg
from weftline.plans.ingest import _list
from weftline.plans.queries import DIALOGUES
from weftline.plans.registry import query
from weftline.sources.tables import dialogues, pick, table

COLORS = ('["a"]', "[]", "not-json", "[null]", '["a",1]')
STORES = tuple(f"s{k}" for k in range(5))
URLS = ("ftp://x", "https://", "https:// x", "https://?", "HTTP://shop.vn/a", "https://a b", "https://.x", "httpS://x#y", "https://$", " https://x/1", "https://xy")
CATEGORY_WORDS = ("top", "bottom", "dress", "shoes")
VIEWS = f"""cat0 as (select 'i' || lpad(p_partkey::varchar, 6, '0') as item_id, p_partkey as k, case when p_partkey % 19 = 0 then 'hat' else {_list(CATEGORY_WORDS)}[p_partkey % 4 + 1] end as category,
  case when p_partkey % 23 = 0 then ' ' when p_partkey % 29 <> 0 then 't' end as title_vi, {_list(COLORS)}[p_partkey % 5 + 1] as colors, case when p_partkey % 31 = 0 then '' else 'd' end as desc_vi, 'img/' || p_partkey % 100 as image_path,
  case when p_partkey % 3 = 0 then 'unisex' else 'men' end as gender from part),
cat as (select * from cat0 union all select * from cat0 where k % 17 = 0),
link0 as (select item_id, k, 's' || (k % 6) as store_id, case when k % 7 = 0 then {_list(URLS)}[k % 11 + 1] when k % 41 <> 0 then 'https://x/' || k end as product_url, (k * 7919) % 60000 as price_vnd, case when k % 3 = 0 then (k * 7919) % 60000 + (k % 2) end as sale_price_vnd from cat0),
link as (select * from link0 where k % 13 <> 0 union all select 'x' || item_id, k, store_id, product_url, price_vnd, sale_price_vnd from link0 where k % 37 = 0 union all select * from link0 where k % 11 = 0 and k % 13 <> 0)"""
_OK = "(regexp_matches(colors, '^\\s*\\[\\s*\\]\\s*$') or colors = '[\"a\"]')"
_ROW_CODES = f"""cat_codes as (select k, item_id, unnest([case when category not in {tuple(['top', 'bottom', 'dress', 'outerwear', 'shoes', 'bag', 'accessory'])} then ('invalid_category', category) end, case when trim(coalesce(title_vi, '')) = '' then ('missing_title', item_id) end,
  case when not {_OK} then ('invalid_colors_json', colors) end, case when trim(desc_vi) = '' then ('empty_description', item_id) end]) as x from {{cat}}),
link_codes as (select k, item_id, unnest([case when store_id = 's5' then ('invalid_store_id', store_id) end, case when not coalesce(lower(product_url[1:5]) in ('http:', 'https') and regexp_full_match(substr(product_url, position('://' in product_url) + 3), '[^\\s/$.?#][^\n][^\\s]*') and lower(split_part(product_url, '://', 1)) in ('http', 'https'), false) then ('invalid_product_url', coalesce(product_url, '')) end,
  case when price_vnd not between 30000 and 50000000 then ('invalid_price', item_id) end, case when sale_price_vnd > price_vnd then ('sale_price_above_price', item_id) end]) as x from {{link}})"""


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A catalog and links with faults of every kind."""
    k = F.col("k")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("i"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("item_id"))
    price = (k * 7919) % 60_000
    cat0 = rows.select(
        "k", "item_id", F.when(k % 19 == 0, "hat").otherwise(pick(CATEGORY_WORDS, k % 4)).alias("category"), F.lit("").alias("source_product_type"), F.when(k % 3 == 0, "unisex").otherwise("men").alias("gender"), F.lit("casual").alias("formality"),
        F.concat(F.lit("img/"), (k % 100).cast("string")).alias("image_path"), F.when(k % 23 == 0, " ").when(k % 29 != 0, "t").alias("title_vi"), F.when(k % 31 == 0, "").otherwise("d").alias("desc_vi"), pick(COLORS, k % 5).alias("colors"), none.alias("collected_date"), none.alias("collector"),
    )
    link0 = rows.select(
        "k", "item_id", F.concat(F.lit("s"), (k % 6).cast("string")).alias("store_id"), none.alias("source_product_id"), F.when(k % 7 == 0, pick(URLS, k % 11)).when(k % 41 != 0, F.concat(F.lit("https://x/"), k.cast("string"))).alias("product_url"),
        price.alias("price_vnd"), F.when(k % 3 == 0, price + k % 2).alias("sale_price_vnd"), none.alias("sku"), F.lit(True).alias("in_stock"), none.alias("available_sizes"), none.alias("sizes_in_stock"),
    )
    kept = link0.where(k % 13 != 0)
    links = kept.unionByName(link0.where(k % 37 == 0).withColumn("item_id", F.concat(F.lit("x"), "item_id"))).unionByName(kept.where(k % 11 == 0))
    return cat0.unionByName(cat0.where(k % 17 == 0)), links


@query(f"""with {VIEWS}, {_ROW_CODES.format(cat='cat', link='link')}, r as (select x[1] as code, x[2] as key, 1 as w from cat_codes where x is not null union all select x[1], x[2], 1 from link_codes where x is not null
  union all select 'duplicate_item_id', item_id, count(*) - 1 from cat group by item_id having count(*) > 1 union all select 'duplicate_item_store_link', item_id, count(*) - 1 from link group by item_id, store_id having count(*) > 1
  union all select 'catalog_without_link', item_id, 1 from (select distinct item_id from cat where item_id not in (select item_id from link)) union all select 'link_without_catalog', item_id, 1 from (select distinct item_id from link where item_id not in (select item_id from cat))
  union all select 'missing_image_file', image_path, 1 from cat where k % 100 >= 90)
select code, case when code = 'empty_description' then 'warning' else 'error' end as level, sum(w)::bigint as n, array_to_string(list_sort(list_distinct(list(key)))[1:5], '|') as sample from r group by 1""")
def catalog_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, links = _frames(spark, sf_dir)
    images = items.select("image_path").distinct().where(F.substring("image_path", 5, 3).cast("int") < 90)
    return checks.check_frames(items, links, STORES, images).withColumn("sample", F.array_join("sample", "|"))


def short_batch(name: str) -> F.Column:
    """A batch's id as its SQL gives it, with three digits of the chunk."""
    return F.concat(F.substring_index(name, "#", 1), F.lit("#"), F.substring(F.substring_index(name, "#", -1), 1, 3)).alias(name)


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, links = _frames(spark, sf_dir)
    # ids are cut to six digits, so several parts and links can share one
    both = items.join(links.where("item_id like 'i%'").drop("k").dropDuplicates(["item_id", "store_id", "product_url", "price_vnd"]), "item_id").withColumn("pos", F.col("k")).withColumn("colors", F.lit("[]"))
    both = both.where("k % 100 < 40 or (k % 7 <> 0 and price_vnd >= 30000 and category <> 'hat' and k % 23 <> 0 and k % 29 <> 0 and k % 17 <> 0 and k % 41 <> 0)")
    return both.withColumn("sale_price_vnd", F.lit(None).cast("bigint")), both.groupBy("store_id").agg((F.count("*") * F.when(F.col("store_id") == "s3", 5).otherwise(2)).alias("raws"))


@query(f"""with {VIEWS}, j as (select c.* exclude (colors), '[]' as colors, l.store_id, l.product_url, l.price_vnd, null as sale_price_vnd from cat c join (select distinct item_id, store_id, product_url, price_vnd from link where item_id like 'i%') l using (item_id)
  where k % 100 < 40 or (k % 7 <> 0 and price_vnd >= 30000 and category <> 'hat' and k % 23 <> 0 and k % 29 <> 0 and k % 17 <> 0 and k % 41 <> 0)),
p as (select *, (row_number() over (partition by store_id order by k) - 1) // 20 as chunk from j), {_ROW_CODES.format(cat='p', link='p')},
codes as (select p.store_id, chunk, c.x[1] as code from p join (select distinct k, x from cat_codes where x is not null union all select distinct k, x from link_codes where x is not null) c using (k) where c.x[1] <> 'empty_description'
  union all select store_id, chunk, unnest(['duplicate_item_id', 'duplicate_item_store_link']) from (select store_id, chunk, item_id from p group by 1, 2, 3 having count(*) > 1)),
b as (select store_id, chunk, list_sort(list_distinct(list(code))) as cs from codes group by 1, 2),
g as (select store_id, chunk, count(*) as item_count, round_even(avg((gender = 'unisex')::int), 4) as unisex_share, sum(count(*)) over (partition by store_id) as total from p group by 1, 2)
select store_id || '#' || lpad(chunk::varchar, 3, '0') as batch_id, item_count, coalesce(array_to_string(cs, '|'), '') as blocking_codes, unisex_share, case when cs is not null or store_id = 's3' then 'quarantined' else 'passed' end as status from g left join b using (store_id, chunk)""")
def gated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, raws = _batches(spark, sf_dir)
    rows = checks.gate_batches(items, raws, STORES, chunk=20)
    return rows.select(short_batch("batch_id"), "item_count", F.array_join("blocking_codes", "|").alias("blocking_codes"), "unisex_share", "status")


@query("""with m as (select 's' || (k % 7) || '#' || case when k % 19 = 0 then 'ALL' else lpad((k % 12)::varchar, 3, '0') end as batch_id, case when k % 3 = 0 then 'passed' else 'quarantined' end as status from (select p_partkey as k from part where p_partkey % 5 = 0)),
f as (select split_part(batch_id, '#', 1) as store_id, split_part(batch_id, '#', 2) as c from m where status <> 'passed') select store_id, case when not bool_or(c = 'ALL') then array_to_string(list_sort(list_distinct(list(try_cast(c as int)))), '|') end as chunks from f where store_id in ('s0','s1','s2','s3','s4') group by 1""")
def failed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    chunk = F.when(k % 19 == 0, "ALL").otherwise(F.lpad((k % 12).cast("string"), 3, "0"))
    m = table(spark, sf_dir, "part").where(k % 5 == 0).select(F.concat(F.lit("s"), (k % 7).cast("string"), F.lit("#"), chunk).alias("batch_id"), F.when(k % 3 == 0, "passed").otherwise("quarantined").alias("status"))
    return checks.failed_targets(m, STORES).withColumn("chunks", F.array_join("chunks", "|"))


#: Calls and what is wrong with each.
CALLS = (
    ('{"name":"search_outfits","arguments":{"occasion":"office","style":"casual","price_max":500000,"exclude_colors":["đỏ"]}}', ""),
    ('{"name":"search_outfits","arguments":{"occasion":"gym"}}', "occasion must be one of: cafe_hangout, date, home_casual, interview, office, party, school, travel, wedding"),
    ('{"name":"other","arguments":{"style":"casual"}}', "tool name must be search_outfits; missing required arguments: occasion"),
    ('{"name":"search_outfits","arguments":{"occasion":"date","bad_key":1,"a":2},"z":0,"y":1}', "unsupported top-level keys: y, z; unsupported arguments: a, bad_key"),
    ('{"name":"search_outfits","arguments":[1]}', "arguments must be an object"),
    ('{"name":"search_outfits"}', "arguments must be an object"),
    ('{"name":"search_outfits","arguments":{"occasion":3,"price_max":-1}}', "occasion must be a string; price_max must be >= 0"),
    ('{"name":"search_outfits","arguments":{"occasion":"date","price_max":true}}', "price_max must be an integer"),
    ('{"name":"search_outfits","arguments":{"occasion":"date","price_max":1.5,"exclude_colors":"đỏ"}}', "price_max must be an integer; exclude_colors must be an array of strings"),
    ('{"name":"search_outfits","arguments":{"occasion":"date","exclude_colors":[1,"a"]}}', "exclude_colors must be an array of strings"),
    ('{"name":"search_outfits","arguments":{"occasion":"date","exclude_colors":[]}}', ""),
    ("{not json}", "invalid JSON"),
)
_CALLS = "calls as (select event_id, " + _list(c for c, _ in CALLS) + f"[event_id % {len(CALLS)} + 1] as json, " + _list(e for _, e in CALLS) + f"[event_id % {len(CALLS)} + 1] as errors from events)"


def _call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", pick(tuple(c for c, _ in CALLS), F.col("event_id") % len(CALLS)).alias("json"))


@query(f"with {_CALLS} select event_id, case when errors = '' then '' else 'tool_call[0] ' || replace(errors, '; ', '; tool_call[0] ') end || case when event_id % 4 = 0 then (case when errors = '' then '' else '; ' end) || 'tool_call[1] invalid JSON' else '' end as errors, 1 + (event_id % 4 = 0)::int as calls from calls")
def tool_call_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _call(spark, sf_dir)
    text = F.concat(F.lit("hi <tool_call> "), "json", F.lit("\n</tool_call> there"), F.when(F.col("event_id") % 4 == 0, "<tool_call>{x}</tool_call>").otherwise(""))
    rows = rows.withColumn("text", text)
    return rows.select("event_id", F.array_join(dg.text_call_errors(F.col("text")), "; ").alias("errors"), F.size(dg.call_texts(F.col("text"))).alias("calls"))


#: A call from a row's columns: n tells its occasion, style and price, written as a number or as text.
_BUILT = """'{{"name":"search_outfits","arguments":{{"occasion":"' || {o}[{n} % 9 + 1] || '"' || case when {n} % 3 > 0 then ',"style":"' || {s}[{n} % 4 + 1] || '"' else '' end || case when {n} % 4 > 0 then ',"price_max":' || case when {n} % 2 = 0 then '"' else '' end || ({n} % 5 * 100000) || case when {n} % 2 = 0 then '"' else '' end else '' end || '}}}}'"""
_PAIR = """(list_transform(list_filter(json_keys({j}), lambda k: k <> 'arguments' or json_type({j}, '$.arguments') <> 'OBJECT'), lambda k: k || '=' || json_extract_string({j}, '$."' || k || '"')) ||
  case when json_type({j}, '$.arguments') = 'OBJECT' then list_transform(json_keys({j}, '$.arguments'), lambda k: 'arguments.' || k || '=' || json_extract_string({j}, '$.arguments."' || k || '"')) else [] end)"""
_N = len(CALLS)


@query(f"""with r as (select event_id, case when event_id % 3 = 0 then {_list(c for c, _ in CALLS)}[event_id % {_N} + 1] else {_BUILT.format(n='(event_id // 2)', o=_list(OCCASIONS), s=_list(STYLES))} end as g, case when user_id % 4 = 0 then {_list(c for c, _ in CALLS)}[user_id % {_N} + 1] else {_BUILT.format(n='user_id', o=_list(OCCASIONS), s=_list(STYLES))} end as f from events),
v as (select *, json_valid(g) as gv, json_valid(f) as fv, case when json_valid(g) then g::json end as gj, case when json_valid(f) then f::json end as fj from r), p as (select *, {_PAIR.format(j='gj')} as gp, {_PAIR.format(j='fj')} as fp from v)
select event_id, round_even(case when not fv then null when not gv then 0.0 else 2.0 * len(list_intersect(list_distinct(gp), list_distinct(fp))) / (len(list_distinct(gp)) + len(list_distinct(fp))) end::double, 6) as f1, case when event_id % 5 = 0 then 1 when event_id % 3 = 0 then (event_id % {_N} in (0, 10))::int when json_type(gj, '$.arguments.price_max') is null then 1 else (json_type(gj, '$.arguments.price_max') <> 'VARCHAR')::int end as format_ok from p""")
def tool_call_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of generated calls with references, whole, partial and none; whether the generated call is valid where a reference calls."""

    def built(n) -> F.Column:
        mark = F.when(n % 2 == 0, '"').otherwise("")
        style = F.when(n % 3 > 0, F.concat(F.lit(',"style":"'), pick(STYLES[:4], n % 4), F.lit('"'))).otherwise("")
        price = F.when(n % 4 > 0, F.concat(F.lit(',"price_max":'), mark, (n % 5 * 100_000).cast("string"), mark)).otherwise("")
        return F.concat(F.lit('{"name":"search_outfits","arguments":{"occasion":"'), pick(OCCASIONS, n % 9), F.lit('"'), style, price, F.lit("}}"))

    calls = tuple(c for c, _ in CALLS)
    e, u = F.col("event_id"), F.col("user_id")
    g = F.when(e % 3 == 0, pick(calls, e % _N)).otherwise(built(F.floor(e / 2)))
    f = F.when(u % 4 == 0, pick(calls, u % _N)).otherwise(built(u))
    frame = lambda c: F.concat(F.lit("<tool_call>"), c, F.lit("</tool_call>"))
    rows = table(spark, sf_dir, "events").select("event_id", frame(g).alias("generated"), frame(f).alias("reference"))
    plain = F.when(F.col("event_id") % 5 == 0, "no call").otherwise(F.col("reference"))
    return rows.select("event_id", F.bround(dg.call_f1(F.col("generated"), F.col("reference")), 6).alias("f1"), dg.format_ok(F.col("generated"), plain).alias("format_ok"))


@query("""with t as (select event_id, 'see OF_' || lpad((event_id % 50)::varchar, 5, '0') || ', OF_12 and OF_abc' || user_id || 'x; size m, Cỡ 38 sizes L size XXXL' as s from events)
select event_id, array_to_string(list_filter(regexp_extract_all(s, '\\bOF_[0-9A-Za-z]{5,}\\b'), lambda x: x not in ('OF_00001', 'OF_00002', 'OF_00003')), '|') as bad_ids, 'M|38' as sizes, '38' as bad_sizes from t""")
def response_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see OF_"), F.lpad((F.col("event_id") % 50).cast("string"), 5, "0"), F.lit(", OF_12 and OF_abc"), F.col("user_id").cast("string"), F.lit("x; size m, Cỡ 38 sizes L size XXXL"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("s"))
    known = F.array(*[F.lit(f"OF_0000{k}") for k in (1, 2, 3)])
    sizes = dg.size_mentions(F.col("s"))
    return rows.select("event_id", F.array_join(dg.unknown(dg.outfit_ids(F.col("s")), known), "|").alias("bad_ids"), F.array_join(sizes, "|").alias("sizes"), F.array_join(dg.unknown(sizes, F.array(F.lit("M"), F.lit("L"))), "|").alias("bad_sizes"))


_JUDGED = """select event_id, case event_id % 6 when 0 then '' when 1 then 'missing_required_tool_call' when 2 then 'unexpected_tool_call|invalid_tool_call|invalid_tool_call_detail:tool_call[0] arguments must be an object' when 3 then 'assistant_empty' when 4 then 'invalid_message_shape' else 'missing_required_tool_call|invalid_multi_turn_shape' end as reasons from events"""


def _dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    good, bad = CALLS[0][0], CALLS[5][0]
    said = F.when(k == 0, f"<tool_call>{good}</tool_call>").when(k == 2, f"<tool_call>{bad}</tool_call>").when(k == 3, "  ").otherwise("text")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(turn("system", F.lit("s")), turn("user", F.lit("u")), turn("assistant", said))
    task = F.when(k <= 1, "tool_calling_grounded").when(k == 5, "multi_turn_grounded").otherwise("body_fit_grounded")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k == 4, F.slice(messages, 1, 2)).otherwise(messages).alias("messages"), task.alias("task"))
    return rows.select("event_id", dg.judge(F.col("messages"), F.col("task")).alias("reasons"))


@query(_JUDGED)
def judged_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dialogues(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"with j as ({_JUDGED}), r as (select unnest(string_split(reasons, '|')) as reason from j where reasons <> '') select reason, count(*) as n from r where reason not like 'invalid_tool_call_detail%' group by 1")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.rejection_counts(_dialogues(spark, sf_dir))


PREFIXES = ("Làm thế nào giặt ", "Tôi cần màu ", "Có thể ", "Những đôi giày ", "Điều gì ", "", "“ ủi да ", "bạn có thể da, ")
_EX = f"""{DIALOGUES}, ex as (select conv_id, {_list(PREFIXES)}[conv_id % {len(PREFIXES)} + 1] || prompt as prompt, answer, {_list(PREFIXES)}[conv_id % {len(PREFIXES)} + 1] || prompt || ' ' || answer as both_texts from d where prompt is not null and answer is not null)"""
_WORDS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 3 and x not in " + str(tuple(dg.STOP_WORDS)) + ")"
_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogues(spark, sf_dir).where("prompt is not null and answer is not null")
    return rows.withColumn("prompt", F.concat(pick(PREFIXES, F.col("conv_id") % len(PREFIXES)), "prompt"))


def _topic_sql() -> str:
    whens = [f"when regexp_matches(both_texts, '(?i){pattern.replace(chr(92) + 'b', '($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')}') then '{name}'" for name, pattern in dg.TOPICS]
    return "case " + " ".join(whens) + " else 'general_styling' end"


_FLAG = " or ".join("regexp_matches(both_texts, '" + re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", p) + "')" for p in dg.SCRIPTS.values())
_QUALITY = f"""q0 as (select *, len(string_split({_CLEAN.format('answer')}, ' ')) as nw, len(string_split({_CLEAN.format('prompt')}, ' ')) as pw, {_WORDS.format('answer')} as aw, list_distinct({_WORDS.format('prompt')}) as pt, regexp_extract({_CLEAN.format('answer')}, '^(.*?[.!?]) ', 1) as fs from ex),
q1 as (select *, list_distinct({_WORDS.format("(case when length(f) > 500 then rtrim(f[1:499]) || '…' else f end)")}) as sw from (select *, case when fs = '' then {_CLEAN.format('answer')} else fs end as f from q0)),
q as (select *, case when len(pt) = 0 or len(sw) = 0 then 0.0 else len(list_intersect(pt, sw))::double / len(list_distinct(list_concat(pt, sw))) end as echo, len(list_distinct(aw))::double / greatest(len(aw), 1) as div, ({_FLAG}) as mixed from q1)"""


@query(f"""with {_EX}, {_QUALITY} select conv_id, {_topic_sql()} as topic, case when regexp_matches(lower(prompt), '^(làm thế nào|cách)') then 'how_to' when regexp_matches(lower(prompt), '^tôi') then 'first_person' when regexp_matches(lower(prompt), '^(bạn có thể|có thể)') then 'request'
  when regexp_matches(lower(prompt), '^(điều gì|gì|những)') then 'definition' else 'other' end as style, case when nw <= 80 then 'short' when nw <= 180 then 'medium' else 'long' end as length_class,
  case when len({_WORDS.format('prompt')}) = 0 then lower(prompt) else array_to_string({_WORDS.format('prompt')}[1:3], ' ') end as family, nw as output_words, pw as prompt_words, round_even(echo, 6) as echo_overlap, round_even(div, 6) as lexical_diversity,
  concat_ws('|', case when mixed then 'mixed_script' end, case when nw > 280 then 'too_long' end, case when echo >= 0.65 then 'question_echo' end) as flags from q""")
def example_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt, answer = F.col("prompt"), F.col("answer")
    rows = _examples(spark, sf_dir).withColumn("q", dg.example_quality(prompt, answer))
    return rows.select(
        "conv_id", dg.topic(prompt, answer).alias("topic"), dg.prompt_style(prompt).alias("style"), dg.answer_length(answer).alias("length_class"), dg.family_key(prompt).alias("family"), F.col("q.output_words").cast("bigint").alias("output_words"), F.col("q.prompt_words").cast("bigint").alias("prompt_words"),
        F.bround("q.echo_overlap", 6).alias("echo_overlap"), F.bround("q.lexical_diversity", 6).alias("lexical_diversity"), F.array_join("q.flags", "|").alias("flags"),
    )


@query(f"""with {_EX}, {_QUALITY}, w as (select conv_id, unnest(pt) as t from q), df as (select t, count(*) as c from w group by 1), m as (select conv_id, avg(c) as mean_df from w join df using (t) group by 1), v as (select count(*) as n from df)
select conv_id, round_even(case when not mixed and nw <= 280 and echo < 0.65 then 4.0 else 0.0 end + least(div, 1.0) * 2.0 + case when nw between 45 and 190 then 1.5 else 0.0 end - greatest(0, nw - 220) / 60.0 - echo * 2.0 - coalesce(mean_df / greatest(v.n, 1) * 2.0, 0.0), 4) as score from q left join m using (conv_id), v""")
def example_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.quality_scores(_examples(spark, sf_dir)).withColumn("score", F.bround("score", 4))


@query(f"""with {_EX}, a as (select conv_id, t, count(*) as c from (select conv_id, unnest(regexp_extract_all(lower(prompt), '[\\p{{L}}\\p{{N}}_]+')) as t from ex) group by 1, 2), b as (select conv_id, t, count(*) as c from (select conv_id, unnest(regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]+')) as t from ex) group by 1, 2),
s as (select conv_id, sum(least(a.c, b.c)) as k from a join b using (conv_id, t) group by 1) select ex.conv_id, round_even(coalesce(2.0 * k / ((select sum(c) from a where a.conv_id = ex.conv_id) + (select sum(c) from b where b.conv_id = ex.conv_id)), 0.0)::double, 6) as similarity from ex left join s using (conv_id)""")
def text_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.text_similarities(_examples(spark, sf_dir), "conv_id", F.col("prompt"), F.col("answer"))
    return got.select("conv_id", F.bround("similarity", 6).alias("similarity"))


@query("select round_even(avg((event_type = case when user_id % 3 = 0 then 'view' else 'click' end)::int), 6) as accuracy from events")
def event_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("user_id") % 3 == 0, "view").otherwise("click")
    return metrics.fitb_accuracy(table(spark, sf_dir, "events").withColumn("guess", guess), "guess", "event_type")


@query("""with u as (select user_id, list(event_id order by ts, event_id) as found, list(event_id) filter (value > 90) as rel from events group by 1)
select user_id, case when rel is null then 0.0 else len(list_intersect(found[1:10], rel))::double / len(rel) end as recall from u""")
def user_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("e"), F.collect_list(F.when(F.col("value") > 90, F.col("event_id"))).alias("rel"))
    return by.select("user_id", metrics.recall_at_k(F.transform("e", lambda x: x["event_id"]), F.col("rel"), 10).alias("recall"))
