"""Queries of outfit fields, scores, requests and reports; outfits are runs of four items of the catalog view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocab import BODY_SHAPES, FORMALITIES, FORMALITY_OCCASIONS, FORMALITY_STYLES, SEASONS, STYLES
from weftline.operators import graph, recommend, tags
from weftline.plans.ingest import _in, _list
from weftline.plans.queries import CATALOG, EDGES
from weftline.plans.registry import query
from weftline.sources.shared import written
from weftline.sources.tables import catalog, dealt, item_id, pick

_STYLE_WORDS = (*STYLES, "classic")
OUTFITS = f"""parts as (select i.*, p.p_partkey as k, case when p_partkey % 13 = 0 then '' else 'http://s/' || p_partkey end as url, [color, ['blue','Green','red'][p_partkey % 3 + 1]] as colors, [{_list(_STYLE_WORDS)}[p_partkey % 9 + 1]] as styles,
  case when p_partkey % 6 = 0 then [] else list_distinct([{_list(BODY_SHAPES)}[p_partkey % 5 + 1], {_list(BODY_SHAPES)}[(p_partkey // 5) % 5 + 1]]) end as body, case when p_partkey % 7 = 2 then [] else list_distinct([{_list(SEASONS)}[p_partkey % 4 + 1], {_list(SEASONS)}[(p_partkey // 4) % 4 + 1]]) end as seasons
  from items i join part p on i.item_id = format('item_{{:06d}}', p.p_partkey)),
outfits as (select k // 4 as key, list(struct_pack(id := item_id, c := category, g := gender, f := formality, cs := colors, p := price, u := url, st := styles, b := body, se := seasons) order by k) as xs from parts group by 1)"""
_MAIN = "('top','bottom','dress','outerwear','shoes')"
_RANK = "list_position(['athletic','casual','smart_casual','formal'], {})"


def _sql_lists(table: dict, key: str) -> str:
    return "case " + " ".join(f"when {key} = '{k}' then {_list(v)}" for k, v in table.items()) + " end"


def _shared_sql(field: str, order) -> str:
    dress = f"flatten([x.{field} for x in xs if x.c = 'dress'])"
    main = f"[x.{field} for x in xs if x.c in ('top','bottom','dress','outerwear') and len(x.{field}) > 0]"
    every = f"[t for t in {_list(order)} if len({main}) > 0 and len(list_filter({main}, lambda s: not list_contains(s, t))) = 0]"
    return f"case when len({dress}) > 0 then [t for t in {_list(order)} if list_contains({dress}, t)] when len({every}) > 0 then {every} else [t for t in {_list(order)} if list_contains(flatten({main}), t)] end"


_GENDERS = "list_distinct([x.g for x in xs if x.g <> 'unisex'])"
_RANKS = f"[{_RANK.format('x.f')} for x in xs if x.c in {_MAIN}]"
_HAS = "(list_contains([x.c for x in xs], '{}'))"
_COLORS = "flatten([x.cs for x in xs])"
_LOW = f"[lower(c) for c in {_COLORS} if c <> '']"
RECORDS = f"""{OUTFITS}, records as (select key, 'OF_' || substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(array_to_string(list_sort([x.id for x in xs]), '|'))), 1, 8) as outfit_id, [x.id for x in xs] as ids, [x.c for x in xs] as cats,
  case len({_GENDERS}) when 0 then 'unisex' when 1 then {_GENDERS}[1] end as gender, coalesce(list_sort({_sql_lists(FORMALITY_OCCASIONS, f"{_list(FORMALITIES)}[list_max({_RANKS})]")}), []) as occasions,
  list_sort(list_distinct(list_filter(list_concat(flatten([{_sql_lists(FORMALITY_STYLES, 'x.f')} for x in xs]), flatten([x.st for x in xs])), lambda s: s in {_in(STYLES)}))) as styles, {_shared_sql('b', BODY_SHAPES)} as shapes, {_shared_sql('se', SEASONS)} as seasons,
  list_sort(list_distinct({_COLORS})) as colors, list_sum([x.p for x in xs])::bigint as total, len([x for x in xs if x.u = '']) = 0 as has_store, coalesce(list_max({_RANKS}) - list_min({_RANKS}) <= 1, true) as coherent,
  {_HAS.format('shoes')} and ({_HAS.format('dress')} or ({_HAS.format('top')} and {_HAS.format('bottom')})) as core, len({_LOW}) - len(list_distinct({_LOW})) as rep, len([x for x in xs if x.u <> '']) as linked, len(xs) as n,
  len(list_distinct([x.c for x in xs if x.c in ('outerwear','bag','accessory')])) as optional from outfits),
scored as (select *, greatest(0.0, least(1.0, round_even((case when core then 0.35 else 0.05 end + case when total between 300000 and 1800000 then 0.2 when total between 150000 and 3000000 then 0.1 else 0.0 end + least(0.15, rep * 0.05) + 0.05
  + 0.15 * (linked::double / n) + least(0.1, optional * 0.04))::decimal(18, 15), 6)::double)) as score, case when total < 300000 then 'budget' when total <= 800000 then 'mid' else 'premium' end as tier from records)"""


def _outfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = catalog(spark, sf_dir).withColumn("k", F.substring("item_id", 6, 12).cast("bigint"))
    k = F.col("k")
    two = lambda words, step: F.array_distinct(F.array(pick(words, k % step), pick(words, F.floor(k / step) % step)))
    none = F.array().cast("array<string>")
    item = F.struct(
        "item_id", "category", "gender", "formality", F.array("color", pick(("blue", "Green", "red"), k % 3)).alias("colors"), "price",
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("http://s/"), k.cast("string"))).alias("url"), F.array(pick(_STYLE_WORDS, k % 9)).alias("styles"),
        F.when(k % 6 == 0, none).otherwise(two(BODY_SHAPES, 5)).alias("body_shapes"), F.when(k % 7 == 2, none).otherwise(two(SEASONS, 4)).alias("seasons"),
    )
    # whole groups in many tasks: the wide rows of one are collected in memory
    return dealt(items.withColumn("key", F.floor(k / 4)), "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", item.alias("x")))).alias("xs")).select("key", F.transform("xs", lambda x: x["x"]).alias("items"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.col("items")
    return _outfits(spark, sf_dir).select("key", *tags.outfit_record(items, tags.outfit_score(items)), tags.is_coherent(items).alias("coherent"), tags.is_valid_combo(items).alias("valid"))


_J = "array_to_string({0}, '|') as {1}"


@query(f"with {CATALOG}, {RECORDS} select key, outfit_id, {_J.format('ids', 'item_ids')}, gender, {_J.format('occasions', 'occasions')}, {_J.format('styles', 'styles')}, {_J.format('shapes', 'body_shapes')}, {_J.format('seasons', 'seasons')}, {_J.format('colors', 'colors')}, total as price_total, tier as price_tier, has_store, coherent, coherent and gender is not null as valid, score from scored")
def derived_outfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    lists = ("item_ids", "occasions", "styles", "body_shapes", "seasons", "colors")
    return rows.select("key", "outfit_id", *[F.array_join(c, "|").alias(c) for c in lists], "gender", "price_total", "price_tier", "has_store", "coherent", "valid", "score")


@query(f"""with {CATALOG}, {RECORDS} select key, case when {_HAS.format('top')} and {_HAS.format('bottom')} and not {_HAS.format('dress')} then 'top+bottom' || case when {_HAS.format('shoes')} then '+shoes' else '' end
  when {_HAS.format('dress')} and not {_HAS.format('top')} and not {_HAS.format('bottom')} then 'dress' || case when {_HAS.format('shoes')} then '+shoes' else '' end else 'invalid' end as shape,
  len([s for s in flatten([x.st for x in xs]) if s in {_in(STYLES)}]) as known_styles, len([s for s in flatten([x.st for x in xs]) if s not in {_in(STYLES)}]) as unknown_styles,
  round_even(case when len(b1) = 0 and len(b2) = 0 then 1.0 else len(list_intersect(b1, b2))::double / len(list_distinct(list_concat(b1, b2))) end, 3) as likeness from (select *, xs[1].b as b1, xs[2].b as b2 from outfits where len(xs) > 1)""")
def outfit_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outfits(spark, sf_dir).where("size(items) > 1")
    styles = tags.split_by_domain(F.flatten(F.transform("items", lambda x: x["styles"])), STYLES)
    at = lambda i: F.element_at("items", i)["body_shapes"]
    return rows.select("key", tags.core_shape(F.transform("items", lambda x: x["category"])).alias("shape"), F.size(styles["valid"]).cast("bigint").alias("known_styles"), F.size(styles["invalid"]).cast("bigint").alias("unknown_styles"), tags.jaccard(at(1), at(2)).alias("likeness"))


_REQUESTS = "requests as (select * from (values (1, 'office', null, 900000::bigint, null, null), (2, 'wedding', 'women', null, ['blue'], null), (3, 'travel', 'men', 4000000, null, 'sporty'), (4, 'party', null, null, ['red', 'green'], 'elegant')) v(request_id, occasion, gender, price_max, exclude_colors, style))"


def _requests(spark: SparkSession) -> DataFrame:
    rows = [(1, "office", None, 900_000, None, None), (2, "wedding", "women", None, ["blue"], None), (3, "travel", "men", 4_000_000, None, "sporty"), (4, "party", None, None, ["red", "green"], "elegant")]
    return spark.createDataFrame(rows, "request_id int, occasion string, gender string, price_max bigint, exclude_colors array<string>, style string")


_BANDS = "bands as (select * from (values " + ", ".join(f"('{f}', '{o}')" for f, os in FORMALITY_OCCASIONS.items() for o in os) + ") v(formality, occasion))"


@query(f"""with {CATALOG}, {OUTFITS}, {_REQUESTS}, {_BANDS} select request_id, item_id from parts i join bands b using (formality) join requests r using (occasion)
where category in ('top', 'dress') and k % 5 <> 0 and url <> '' and (r.gender is null or i.gender = r.gender or i.gender = 'unisex')""")
def request_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("item_id", 6, 12).cast("bigint")
    items = catalog(spark, sf_dir).withColumn("in_stock", k % 5 != 0).withColumn("url", F.when(k % 13 == 0, "").otherwise("u"))
    return recommend.seeds(_requests(spark), items)


@query(f"""with {CATALOG}, {RECORDS}, {_REQUESTS}, found as (select *, row_number() over (partition by request_id order by score desc, ids desc) as retrieval_rank from scored s join requests r on true
  where list_contains(s.occasions, r.occasion) and (price_max is null or total <= price_max) and not coalesce(list_has_any([lower(c) for c in colors], exclude_colors), false) and (r.style is null or list_contains(styles, r.style))),
p as (select *, score + case when list_contains(styles, 'casual') then 0.1 else 0.0 end + case when list_contains(occasions, 'date') then 0.1 else 0.0 end + case when len([c for c in colors if contains(lower(c), 'blu')]) > 0 then 0.05 else 0.0 end - case when tier <> 'mid' then 0.1 else 0.0 end as pr from found where retrieval_rank <= 40)
select request_id, outfit_id, retrieval_rank, place, round_even(pr::decimal(18, 12), 6)::double as preference from (select *, row_number() over (partition by request_id order by pr desc, retrieval_rank) as place from p) where place <= 5""")
def recommend_outfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several requests at once: search, then rerank for a taste."""
    requests = _requests(spark)
    rows = _records(spark, sf_dir)
    wanted = requests.select("request_id", "occasion")
    found = recommend.search(rows.join(F.broadcast(wanted), F.array_contains("occasions", F.col("occasion"))), requests)
    liked = tags.preference({c: F.col(c) for c in ("score", "styles", "occasions", "colors", "price_tier")}, ("casual",), ("date",), ("Blu",), "mid")
    return recommend.rerank(found, liked).select("request_id", "outfit_id", "retrieval_rank", "place", F.bround("preference", 6).alias("preference"))


@query(f"""with {CATALOG}, {RECORDS}, frame as (select * from scored union all select * from scored where key % 10 = 0), slots as (select f.key, unnest(xs) as x, rn from (select *, row_number() over () as rn from frame) f join outfits using (key)),
u as (select x.id as id, count(*) as n from slots group by 1), p as (select n, row_number() over (order by n) - 1 as place, count(*) over () as c from u),
t as (select count(*) as total, count_if(tier = 'budget') as tier_budget, count_if(tier = 'mid') as tier_mid, count_if(tier = 'premium') as tier_premium, count(distinct ids) as unique_combos, count_if(not core) as invalid_rule, count_if(list_contains(cats, 'dress')) as dress_outfits,
  min(score) as score_min, max(score) as score_max, round_even(avg(score::decimal(18, 6))::decimal(28, 12), 6)::double as score_mean, count_if(gender is null) as mixed_gender, count_if(not coherent) as formality_clash from frame)
select t.*, (select count(*) from u) as distinct_items, (select max(n) from u) as reuse_max, (select min(n) from p where place = round_even(0.95 * (c - 1), 0)) as reuse_p95, round_even(dress_outfits / total, 4) as dress_share,
  round_even(greatest(abs(tier_budget / total - 0.25), abs(tier_mid / total - 0.5), abs(tier_premium / total - 0.25)), 4) as max_tier_deviation from t""")
def outfit_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    rows = rows.unionByName(rows.where("key % 10 = 0"))
    return recommend.evaluate_outfits(rows, catalog(spark, sf_dir), {"budget": 1.0, "mid": 2.0, "premium": 1.0})


@query(f"""with {CATALOG}, {RECORDS}, r as (select 'price_tier' as kind, tier as value from scored union all select 'gen_method', case when key % 3 = 0 then 'random' else 'beam' end from scored union all select 'gender', gender from scored
  union all select 'store', 's' || (x.p % 5) from (select unnest(xs) as x from outfits) where x.p % 5 <> 0)
select kind, value, count(*) as n, round_even(count(*) / sum(count(*)) over (partition by kind), 4) as share from r group by 1, 2""")
def outfit_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("gen_method", F.when(F.col("key") % 3 == 0, "random").otherwise("beam"))
    stores = catalog(spark, sf_dir).withColumn("store_id", F.when(F.col("price") % 5 != 0, F.concat(F.lit("s"), (F.col("price") % 5).cast("string"))))
    return recommend.outfit_counts(rows, stores)


@query(f"""with {CATALOG}, {EDGES}, bad as (select least(src_id, moved) as src_id, greatest(src_id, moved) as dst_id from (select src_id, format('item_{{:06d}}', substr(dst_id, 6)::bigint + 1) as moved from edges) where src_id <> moved)
select src_id, dst_id, count(*) as n from bad join base x on x.item_id = bad.src_id join base y on y.item_id = bad.dst_id where not ((x.category, y.category) in (select (a, b) from comp) and (x.gender = y.gender or x.gender = 'unisex' or y.gender = 'unisex')
  and (x.category in ('bag','accessory') or y.category in ('bag','accessory') or abs(x.rnk - y.rnk) <= 1)) group by 1, 2""")
def edge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose end was moved to the next item, most of which break a rule."""
    items = catalog(spark, sf_dir)
    moved = item_id(F.substring("dst_id", 6, 12).cast("bigint") + 1)
    rows = graph.build_edges(items).withColumn("moved", moved).where("src_id <> moved")
    rows = rows.select(F.least("src_id", "moved").alias("src_id"), F.greatest("src_id", "moved").alias("dst_id"))
    return graph.coherence_violations(items, rows).groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))


@query(f"""with {CATALOG}, {EDGES}, both_ways as (select src_id as a, dst_id as b, dst_category as c, weight from edges union all select dst_id, src_id, src_category, weight from edges),
ctx as (select i.item_id as key, unnest([i.item_id, p.b]) as m from items i join (select a, b from both_ways where c = 'bottom' qualify row_number() over (partition by a order by weight desc, b) = 1) p on p.a = i.item_id where i.category = 'top'),
met as (select key, b, count(*) as met, sum(round_even(weight * 1000000, 0)::bigint) as total from ctx join both_ways on a = m and c = 'shoes' group by 1, 2)
select key, place, b as partner_id from (select *, row_number() over (partition by key order by total desc, b) as place from met where met = 2) where place <= 5""")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shoes that complete each top with its best bottom."""
    edges = written(graph.build_edges(catalog(spark, sf_dir)), "edges")
    pairs = graph.best_partners(edges, "top", "bottom").select(F.col("item_id").alias("key"), F.array("item_id", "partner_id").alias("items"))
    return graph.rank_completions(pairs, edges, "shoes", 5)
