"""The registered queries of the library's own operators, each over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import expressions as ex
from weftline.functions.vocab import COMPLEMENTS
from weftline.operators import catalog as cat
from weftline.operators import corpus, graph, metrics, outfits
from weftline.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from weftline.sources.shared import written
from weftline.sources.tables import catalog, dialogues, links, table

_CATEGORIES = "['top','bottom','dress','outerwear','shoes','bag','accessory']"
_SIZES = "['XS','S','M','L','XL','XXL']"
CATALOG = f"""items as (select format('item_{{:06d}}', p_partkey) as item_id, {_CATEGORIES}[p_partkey % 7 + 1] as category,
  ['men','women','unisex','kid'][p_size % 4 + 1] as gender, ['athletic','casual','smart_casual','formal'][(p_partkey // 7) % 4 + 1] as formality,
  lower(split_part(p_name, ' ', 1)) as color, floor(p_retailprice)::bigint * 50 * (1 + p_partkey % 40) as price from part)"""
LINKS = f"""links as (select format('item_{{:06d}}', l_partkey) as item_id, format('store_{{:02d}}', l_suppkey % 20) as store_id,
  max(floor(l_extendedprice / l_quantity)::bigint * 100) as price, max((l_returnflag <> 'R')::int) = 1 as in_stock,
  list_sort(list(distinct {_SIZES}[l_linenumber % 6 + 1])) as sizes from lineitem group by 1, 2)"""
_PAIRS = ", ".join(f"('{a}','{b}')" for a, bs in COMPLEMENTS.items() for b in bs)
EDGES = f"""base as (select *, list_position(['athletic','casual','smart_casual','formal'], formality) - 1 as rnk from items),
comp as (select * from (values {_PAIRS}) v(a, b)),
cand as (select x.item_id as src, y.item_id as dst, x.category as sc, y.category as dc,
  round_even(least(greatest(0.4 * (1.0 - abs(x.rnk - y.rnk) / 3.0) + 0.35 * (case when x.color = y.color then 1.0 else 0.4 end)
    + 0.25 * (least(x.price, y.price)::double / greatest(x.price, y.price)::double), 0.0), 1.0)::decimal(18, 16), 6)::double as weight
  from base x join comp on x.category = comp.a join base y on y.category = comp.b and x.item_id <> y.item_id
  where (x.gender = y.gender or x.gender = 'unisex' or y.gender = 'unisex')
    and (x.category in ('bag','accessory') or y.category in ('bag','accessory') or abs(x.rnk - y.rnk) <= 1)),
topk as (select * from cand qualify row_number() over (partition by src, dc order by weight desc, dst) <= 15),
edges as (select least(src, dst) as src_id, greatest(src, dst) as dst_id, case when src < dst then sc else dc end as src_category,
  case when src < dst then dc else sc end as dst_category, max(weight) as weight from topk group by 1, 2, 3, 4)"""
DIALOGUES = """d as (select conv_id, arg_min(text, turn) filter (role = 'user' and text is not null) as prompt,
  arg_min(text, turn) filter (role = 'assistant' and text is not null) as answer, count(*) as turns from conversations group by 1)"""

@query(f"""with {CATALOG}, {LINKS}, {EDGES}, both_ways as (
  select src_id as item_id, src_category as c, dst_id as partner_id, dst_category as pc, weight from edges union all
  select dst_id, dst_category, src_id, src_category, weight from edges),
p as (select item_id, partner_id, weight from both_ways where c = 'top' and pc = 'bottom'
  qualify row_number() over (partition by item_id order by weight desc, partner_id) = 1),
offer as (select item_id, min(price) as offer_price from links where in_stock group by 1)
select p.item_id, p.partner_id, 'OF_' || substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(array_to_string(list_sort([p.item_id, p.partner_id]), '|'))), 1, 8) as outfit_id,
  p.weight, a.offer_price + b.offer_price as total_price,
  case when a.offer_price + b.offer_price < 300000 then 'budget' when a.offer_price + b.offer_price <= 800000 then 'mid' else 'premium' end as tier
from p join offer a on a.item_id = p.item_id join offer b on b.item_id = p.partner_id""")
def recommend_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: each top with its best bottom in stock, priced, with a stable id."""
    edges = graph.build_edges(catalog(spark, sf_dir), pairs=graph.complements(("top", "bottom")))
    best = graph.best_partners(edges, "top", "bottom")
    offer = links(spark, sf_dir).where("in_stock").groupBy("item_id").agg(F.min("price").alias("offer_price"))
    other = offer.select(F.col("item_id").alias("partner_id"), F.col("offer_price").alias("partner_price"))
    total = F.col("offer_price") + F.col("partner_price")
    out = best.join(offer, "item_id").join(other, "partner_id")
    return out.select("item_id", "partner_id", ex.stable_id(F.array("item_id", "partner_id")).alias("outfit_id"), "weight", total.alias("total_price"), ex.outfit_tier(total).alias("tier"))


@query(f"with {CATALOG}, {EDGES} select * from edges")
def item_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(catalog(spark, sf_dir))


@query(f"""with {CATALOG}, {EDGES}, ends as (select src_id as item_id from edges union all select dst_id from edges),
deg as (select i.item_id, count(e.item_id) as d from items i left join ends e using (item_id) group by 1)
select count(*) as nodes, (sum(d) / 2)::bigint as edges, min(d) as degree_min, floor(median(d))::bigint as degree_median, max(d) as degree_max from deg""")
def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = catalog(spark, sf_dir)
    return graph.graph_report(items, graph.build_edges(items))


@query(f"with {CATALOG}, {LINKS} select item_id, category, gender, formality, color, store_id, links.price, in_stock, array_to_string(sizes, ',') as sizes from items join links using (item_id) where in_stock")
def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.load_items(catalog(spark, sf_dir), links(spark, sf_dir)).withColumn("sizes", F.array_join("sizes", ","))


@query("""with old as (select c_custkey % 500 as k, c_custkey as v, 0 as g from customer), new as (select o_custkey % 700 as k, o_orderkey as v, 1 as g from orders)
select k, v from (select * from old union all select * from new) qualify row_number() over (partition by k order by g desc, v desc) = 1""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("k"), F.col("c_custkey").alias("v"))
    new = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 700).alias("k"), F.col("o_orderkey").alias("v"))
    return cat.keep_last(old, new, ["k"], [F.desc("v")])


@query(f"""with {CATALOG}, {LINKS}, twice as (select item_id, category from items union all select item_id, 'hat' from items where gender = 'kid'), r as (
  select 'duplicate_item_id' as code, 'error' as level, coalesce(sum(c - 1), 0)::bigint as n from (select count(*) c from twice group by item_id)
  union all select 'duplicate_item_store_link', 'error', coalesce(sum(c - 1), 0)::bigint from (select count(*) c from links group by item_id, store_id)
  union all select 'invalid_category', 'error', count(*) from twice where category = 'hat'
  union all select 'catalog_without_link', 'error', count(*) from twice where item_id not in (select item_id from links)
  union all select 'link_without_catalog', 'error', count(*) from links where item_id not in (select item_id from twice)
  union all select 'invalid_price', 'error', count(*) from links where price not between 30000 and 350000
  union all select 'out_of_stock', 'warning', count(*) from links where not in_stock)
select * from r where n > 0""")
def catalog_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = catalog(spark, sf_dir)
    doubled = items.unionByName(items.where("gender = 'kid'").withColumn("category", F.lit("hat")))
    return cat.quality_report(doubled, links(spark, sf_dir), 30_000, 350_000)


@query(f"""with {LINKS}, c as (select store_id, (row_number() over (partition by store_id order by item_id) - 1) // 50 as chunk, (price > 380000)::int as bad from links),
g as (select store_id, chunk, count(*) as n, sum(bad)::bigint as n_bad from c group by 1, 2)
select store_id, chunk, n, n_bad, case when n_bad > 0 or sum(n - n_bad) over (partition by store_id) / sum(n) over (partition by store_id) < 0.3 then 'quarantined' else 'passed' end as status from g""")
def batch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.gate(links(spark, sf_dir), "store_id", ["item_id"], F.col("price") > 380_000, 50)


@query(f"with {LINKS}, m as (select store_id, median(price) as median_price from links group by 1) select item_id, store_id, price, median_price from links join m using (store_id) where price < 0.6 * median_price")
def price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.price_outliers(links(spark, sf_dir), 0.6)


@query(f"""with {CATALOG}, p as (select *, row_number() over (partition by category order by price, item_id) - 1 as place, count(*) over (partition by category) as n from items)
select item_id, category, price from p where n <= 25 or list_contains([round_even(i * (n - 1) / 24.0, 0)::bigint for i in range(25)], place)""")
def representative_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.representative_slice(catalog(spark, sf_dir), "category", 25).select("item_id", "category", "price")


@query(f"""with {CATALOG} select category, case when price < 300000 then 'budget' when price <= 1000000 then 'mid' else 'premium' end as tier, count(*) as n,
  sum(price)::bigint as total, min(price) as low, max(price) as high from items group by 1, 2""")
def tier_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = catalog(spark, sf_dir).groupBy("category", ex.item_tier(F.col("price")).alias("tier"))
    return by.agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.min("price").alias("low"), F.max("price").alias("high"))


_BAND = "case when weight < {} then 0 when weight < {} then 1 when weight < {} then 2 when weight < {} then 3 when weight < {} then 4 else 5 end"


@query(f"""with {CATALOG}, {LINKS}, r as (select i.category, i.gender, l.item_id, l.store_id, l.sizes, 145 + l.price % 45 as height, 40 + l.price % 60 as weight from items i join links l using (item_id)),
w as (select *, least(greatest(case when gender = 'men' then {_BAND.format(50, 60, 68, 78, 90)} + (case when height >= 182 then 1 when height < 162 then -1 else 0 end)
  else {_BAND.format(43, 49, 56, 63, 72)} + (case when height >= 172 then 1 when height < 150 then -1 else 0 end) end, 0), 5) as want from r where category in ('top','dress','outerwear'))
select item_id, store_id, {_SIZES}[list_sort([(abs(list_position({_SIZES}, s) - 1 - want) * 10 + list_position({_SIZES}, s)) for s in sizes])[1] % 10] as size from w""")
def size_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = catalog(spark, sf_dir).select("item_id", "category", "gender").join(links(spark, sf_dir), "item_id")
    size = ex.suggested_size(F.col("category"), F.col("gender"), 145 + F.col("price") % 45, 40 + F.col("price") % 60, F.col("sizes"))
    return both.withColumn("size", size).where("size is not null").select("item_id", "store_id", "size")


@query("""select page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 600) as content from pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ex.strip_html(F.col("html")).alias("content"))


@query("select sha256(coalesce(text, '')) as digest, min(doc_id) as first_id, count(*) as copies from documents group by 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_duplicates(table(spark, sf_dir, "documents"))


_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""with {DIALOGUES}, t as (select conv_id, prompt, answer, list_distinct({_TOKENS.format('prompt')}) as a, list_distinct({_TOKENS.format("regexp_split_to_array(answer, '[.!?\\n]')[1]")}) as b,
  len(list_filter(regexp_split_to_array(answer, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as n_words from d where prompt is not null and answer is not null),
o as (select *, round_even(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b)))::double end, 6) as echo_overlap,
  regexp_matches(prompt || answer, '[一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿऀ-ॿ]') as mixed_script from t)
select conv_id, n_words, echo_overlap, mixed_script, n_words > 280 as too_long, echo_overlap >= 0.65 as question_echo from o""")
def dialogue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dialogue_flags(dialogues(spark, sf_dir))


@query(f"""with t as (select list_filter({_TOKENS.format('text')}, lambda x: length(x) >= 3) as c, text from documents),
f as (select case when len(c) >= 3 then array_to_string(c[1:3], ' ') else lower(text) end as family from t), g as (select family, count(*) as n from f group by 1)
select case when n = 1 then '1' when n = 2 then '2' when n <= 5 then '3-5' when n <= 10 then '6-10' when n <= 20 then '11-20' else '21+' end as bucket, count(*) as families, sum(n)::bigint as texts from g group by 1""")
def family_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.family_sizes(corpus.families(table(spark, sf_dir, "documents")))


@query(f"select token, count(*) as n_docs from (select unnest(list_distinct({_TOKENS.format('text')})) as token from conversations) group by 1")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_frequency(table(spark, sf_dir, "conversations"))


@query("""with p as (select doc_id, lang, row_number() over (partition by lang order by sha256('42:' || doc_id), doc_id) as r, count(*) over (partition by lang) as n from documents)
select doc_id, lang, r <= greatest(1, round_even(n * 0.1, 0)) as is_eval from p""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.last_event(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""with c as (select n_chars as s, count(*) as n, sum(quality) as pos from documents join labels using (doc_id) group by 1),
r as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 as rnk from c), t as (select sum(rnk * pos) as r, sum(pos) as p, sum(n) as n from r)
select round_even((r - p * (p + 1) / 2) / (p * (n - p)), 6) as auc from t""")
def quality_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.roc_auc(both, "n_chars", "quality")


@query("""with p as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as place, count(*) over (partition by event_type) as n from events)
select event_type, min(value) as p95 from p where place = round_even(0.95 * (n - 1), 0) group by 1""")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", 0.95, "p95")


@query("""with w as (select source, count(*) as n from documents group by 1), r as (select source, n * 1000 / sum(n) over () as raw from w),
f as (select source, floor(raw) as base, raw - floor(raw) as frac, 1000 - sum(floor(raw)) over () as left_over from r)
select source, (base + case when row_number() over (order by frac desc, source) <= left_over then 1 else 0 end)::bigint as quota from f""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return metrics.largest_remainder(by, "source", "n", 1000)


@query("""select event_type, count(*) as n, count(distinct user_id) as users, round_even(avg(value), 3) as mean_value, count_if(value > 50) as high,
  max((props->>'k')::bigint) as top_k from events group by 1""")
def backend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("event_type")
    return by.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.bround(F.avg("value"), 3).alias("mean_value"), F.count_if(F.col("value") > 50).alias("high"), F.max(F.get_json_object("props", "$.k").cast("bigint")).alias("top_k"))


@query("""select label, i as dim, round_even(avg(embedding[i]::double), 4) as mean from embeddings, range(1, 65) t(i) group by 1, 2""")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return each.groupBy("label", (F.col("p") + 1).cast("bigint").alias("dim")).agg(F.bround(F.avg(F.col("x").cast("double")), 4).alias("mean"))


def _grow(step: int, category: str) -> str:
    return f"""g{step} as materialized (select g.seed, g.base_place, list_concat(g.items, case when b.cand is null then [] else [b.cand] end) as items, g.total + coalesce(b.gain, 0) as total, g.added + (b.cand is not null)::int as added
  from g{step - 1} g left join (select seed, base_place, arg_min(cand, place) as cand, arg_min(gain, place) as gain from (
    select g.seed, g.base_place, r.partner_id as cand, r.place, count(*) as met, sum(l.micro)::bigint as gain, any_value(len(g.items)) as n
    from (select *, unnest(items) as member from g{step - 1} where added < 3) g join ranked r on r.item_id = g.seed and r.pc = '{category}' join ranked l on l.item_id = g.member and l.partner_id = r.partner_id
    group by 1, 2, 3, 4) where met = n group by 1, 2) b on b.seed = g.seed and b.base_place = g.base_place)"""


_OUTFITS = f"""both_ways as (select src_id as item_id, dst_id as partner_id, dst_category as pc, weight from edges union all select dst_id, src_id, src_category, weight from edges),
ranked as materialized (select *, round_even(weight * 1000000, 0)::bigint as micro, row_number() over (partition by item_id, pc order by weight desc, partner_id) as place from both_ways),
g0 as (select i.item_id as seed, r.place as base_place, [i.item_id, r.partner_id] as items, r.micro as total, 0 as added from items i join ranked r using (item_id) where i.category = 'top' and r.pc = 'bottom' and r.place <= 3
  union all select item_id, 1, [item_id], 0, 0 from items where category = 'dress'),
{", ".join(_grow(k, c) for k, c in enumerate(outfits.OPTIONAL, 1))},
scored as (select seed, base_place, items, case when len(items) < 2 then 0.0 else round_even(total / (len(items) * (len(items) - 1) / 2) / 1000000, 6) end as score from g4),
outfits as (select * from scored qualify row_number() over (partition by list_sort(items) order by score desc, seed, base_place) = 1),
records as (select 'OF_' || substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(array_to_string(list_sort(o.items), '|'))), 1, 8) as outfit_id, o.seed, array_to_string(o.items, ',') as item_ids, o.score,
  sum(i.price)::bigint as price_total, array_to_string(list_sort(list(distinct i.color)), ',') as colors from (select *, unnest(items) as m from outfits) o join items i on i.item_id = o.m group by o.items, o.seed, o.score)"""
_TIER = "case when price_total < 300000 then 'budget' when price_total <= 800000 then 'mid' else 'premium' end"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = catalog(spark, sf_dir)
    return outfits.records(outfits.assemble(items, written(graph.build_edges(items), "edges")), items)


@query(f"with {CATALOG}, {EDGES}, {_OUTFITS} select *, {_TIER} as tier from records")
def outfit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outfits grown from every top and dress, with their derived fields."""
    found = _records(spark, sf_dir)
    return found.select("outfit_id", "seed", F.array_join("items", ",").alias("item_ids"), "score", "price_total", F.array_join("colors", ",").alias("colors"), "tier")


@query(f"""with {CATALOG}, {EDGES}, {_OUTFITS} select outfit_id, item_ids, score, price_total,
  round_even(score + case when colors like '%blue%' then 0.05 else 0.0 end - case when {_TIER} <> 'mid' then 0.1 else 0.0 end, 6) as preference
from records where price_total <= 5000000 order by score desc, string_split(item_ids, ',') desc limit 40""")
def outfit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 outfits within a price, with their score for a preference."""
    best = outfits.search(_records(spark, sf_dir), 5_000_000, (), 40)
    liked = outfits.preference_score(F.col("score"), F.col("tier"), F.col("colors"), "mid", ("blue",))
    return best.select("outfit_id", F.array_join("items", ",").alias("item_ids"), "score", "price_total", F.bround(liked, 6).alias("preference"))
