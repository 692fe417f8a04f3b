"""Queries of embeddings, evaluation by task, experiments and benchmark samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.vocab import BODY_SHAPES, SEASONS
from weftline.operators import embedding, evaluate
from weftline.plans.building import parts
from weftline.plans.outfit_tags import OUTFITS, _outfits, _shared_sql
from weftline.plans.queries import CATALOG
from weftline.plans.registry import query
from weftline.sources.shared import written
from weftline.sources.tables import catalog, table


@query("""with w as (select p_partkey, unnest(regexp_split_to_array(trim(lower('item_' || p_partkey || '|' || p_type || '|' || p_name || '|' || p_name || '|' || p_brand)), '\\s+')) as t from part), h as (select p_partkey, md5(t) as h from w),
x as (select p_partkey, ('0x' || h[1:8])::bigint % 128 as dim, sum(case when ('0x' || h[9:10])::bigint % 2 = 0 then 1.0::double else -1.0::double end) as x from h group by 1, 2)
select p_partkey, dim::int as dim, round_even(x / sqrt(sum(x * x) over (partition by p_partkey)), 9) as value from x where x <> 0""")
def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    text = embedding.item_text(F.concat(F.lit("item_"), F.col("p_partkey").cast("string")), F.col("p_type"), F.col("p_name"), F.col("p_name"), F.array("p_brand"))
    each = embedding.hashed_vectors(rows, "p_partkey", text).select("p_partkey", F.posexplode("vector").alias("dim", "x"))
    return each.where("x <> 0").select("p_partkey", "dim", F.bround("x", 9).alias("value"))


_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""with p as (select doc_id, text as a, lead(text) over (order by doc_id) as b, case when doc_id % 5 = 0 then ' ' else lang end as task from documents), s as (select doc_id, unnest({_TOKENS.format('a')}) as t, 1 as x, 0 as y from p union all select doc_id, unnest({_TOKENS.format('b')}), 0, 1 from p),
c as (select doc_id, t, sum(x) as x, sum(y) as y from s group by 1, 2), m as (select doc_id, 2.0::double * sum(least(x, y)) / sum(x + y) as similarity from c group by 1), r as (select case when trim(coalesce(task, '')) = '' then 'unknown' else task end as task_type, coalesce(similarity, 0.0) as similarity, case when doc_id % 3 > 0 then doc_id % 7 / 7.0::double end as f1 from p left join m using (doc_id))
select task_type, count(*) as count, round_even(coalesce(avg(f1), 0.0), 4) as mean_tool_call_f1, round_even(avg(similarity), 4) as mean_text_similarity from r group by rollup(task_type)""")
def evaluated_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an answer, the next one as its reference, by language; a third has no call."""
    numbered = evaluate_pairs(table(spark, sf_dir, "documents"))
    rows = evaluate.with_similarity(numbered, F.col("text"), F.col("reference"), "text_similarity")
    rows = rows.withColumn("tool_call_f1", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7 / 7.0))
    return evaluate.summarize_scores(rows, scores=("tool_call_f1", "text_similarity"))


def evaluate_pairs(docs: DataFrame) -> DataFrame:
    """Documents with the text of the next one (by id) as reference: dealt out by ranges of ids, the last of a range with the first of the next range."""
    dealt = written(docs.select("doc_id", "text", "lang").repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id()), "ranges")
    # one row a range; a struct, as a text may be null
    heads = dealt.groupBy("_part").agg(F.min_by(F.struct("text"), "doc_id").alias("head"))
    after = heads.select("_part", F.lead("head").over(W.orderBy("_part")).alias("_after"))
    following = F.lead(F.struct("text")).over(W.partitionBy("_part").orderBy("doc_id"))
    rows = dealt.withColumn("_next", following).join(F.broadcast(after), "_part")
    return rows.select("doc_id", "text", F.coalesce("_next", "_after")["text"].alias("reference"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("lang")).alias("task_type"))


_RUNS = """runs as (select event_type as experiment, case when user_id % 4 > 0 then 'a' || (user_id % 4) end as ablation, 'm' || (event_id % 3) as metric, (value::decimal(18, 4))::varchar as value, case when event_id % 6 = 0 then 'soon' when event_id % 11 > 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') end as timestamp, case when event_id % 6 = 0 or event_id % 11 = 0 then timestamp '0001-01-01' else date_trunc('second', ts) end as moment from events),
last as (select experiment, coalesce(ablation, 'unknown') as ablation, metric, value from runs qualify row_number() over (partition by experiment, ablation, metric order by moment desc, value desc, timestamp desc nulls last) = 1)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    stamp = F.when(e % 6 == 0, "soon").when(e % 11 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("experiment"), F.when(u % 4 > 0, F.concat(F.lit("a"), (u % 4).cast("string"))).alias("ablation"), F.concat(F.lit("m"), (e % 3).cast("string")).alias("metric"), F.col("value").cast("decimal(18,4)").cast("string").alias("value"), stamp.alias("timestamp"))


@query(f"with {_RUNS} select experiment, ablation, max(value) filter (metric = 'm0') as m0, max(value) filter (metric = 'm1') as m1, max(value) filter (metric = 'm2') as m2 from last group by 1, 2")
def experiment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics_table(_runs(spark, sf_dir), ["m0", "m1", "m2"])


_LOG = """log as (select event_type as category, event_id % 7 > 0 as ok, (event_id % 11) / 13.7::double as body_jaccard, case when event_id % 5 > 0 then (event_id % 9) / 8.0::double end as season_jaccard, case when event_id % 13 > 0 then (round(value::double * 10, 0) / 10.0)::double end as latency_s from events),
l as (select *, coalesce(latency_s, 0.0) as latency from log), o as (select category, list(latency order by latency) as xs from l group by rollup(category))"""


@query(f"""with {_LOG}, b as (select category, count(*) as n, round_even(avg(ok::int), 3) as complete_rate, round_even(avg(coalesce(body_jaccard, 0)), 3) as body_jaccard, round_even(avg(coalesce(season_jaccard, 0)), 3) as season_jaccard, round_even(avg(latency), 3) as latency_mean from l group by rollup(category))
select b.*, round_even((xs[(n - 1) // 2 + 1] + xs[n // 2 + 1]) / 2, 3) as latency_median, round_even(xs[floor((n - 1) * 0.95::double)::bigint + 1], 3) as latency_p95 from b join o on b.category is not distinct from o.category""")
def tagging_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (e % 7 > 0).alias("ok"), (e % 11 / 13.7).alias("body_jaccard"), F.when(e % 5 > 0, e % 9 / 8.0).alias("season_jaccard"), F.when(e % 13 > 0, F.round(F.col("value").cast("double") * 10, 0) / 10.0).alias("latency_s"))
    return evaluate.summarize_items(rows)


RELEVANT = ("top", "bottom", "dress", "outerwear", "shoes")
_MOVED = "case when k % 5 = 0 then ['{1}'] else {0} end"


@query(f"""with {CATALOG}, {OUTFITS}, slots as (select key, unnest(xs) as x, generate_subscripts(xs, 1) as ord from outfits), s as (select key, ord, x, substr(x.id, 6)::bigint as k from slots),
good as (select key from s group by 1 having count_if(x.c in {RELEVANT} and k % 9 = 0) = 0),
p as (select key, list(struct_pack(c := x.c, b := case when k % 9 > 0 then {_MOVED.format('x.b', BODY_SHAPES[2])} else [] end, se := case when k % 9 > 0 then {_MOVED.format('x.se', SEASONS[1])} else [] end) order by ord) as xs from s where key in (select key from good) group by 1),
r as (select key, list(struct_pack(c := x.c, b := x.b, se := x.se) order by ord) as xs from s where key in (select key from good) group by 1),
d as (select key, {_shared_sql('b', BODY_SHAPES)} as body, {_shared_sql('se', SEASONS)} as season from p), d2 as (select key, {_shared_sql('b', BODY_SHAPES)} as body2, {_shared_sql('se', SEASONS)} as season2 from r)
select 'o' || key as outfit_id, array_to_string(body, '|') as body_shapes, array_to_string(season, '|') as seasons, len(body) > 0 and len(season) > 0 as complete,
  round_even(case when len(body) = 0 and len(body2) = 0 then 1.0 else len(list_intersect(body, body2))::double / len(list_distinct(list_concat(body, body2))) end, 3) as body_jaccard,
  round_even(case when len(season) = 0 and len(season2) = 0 then 1.0 else len(list_intersect(season, season2))::double / len(list_distinct(list_concat(season, season2))) end, 3) as season_jaccard from d join d2 using (key)""")
def derived_tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of outfits all of whose items that count were predicted, against those of the catalog; a ninth of the items was not."""
    items = parts(spark, sf_dir)
    k = F.substring("item_id", 6, 12).cast("bigint")
    moved = lambda c, more: F.when(k % 5 == 0, F.array(F.lit(more))).otherwise(F.col(c)).alias(c)
    predicted = items.where(k % 9 > 0).select("item_id", moved("body_shapes", BODY_SHAPES[2]), moved("seasons", SEASONS[1]))
    rows = _outfits(spark, sf_dir).select(F.concat(F.lit("o"), F.col("key").cast("string")).alias("outfit_id"), F.transform("items", lambda x: x["item_id"]).alias("item_ids"))
    got = evaluate.summarize_outfits(rows, items, predicted, items, RELEVANT)
    return got.withColumns({c: F.array_join(c, "|") for c in ("body_shapes", "seasons")})


SAMPLE_ITEMS, SAMPLE_OUTFITS = 120, 12


@query(f"""with {CATALOG}, outfits as (select 'o' || (k // 4) as outfit_id, list(item_id order by k) as ids from (select *, substr(item_id, 6)::bigint as k from items) group by k // 4), drawn as (select *, sha256('42:' || outfit_id) as h from outfits order by h, outfit_id limit {SAMPLE_OUTFITS}),
slots as (select h, outfit_id, unnest(ids) as item_id, generate_subscripts(ids, 1) as ord from drawn), needed as (select item_id, row_number() over (order by h, outfit_id, ord) as place, 'outfit' as why from slots),
rest as (select *, row_number() over (partition by category order by sha256('42:' || item_id), item_id) as turn from items where substr(item_id, 6)::bigint % 3 > 0 and item_id not in (select item_id from needed)),
fill as (select item_id, (select count(*) from needed) + row_number() over (order by turn, category) as place, 'fill' as why from rest order by turn, category limit {SAMPLE_ITEMS} - (select count(*) from needed))
select item_id, place::int as place, why from needed union all select item_id, place::int, why from fill""")
def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("item_id", 6, 12).cast("bigint")
    items = catalog(spark, sf_dir).select("item_id", "category", (k % 3 > 0).alias("tagged"))
    rows = _outfits(spark, sf_dir).select(F.concat(F.lit("o"), F.col("key").cast("string")).alias("outfit_id"), F.transform("items", lambda x: x["item_id"]).alias("item_ids"))
    return evaluate.benchmark_sample(rows, items, SAMPLE_ITEMS, SAMPLE_OUTFITS)
