"""The recommendation flow from requests to sizes, over assembled outfits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocab import OCCASIONS, PRICE_TIERS, SIZES, STYLES
from weftline.operators import graph, recommend
from weftline.plans.building import parts
from weftline.plans.ingest import _list
from weftline.plans.outfit_tags import _BANDS, OUTFITS, RECORDS
from weftline.plans.queries import _BAND, _OUTFITS, CATALOG, EDGES
from weftline.plans.registry import query
from weftline.sources.shared import written
from weftline.sources.tables import catalog, pick, table

#: Every customer asks for something.
_ASKED = f"""requests as (select k as request_id, {_list(OCCASIONS)}[k % 9 + 1] as occasion, case k % 3 when 1 then 'men' when 2 then 'women' end as gender, case when k % 4 > 0 then (k % 20 + 1) * 1000000 end as price_max,
  case k % 5 when 1 then ['blue'] when 2 then ['red', 'green'] end as exclude_colors, case when k % 6 = 0 then {_list(STYLES)}[(k // 6) % 8 + 1] end as style, k % 3 > 0 as has_quiz, [{_list(STYLES)}[(k // 2) % 8 + 1], {_list(STYLES)}[(k // 5) % 8 + 1]] as q_styles,
  [{_list(OCCASIONS)}[(k // 3) % 9 + 1]] as q_occasions, case when k % 7 > 0 then ['Blu', 'ree'] else [] end as q_colors, case when k % 8 > 0 then {_list(PRICE_TIERS)}[k % 3 + 1] end as q_tier, 145 + k % 45 as height, 40 + k % 60 as weight from (select c_custkey as k from customer))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    quiz = F.struct(
        F.array(pick(STYLES, F.floor(k / 2) % 8), pick(STYLES, F.floor(k / 5) % 8)).alias("styles"), F.array(pick(OCCASIONS, F.floor(k / 3) % 9)).alias("occasions"),
        F.when(k % 7 > 0, F.array(F.lit("Blu"), F.lit("ree"))).otherwise(F.array().cast("array<string>")).alias("colors"), F.when(k % 8 > 0, pick(PRICE_TIERS, k % 3)).alias("tier"),
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"), pick(OCCASIONS, k % 9).alias("occasion"), F.when(k % 3 == 1, "men").when(k % 3 == 2, "women").alias("gender"), F.when(k % 4 > 0, (k % 20 + 1) * 1_000_000).alias("price_max"),
        F.when(k % 5 == 1, F.array(F.lit("blue"))).when(k % 5 == 2, F.array(F.lit("red"), F.lit("green"))).alias("exclude_colors"), F.when(k % 6 == 0, pick(STYLES, F.floor(k / 6) % 8)).alias("style"),
        F.when(k % 3 > 0, quiz).alias("quiz"), (145 + k % 45).alias("height"), (40 + k % 60).alias("weight"),
    )


_HEAD = _OUTFITS[: _OUTFITS.index(",\nscored as")]
_PARTS = OUTFITS[: OUTFITS.index(",\noutfits as")]
_TAIL = RECORDS[len(OUTFITS) :]
_WANT = f"""least(greatest(case when x.g = 'men' then {_BAND.format(50, 60, 68, 78, 90)} + (case when height >= 182 then 1 when height < 162 then -1 else 0 end) else {_BAND.format(43, 49, 56, 63, 72)} + (case when height >= 172 then 1 when height < 150 then -1 else 0 end) end, 0), 5)"""
_STOCK = f"[{_list(SIZES)}[k % 6 + 1], {_list(SIZES)}[(k // 6) % 6 + 1]]"
_NEAREST = f"{_list(SIZES)}[list_sort([(abs(list_position({_list(SIZES)}, s) - 1 - want) * 10 + list_position({_list(SIZES)}, s)) for s in stock])[1] % 10]"


@query(f"""with {CATALOG}, {EDGES}, {_HEAD}, {_PARTS}, {_BANDS}, {_ASKED},
grown as (select *, case when len(items) < 2 then 0.0::double else round_even(total / (len(items) * (len(items) - 1) / 2) / 1000000, 6) end as mean from g4),
outfits as (select row_number() over () as key, seed, mean, xs from (select seed, mean, base_place, list(struct_pack(id := p.item_id, c := category, g := gender, f := formality, cs := colors, p := price, u := url, st := styles, b := body, se := seasons, k := p.k) order by ord) as xs
  from (select seed, mean, base_place, unnest(items) as m, generate_subscripts(items, 1) as ord from grown) o join parts p on p.item_id = o.m group by 1, 2, 3)){_TAIL},
ready as (select r.*, r.outfit_id as oid, o.mean, o.seed, o.xs, i.formality as sf, i.gender as sg from scored r join outfits o using (key) join parts i on i.item_id = o.seed where i.k % 5 <> 0 and i.url <> ''),
hits as (select q.*, z.*, row_number() over (partition by request_id order by mean desc, ids desc) as retrieval_rank from requests q join bands b on b.occasion = q.occasion join ready z on z.sf = b.formality and (q.gender is null or z.sg = q.gender or z.sg = 'unisex')
  where (price_max is null or total <= price_max) and not coalesce(list_has_any([lower(c) for c in colors], exclude_colors), false) and (q.style is null or list_contains(styles, q.style))),
liked as (select *, case when has_quiz then mean + 0.1 * len([s for s in q_styles if list_contains(styles, s)]) + 0.1 * len([s for s in q_occasions if list_contains(occasions, s)]) + 0.05 * len([c for c in q_colors if len([y for y in colors if contains(lower(y), lower(c))]) > 0])
  - case when q_tier is not null and tier <> q_tier then 0.1 else 0.0 end end as preference from hits where retrieval_rank <= 40),
placed as (select *, row_number() over (partition by request_id order by round_even(preference::decimal(18, 12), 9) desc, retrieval_rank) as place from liked),
sized as (select request_id, string_agg(id || '=' || {_NEAREST}, '|' order by ord) as sizes from (select request_id, x.id, ord, {_WANT} as want, {_STOCK.replace('k ', 'x.k ').replace('(k', '(x.k')} as stock
  from (select request_id, height, weight, unnest(xs) as x, generate_subscripts(xs, 1) as ord from placed where place = 1) where x.c in ('top', 'dress', 'outerwear')) group by 1)
select request_id, place, retrieval_rank, oid as outfit_id, mean as score, round_even(preference::decimal(18, 12), 6)::double as preference, case when place = 1 then coalesce(sizes, '') end as sizes from placed left join sized using (request_id) where place <= 5""")
def recommended_outfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five outfits for every customer, with the sizes of the first."""
    edges = written(graph.build_edges(catalog(spark, sf_dir)), "edges")
    k = F.substring("item_id", 6, 12).cast("bigint")
    stock = F.array(pick(SIZES, k % 6), pick(SIZES, F.floor(k / 6) % 6))
    items = parts(spark, sf_dir).withColumn("in_stock", k % 5 != 0).withColumn("sizes_in_stock", F.when(k % 2 == 0, stock).otherwise(F.array().cast("array<string>"))).withColumn("available_sizes", stock)
    got = recommend.recommend(requests(spark, sf_dir), items, edges)
    sizes = F.array_join(F.transform("sizes", lambda s: F.concat(s["item_id"], F.lit("="), s["size"])), "|")
    return got.select("request_id", F.col("place").cast("bigint").alias("place"), F.col("retrieval_rank").cast("bigint").alias("retrieval_rank"), "outfit_id", "score", F.bround("preference", 6).alias("preference"), sizes.alias("sizes"))
