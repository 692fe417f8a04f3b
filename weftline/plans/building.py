"""Queries of outfits that are built from the catalog: best and random combinations, records, choice under caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocab import BODY_SHAPES, SEASONS
from weftline.operators import diverse, generation
from weftline.plans.outfit_tags import _STYLE_WORDS, OUTFITS
from weftline.plans.queries import CATALOG
from weftline.plans.registry import query
from weftline.sources.shared import written
from weftline.sources.tables import catalog, pick


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog view with the fields of outfit items: two colors, a link, styles, body shapes and seasons by part key."""
    k = F.substring("item_id", 6, 12).cast("bigint")
    none = F.array().cast("array<string>")
    two = lambda words, step: F.array_distinct(F.array(pick(words, k % step), pick(words, F.floor(k / step) % step)))
    return catalog(spark, sf_dir).select(
        "item_id", "category", "gender", "formality", F.array("color", pick(("blue", "Green", "red"), k % 3)).alias("colors"), "price",
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("http://s/"), k.cast("string"))).alias("url"), F.array(pick(_STYLE_WORDS, k % 9)).alias("styles"),
        F.when(k % 6 == 0, none).otherwise(two(BODY_SHAPES, 5)).alias("body_shapes"), F.when(k % 7 == 2, none).otherwise(two(SEASONS, 4)).alias("seasons"),
    )


#: All combinations with what the score needs: brute force, the whole product of tops, bottoms and shoes that fit.
_FIT = "({0}.gender = {1}.gender or {0}.gender = 'unisex' or {1}.gender = 'unisex') and abs({0}.rnk - {1}.rnk) <= 1"
COMBOS = f"""q as (select *, list_position(['athletic','casual','smart_casual','formal'], formality) - 1 as rnk, (url <> '')::int as linked, [lower(c) for c in colors] as low from parts),
combos as (select [t.item_id, b.item_id, s.item_id] as ids, t.price + b.price + s.price as total, t.low || b.low || s.low as low, (t.linked + b.linked + s.linked) / 3.0::double as share,
    struct_pack(k := 0, t := t.gender, tr := t.rnk, b := b.gender, br := b.rnk, s := s.gender, sr := s.rnk) as cls
  from q t join q b on b.category = 'bottom' and {_FIT.format('t', 'b')} join q s on s.category = 'shoes' and {_FIT.format('t', 's')} and {_FIT.format('b', 's')} where t.category = 'top'
  union all select [d.item_id, s.item_id], d.price + s.price, d.low || s.low, (d.linked + s.linked) / 2.0::double, struct_pack(k := 1, t := d.gender, tr := d.rnk, b := '', br := 0, s := s.gender, sr := s.rnk)
  from q d join q s on s.category = 'shoes' and {_FIT.format('d', 's')} where d.category = 'dress'),
valued as (select *, greatest(0.0, least(1.0, round_even((0.35 + case when total between 300000 and 1800000 then 0.2 when total between 150000 and 3000000 then 0.1 else 0.0 end
  + least(0.15, (len(low) - len(list_distinct(low))) * 0.05) + 0.05 + 0.15 * share)::decimal(18, 15), 6)::double)) as score from combos)"""
BEST = 400


@query(f"with {CATALOG}, {OUTFITS}, {COMBOS} select array_to_string(ids, '|') as item_ids, score from (select ids, score from valued order by score desc, ids desc limit {BEST})")
def best_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generation.best_combinations(parts(spark, sf_dir), BEST)
    return found.select(F.array_join("item_ids", "|").alias("item_ids"), "score")


RANDOM = 300
_HEX = "('0x' || substr(md5('31|' || draw || '|{0}'), 1, 15))::hugeint"
_TAKEN = f"{_HEX} < {int(generation.OPTIONAL_CHANCE * (1 << 60))}"


def _more(k: int, category: str) -> str:
    """The step that adds an optional item."""
    gender = "len(list_distinct([x.gender for x in xs || [struct_pack(item_id := i.item_id, category := i.category, gender := i.gender, rnk := i.rnk)] if x.gender <> 'unisex'])) <= 1"
    ranks = "[x.rnk for x in xs || [struct_pack(item_id := i.item_id, category := i.category, gender := i.gender, rnk := i.rnk)] if x.category not in ('bag', 'accessory')]"
    at = "coalesce({1}, 0) = i.place".replace("{1}", f"case when {_TAKEN.format(category)} then 1 + {_HEX.format(category + '|item')} % (select count(*) from q where category = '{category}') end")
    return f"""more{k} as (select draw, case when i.item_id is not null and {gender} and list_max({ranks}) - list_min({ranks}) <= 1 then xs || [struct_pack(item_id := i.item_id, category := i.category, gender := i.gender, rnk := i.rnk)] else xs end as xs
  from {f'more{k - 1}' if k else 'based'} m left join (select item_id, category, gender, rnk, row_number() over (order by gender, rnk, item_id) as place from q where category = '{category}') i on {at})"""


@query(f"""with {CATALOG}, {OUTFITS}, {COMBOS}, numbered as materialized (select ids, row_number() over (order by cls.k, cls.t, cls.tr, cls.b, cls.br, cls.s, cls.sr, ids) - 1 as idx, count(*) over () as total from combos),
draws as (select draw, ({_HEX.format('high')} * 1152921504606846976 + {_HEX.format('low')}) % (select max(total) from numbered) as idx from range({4 * RANDOM}) t(draw)),
based as (select draw, list(struct_pack(item_id := q.item_id, category := q.category, gender := q.gender, rnk := q.rnk) order by ord) as xs
  from (select draw, unnest(ids) as id, generate_subscripts(ids, 1) as ord from draws join numbered using (idx)) u join q on q.item_id = u.id group by draw),
{', '.join(_more(k, c) for k, c in enumerate(generation.OPTIONAL))},
firsts as (select [x.item_id for x in xs] as ids, min(draw) as draw from more{len(generation.OPTIONAL) - 1} group by 1)
select draw, array_to_string(ids, '|') as item_ids from firsts order by draw limit {RANDOM}""")
def random_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generation.random_combinations(parts(spark, sf_dir), RANDOM)
    return found.select("draw", F.array_join("item_ids", "|").alias("item_ids"))


POOL_BEST, POOL_RANDOM = 400, 300
CHOSEN_BEST, CHOSEN_RANDOM = 21, 9
TARGETS = {"budget": 0.2, "mid": 0.5, "premium": 0.3}
STORES = 6
CAPS = diverse.Caps(max_item_reuse=4, target_gender_shares={"women": 0.55, "men": 0.45}, target_dress_share=0.12, max_dress_share=0.18, max_gender_shares={"women": 0.62, "men": 0.5}, target_store_shares={"s0": 0.4, "s1": 0.3, "s3": 0.2}, max_store_shares={"s0": 0.6, "s1": 0.25, "s2": 0.2})


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and random combinations as candidates of a choice; the store of an item goes by its key."""
    pool = generation.pooled(parts(spark, sf_dir), POOL_BEST, POOL_RANDOM)
    store = lambda i: F.concat(F.lit("s"), (F.substring(i, 6, 12).cast("bigint") % STORES).cast("string"))
    return pool.select("outfit_id", "gen_method", "price_tier", "gender", "score", "price_total", "item_ids", F.transform("item_ids", store).alias("store_ids"), F.array_contains("categories", "dress").alias("has_dress"))


@query()
def diverse_outfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outfits chosen under caps from real candidates."""
    got = diverse.select_diverse(written(candidates(spark, sf_dir), "candidates"), CHOSEN_BEST, CHOSEN_RANDOM, TARGETS, CAPS)
    return got.select("place", "chosen", "outfit_id", "gen_method", "price_tier", "gender", "score", "price_total", F.array_join("item_ids", "|").alias("item_ids"), F.array_join("stores", "|").alias("stores"), "has_dress")
