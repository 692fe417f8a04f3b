"""Queries of the audits of outfit tags; outfits are runs of four items whose tags some rows have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocab import BODY_SHAPES, FORMALITIES, FORMALITY_OCCASIONS, OCCASIONS, SEASONS, STYLES
from weftline.operators import outfit_audit, tags
from weftline.plans.ingest import _in, _list
from weftline.plans.outfit_tags import _HAS, RECORDS, _outfits, _sql_lists
from weftline.plans.queries import CATALOG
from weftline.plans.registry import query

_MAIN = "('top','bottom','dress','outerwear')"
_TOP = f"{_list(FORMALITIES)}[list_max([list_position({_list(FORMALITIES)}, x.f) for x in xs if x.c in ('top','bottom','dress','outerwear','shoes')])]"


def _union(field: str) -> str:
    return f"list_sort(list_distinct(flatten([x.{field} for x in xs if x.c in {_MAIN}])))"


#: Outfits whose tags were derived, then changed by key: more occasions, unknown styles, more shapes, other genders and tiers.
_VIEW = f"""{RECORDS}, o as (select 'o' || s.key as outfit_id, case when key % 17 = 0 then '3.0' else '3.1' end as ver, xs, cats, score, occasions || case when key % 4 = 0 then {_list(OCCASIONS[:4])} else [] end as oc, styles || case when key % 5 = 0 then ['goth', 'punk'] else [] end as st,
  shapes || case when key % 6 = 0 then ['apple', 'round'] else [] end as bo, s.seasons || case when key % 7 = 0 then ['winter'] else [] end as se, case when key % 8 = 0 then 'men' when key % 19 = 0 then 'robot' else coalesce(gender, 'unisex') end as g, case when key % 23 = 0 then 'gold' else tier end as tier from scored s join outfits using (key)),
n as (select *, case when {_HAS.format('top')} and {_HAS.format('bottom')} and not {_HAS.format('dress')} then 'top+bottom' || case when {_HAS.format('shoes')} then '+shoes' else '' end when {_HAS.format('dress')} and not {_HAS.format('top')} and not {_HAS.format('bottom')} then 'dress' || case when {_HAS.format('shoes')} then '+shoes' else '' end else 'invalid' end as shape,
  [v for v in oc if v in {_in(OCCASIONS)}] as ocv, [v for v in st if v in {_in(STYLES)}] as stv, [v for v in bo if v in {_in(BODY_SHAPES)}] as bov, [v for v in se if v in {_in(SEASONS)}] as sev,
  list_sort(list_distinct([x.g for x in xs if x.g <> 'unisex'])) as gs, coalesce({_sql_lists(FORMALITY_OCCASIONS, _TOP)}, []) as allowed, {_union('b')} as mb, {_union('se')} as ms, '["' || array_to_string(cats, '","') || '"]' as cj from o)"""


def _json(items: str) -> str:
    return f"""'["' || array_to_string({items}, '","') || '"]'"""


def _beyond(values: str, allowed: str) -> str:
    return f"list_sort(list_distinct([v for v in {values} if not list_contains({allowed}, v)]))"


_FLAGGED = f"""{_VIEW}, f as (select outfit_id, shape as core_shape, g as gender, unnest([case when len(gs) > 1 then ['mixed_gender_items', 'high', array_to_string(gs, ', ')] end,
  case when g <> case when len(gs) = 1 then gs[1] else 'unisex' end then ['outfit_gender_mismatch', 'high', 'outfit=' || g || ' expected=' || case when len(gs) = 1 then gs[1] else 'unisex' end] end,
  case when len({_beyond('ocv', 'allowed')}) > 0 then ['occasion_formality_mismatch', 'high', {_json(_beyond('ocv', 'allowed'))}] end, case when len({_beyond('bov', 'mb')}) > 0 then ['body_shape_not_in_main_garments', 'high', {_json(_beyond('bov', 'mb'))}] end,
  case when len({_beyond('sev', 'ms')}) > 0 then ['season_not_in_main_garments', 'high', {_json(_beyond('sev', 'ms'))}] end, case when shape = 'invalid' then ['invalid_item_combo', 'high', cj] when not {_HAS.format('shoes')} then ['missing_recommended_shoes', 'low', cj] end]) as x from n),
flags as (select outfit_id, core_shape, gender, x[1] as rule_id, x[2] as severity, x[3] as evidence from f where x is not null)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    more = lambda c, by, values: F.concat(c, F.when(k % by == 0, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>")))
    items = F.col("items")
    rows = _outfits(spark, sf_dir)
    rows = rows.select("key", "items", *tags.outfit_record(items, tags.outfit_score(items)))
    return outfit_audit.normalized(rows.select(
        F.concat(F.lit("o"), k.cast("string")).alias("outfit_id"), F.when(k % 17 == 0, "3.0").otherwise("3.1").alias("schema_version"), "items", "score", more(F.col("occasions"), 4, OCCASIONS[:4]).alias("occasions"), more(F.col("styles"), 5, ("goth", "punk")).alias("styles"),
        more(F.col("body_shapes"), 6, ("apple", "round")).alias("body_shapes"), more(F.col("seasons"), 7, ("winter",)).alias("seasons"), F.when(k % 8 == 0, "men").when(k % 19 == 0, "robot").otherwise(F.coalesce("gender", F.lit("unisex"))).alias("gender"), F.when(k % 23 == 0, "gold").otherwise(F.col("price_tier")).alias("price_tier"),
    ))


@query(f"""with {CATALOG}, {_VIEW} select outfit_id, 'schema_version' as field, 'invalid_schema_version' as reason, ver as evidence from n where ver <> '3.1' union all select outfit_id, 'items', 'missing_core_categories', cj from n where shape = 'invalid'
union all select outfit_id, 'gender', 'invalid_gender', g from n where g = 'robot' union all select outfit_id, 'price_tier', 'invalid_price_tier', tier from n where tier = 'gold'
union all select outfit_id, 'styles', 'invalid_style', v from (select outfit_id, unnest(st) as v from n) where v not in {_in(STYLES)} union all select outfit_id, 'body_shapes', 'invalid_body_shape', v from (select outfit_id, unnest(bo) as v from n) where v not in {_in(BODY_SHAPES)}""")
def outfit_invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outfit_audit.invalid_values(_audited(spark, sf_dir))


@query(f"with {CATALOG}, {_FLAGGED} select * from flags")
def outfit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outfit_audit.semantic_flags(_audited(spark, sf_dir))


@query(f"""with {CATALOG}, {_VIEW} select outfit_id, 'many_occasions' as outlier_type, array_to_string(ocv, ', ') as evidence from n where len(ocv) > 5 union all select outfit_id, 'many_styles', array_to_string(stv, ', ') from n where len(stv) > 4
union all select outfit_id, 'many_body_shapes', array_to_string(bov, ', ') from n where len(bov) > 3 union all select outfit_id, 'many_seasons', array_to_string(sev, ', ') from n where len(sev) > 3""")
def outfit_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outfit_audit.outliers(_audited(spark, sf_dir))


@query(f"""with {CATALOG}, {_VIEW}, c as (select shape, v, count(*) as c from (select shape, unnest(ocv) as v from n) group by 1, 2), d as (select shape, v, count(*) as c from (select shape, unnest(stv) as v from n) group by 1, 2)
select shape as core_shape, count(*) as total, round_even(avg(len(xs)), 6) as avg_items, round_even(avg(score::decimal(18, 6))::decimal(28, 12), 6)::double as avg_score, round_even(avg(len(bov)), 6) as avg_body_shapes, round_even(avg(len(sev)), 6) as avg_seasons,
  (select arg_min(v, (-c, v)) from c where c.shape = n.shape) as top_occasion, (select arg_min(v, (-c, v)) from d where d.shape = n.shape) as top_style from n group by 1""")
def outfit_shape_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outfit_audit.distribution(_audited(spark, sf_dir), "core_shape")


@query(f"""with {CATALOG}, {_FLAGGED}, b as (select outfit_id, array_to_string(list_sort(list_distinct(list(rule_id))), '; ') as flags, bool_or(severity = 'high') as sure from flags group by 1),
i as (select outfit_id, shape as core_shape, coalesce(flags, '') as flags, coalesce(sure, false) as sure from n left join b using (outfit_id))
select outfit_id, core_shape, flags from i qualify sure or row_number() over (partition by core_shape, sure order by sha256('42:' || outfit_id), outfit_id) <= 3""")
def outfit_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _audited(spark, sf_dir)
    return outfit_audit.review_sample(rows, outfit_audit.semantic_flags(rows), 3)
