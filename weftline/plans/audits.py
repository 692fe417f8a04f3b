"""Queries of tag answers, errors of tagging services and audits of item tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocab import BODY_SHAPES, CATEGORIES, SEASONS
from weftline.operators import audit
from weftline.plans.ingest import _in, _list, sql_any
from weftline.plans.registry import query
from weftline.sources.tables import pick, table

BODIES = ('["pear","apple"]', "[]", "pear, apple", '{"a":1}', '["pear", " hourglass ", "round", ""]', '["pear","apple","hourglass","rectangle"]', "")
SEASON_LISTS = ('["summer"]', '["winter"]', '["summer","winter","rainy","transitional"]', "nan", '["autumn","summer"]', "[summer")
COLOR_LISTS = ('["đen"]', "[]", '["a","b","c","d","e","f"]', "x")
TITLES = ("Áo PHAO dày", "Sandal da", "Áo thun", "Trench Coat", "Đầm dạ hội")
NOTES = ("", "  ", *audit.FALLBACK_NOTES.values(), "Áo đẹp cho mọi dịp", " Quota exceeded ", "Phối dễ. " * 20, "Túi đi cùng")

_AUDIT = f"""src as (select p_partkey as k, printf('item_%06d', p_partkey) as item_id, {_list(CATEGORIES)}[p_partkey % 7 + 1] as category, case when p_partkey % 9 = 0 then 'unknown' else 's' || (p_partkey % 4) end as store_id,
  {_list(TITLES)}[p_partkey // 7 % 5 + 1] as title, {_list(BODIES)}[p_partkey // 3 % 7 + 1] as b, {_list(SEASON_LISTS)}[p_partkey // 5 % 6 + 1] as s, {_list(COLOR_LISTS)}[p_partkey // 2 % 4 + 1] as c,
  case when p_partkey % 13 = 0 then 'Ghi chú ' || p_partkey else trim({_list(NOTES)}[p_partkey // 11 % 9 + 1]) end as note from part),
lists as (select *, {", ".join(f"case when json_valid({x}) and json_type(case when json_valid({x}) then {x} else 'null' end) = 'ARRAY' then list_filter(list_transform(from_json({x}, '[\"VARCHAR\"]'), lambda v: trim(v)), lambda v: v <> '') end as {x}l" for x in "bsc")} from src),
a as (select *, list_filter(coalesce(bl, []), lambda v: v in {_in(BODY_SHAPES)}) as bv, list_filter(coalesce(sl, []), lambda v: v in {_in(SEASONS)}) as sv, coalesce(cl, []) as cv,
  coalesce(note = case category {' '.join(f"when '{k}' then '{v}'" for k, v in audit.FALLBACK_NOTES.items())} else '' end, false) as fallback from lists)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    at = lambda values, by: pick(values, F.floor(k / by) % len(values))
    return audit.audited(table(spark, sf_dir, "part").select(
        F.format_string("item_%06d", k).alias("item_id"),
        pick(CATEGORIES, k % 7).alias("category"),
        F.when(k % 9 != 0, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("store_id"),
        at(TITLES, 7).alias("title"),
        F.nullif(at(BODIES, 3), F.lit("")).alias("body_shapes"),
        at(SEASON_LISTS, 5).alias("seasons"),
        at(COLOR_LISTS, 2).alias("colors"),
        F.when(k % 13 == 0, F.concat(F.lit("Ghi chú "), k.cast("string"))).otherwise(at(NOTES, 11)).alias("note"),
    ))


@query(f"""with {_AUDIT}, r as (select item_id, 'body_shapes' as field, 'invalid_json_list' as reason, b as evidence from a where bl is null and b not in ('', 'nan')
union all select item_id, 'seasons', 'invalid_json_list', s from a where sl is null and s not in ('', 'nan') union all select item_id, 'colors', 'invalid_json_list', c from a where cl is null and c not in ('', 'nan')
union all select item_id, 'body_shapes', 'invalid_body_shape', v from (select item_id, unnest(bl) as v from a) where v not in {_in(BODY_SHAPES)} union all select item_id, 'seasons', 'invalid_season', v from (select item_id, unnest(sl) as v from a) where v not in {_in(SEASONS)}
union all select item_id, 'note', 'empty_note', '' from a where note = '' union all select item_id, 'note', 'backend_error_leak', note from a where note <> '' and {sql_any('lower(note)', audit.LEAK_MARKERS)}) select * from r""")
def invalid_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.invalid_tags(_audited(spark, sf_dir))


@query(f"""with {_AUDIT} select item_id, 'many_body_shapes' as outlier_type, array_to_string(bv, ', ') as evidence from a where len(bv) > 3 union all select item_id, 'many_seasons', array_to_string(sv, ', ') from a where len(sv) > 3
union all select item_id, 'many_colors', array_to_string(cv, ', ') from a where len(cv) > 5 union all select item_id, 'long_note', note from a where length(note) > 140""")
def tag_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.outliers(_audited(spark, sf_dir))


_MAIN = f"category in {_in(audit.MAIN_CATEGORIES)}"
_OTHER = " or ".join(f"(category = '{c}' and starts_with(lower(note), '{n} '))" for c, names in audit.OTHER_GARMENTS.items() for n in names)
_FLAGS = f"""{_AUDIT}, counted as (select *, count(*) over (partition by note) as n from a), f as (
select item_id, category, store_id, title, unnest([
  case when category in {_in(audit.OTHER_GARMENTS)} and len(bv) > 0 then [category || '_has_body_shape', 'medium', array_to_string(bv, ', ')] end, case when {_MAIN} and len(bv) = 0 then ['main_garment_missing_body_shape', 'medium', 'body_shapes_fit=[]'] end,
  case when {_MAIN} and len(cv) = 0 then ['main_garment_missing_color', 'medium', 'colors=[]'] end, case when {sql_any('lower(title)', audit.WINTER_WORDS)} and sv = ['summer'] then ['winter_outerwear_summer_only', 'high', '[''summer'']'] end,
  case when {sql_any('lower(title)', audit.SUMMER_WORDS)} and sv = ['winter'] then ['summer_item_winter_only', 'high', '[''winter'']'] end, case when fallback then ['fallback_note_review', 'low', note] end,
  case when note <> '' and not fallback and n >= 10 then ['repeated_generic_note', 'medium', 'repeat_count=' || n] end, case when {_OTHER} then ['note_category_mismatch', 'high', note] end]) as x from counted),
flags as (select item_id, category, store_id, title, x[1] as rule_id, x[2] as severity, x[3] as evidence from f where x is not null)"""


@query(f"with {_FLAGS} select * from flags")
def semantic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.semantic_flags(_audited(spark, sf_dir))


@query(f"""with {_FLAGS}, by_item as (select item_id, array_to_string(list_sort(list_distinct(list(rule_id))), '; ') as flags, bool_or(severity = 'high' or rule_id = 'fallback_note_review') as sure from flags group by 1),
i as (select a.item_id, category, store_id, title, coalesce(flags, '') as flags, coalesce(sure, false) as sure from a left join by_item using (item_id))
select item_id, category, store_id, title, flags from i qualify sure or row_number() over (partition by category, sure order by sha256('42:' || item_id), item_id) <= 5""")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _audited(spark, sf_dir)
    return audit.review_sample(rows, audit.semantic_flags(rows))


#: A tagging model's answer, and the shapes, seasons, colors and note that it should give (joined by |).
TAG_ANSWERS = (
    ('```json\n{"body_shapes": ["pear", "round", "pear"], "season": "summer, winter", "color": "đen", "explanation_vi": " Đẹp "}\n```', "pear", "summer|winter", "đen", "Đẹp"),
    ('{"body_shapes_fit": [], "body_shapes": "apple", "seasons": ["rainy", " "], "colors": ["a", " b ", "a"], "stylist_notes_vi": ""}', "apple", "rainy", "a|b", ""),
    ("  ", "", "", "", ""),
    ('{"body_shapes_fit": "[\\"pear\\", \\"apple\\"]", "season": ["Summer"]}', "pear|apple", "", "", ""),
)


def _nth(values) -> str:
    return f"{_list(values)}[event_id % {len(values)} + 1]"


_TAGS = f"""t as (select event_id, {_list(CATEGORIES)}[user_id % 7 + 1] as category, {_nth([t[1] for t in TAG_ANSWERS])} as body_shapes, {_nth([t[2] for t in TAG_ANSWERS])} as seasons, {_nth([t[3] for t in TAG_ANSWERS])} as colors, {_nth([t[4] for t in TAG_ANSWERS])} as own, user_id % 2 = 0 as known from events)"""


@query(f"""with {_TAGS} select event_id, body_shapes, seasons, case when colors = '' and known then 'be' else colors end as colors, case when body_shapes = '' and seasons = '' and own = '' then case category {' '.join(f"when '{k}' then '{v}'" for k, v in audit.FALLBACK_NOTES.items())} else '{audit.PLAIN_NOTE}' end else own end as note,
(colors <> '' or known) and case when {_MAIN} then body_shapes <> '' and seasons <> '' else body_shapes <> '' or seasons <> '' or own <> '' end as complete from t""")
def sanitized_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        pick(CATEGORIES, F.col("user_id") % 7).alias("category"),
        audit.sanitize_tags(pick(tuple(t[0] for t in TAG_ANSWERS), F.col("event_id") % len(TAG_ANSWERS))).alias("t"),
        F.when(F.col("user_id") % 2 == 0, F.array(F.lit("be"))).alias("known"),
    )
    t, category, known = F.col("t"), F.col("category"), F.col("known")
    joined = lambda c: F.array_join(c, "|")
    return rows.select("event_id", joined(t["body_shapes"]).alias("body_shapes"), joined(t["seasons"]).alias("seasons"), joined(audit.effective_colors(t, known)).alias("colors"), audit.ensure_note(t, category).alias("note"), audit.is_complete(t, category, known).alias("complete"))


#: An error of a tagging service, and the status, limit, wait, outage and quota that it tells.
ERRORS = (
    ("429 RESOURCE_EXHAUSTED limit: 15, Please retry in 2.5s.", "rate_limited", 15, 2.5, False, True),
    ("Quota exceeded", "rate_limited", None, None, False, True),
    ("Invalid API key", "auth_error", None, None, False, False),
    ("task is not supported by provider", "unsupported", None, None, False, False),
    ("[WinError 10061] actively refused", "error", None, None, True, False),
    ("", "error", None, None, False, False),
)
_ERROR_ROWS = ", ".join(f"({k}, '{s}', {n or 'null'}::bigint, {w or 'null'}::double, {str(o).lower()}, {str(q).lower()})" for k, (_, s, n, w, o, q) in enumerate(ERRORS))


@query(f"select event_id, status, limit_rpm, retry_after_s, outage, quota from events join (values {_ERROR_ROWS}) e(k, status, limit_rpm, retry_after_s, outage, quota) on event_id % {len(ERRORS)} = k")
def backend_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(tuple(e[0] for e in ERRORS), F.col("event_id") % len(ERRORS))
    return table(spark, sf_dir, "events").select("event_id", audit.backend_error(text).alias("e")).select("event_id", "e.*")
