"""Queries of the scenario bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocab import BODY_SHAPES, OCCASIONS, SKIN_TONES, STYLES
from weftline.operators import scenarios
from weftline.plans.building import parts
from weftline.plans.ingest import _list
from weftline.plans.outfit_tags import _BANDS, OUTFITS
from weftline.plans.queries import CATALOG
from weftline.plans.registry import query

COUNTS = {"tool_calling_grounded": 90, "recommend_explain_grounded": 70, "ask_missing_info_grounded": 35, "no_result_or_relax_constraints": 25, "polite_decline_anti_hallucination": 15, "multi_turn_grounded": 150, "body_fit_grounded": 30}
#: task, number, pool, first three only, shift, shows candidates, names the occasion, has a target, price below all, made-up id, height, weight, flags
_ROWS = [("tool_calling_grounded", 90, 1, 1, 0, 1, 1, 0, 0, 0, 160, 52, "1000"), ("recommend_explain_grounded", 70, 1, 1, 0, 1, 1, 0, 0, 0, 159, 51, "0000"), ("ask_missing_info_grounded", 35, 1, 0, 0, 1, 0, 1, 0, 0, 158, 50, "0100"), ("no_result_or_relax_constraints", 25, 2, 0, 0, 0, 1, 0, 1, 0, 162, 54, "0001"),
         ("polite_decline_anti_hallucination", 15, 1, 1, 0, 0, 1, 0, 0, 1, 164, 56, "0010"), ("multi_turn_grounded", 150, 2, 0, 0, 1, 0, 1, 0, 0, 161, 53, "1100"), ("body_fit_grounded", 30, 1, 1, 1, 1, 1, 0, 0, 0, 157, 49, "0000")]
_TASKS = ", ".join(str((k, *r)) for k, r in enumerate(_ROWS))


def _vocab(values) -> str:
    return f"{_list(values)}[k % {len(values)} + 1]"


@query(f"""with {CATALOG}, {OUTFITS}, {_BANDS}, seeds as (select b.occasion, p.* from parts p join bands b using (formality) where category in ('top', 'dress') and k % 5 <> 0 and url <> ''),
pool as (select *, row_number() over (partition by occasion order by item_id, price) - 1 as slot, count(*) over (partition by occasion) as size, min(price) over (partition by occasion) as low from seeds),
t as (select *, sum(n) over (order by o) - n as start from (values {_TASKS}) v(o, task_type, n, pool, head, shift, shows, asks, target, below, fake, h, w, flags)),
s as (select t.*, k, case pool when 1 then '{OCCASIONS[0]}' else 'travel' end as occasion from t, range(200) r(k) where k < n),
j as (select s.*, p.item_id, p.price, p.low from s join pool p on p.occasion = s.occasion and p.slot = (s.k + s.shift) % case when head = 1 then least(3, p.size) else p.size end)
select printf('SC_%06d', (start + k + 1)::bigint) as scenario_id, task_type, item_id as seed_item_id, case when asks = 1 then occasion end as occasion, {_vocab(STYLES)} as style, {_vocab(BODY_SHAPES)} as body_shape, {_vocab(SKIN_TONES)} as skin_tone,
  case when below = 1 then greatest(0, low - 1) else greatest(price, 300000) end + k % 5 * 50000 as price_max, case when fake = 1 then printf('OUTFIT_FAKE_%03d', (k + 1)::bigint) end as requested_outfit_id, (h + k % 10)::int as height_cm, (w + k % 8)::int as weight_kg, flags,
  case when target = 1 then occasion end as target_occasion, case when shows = 1 then (select string_agg(item_id, '|' order by slot) from pool q where q.occasion = j.occasion and slot < 3) else '' end as candidate_ids from j""")
def scenario_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("item_id", 6, 12).cast("bigint")
    items = parts(spark, sf_dir).withColumn("in_stock", k % 5 != 0).withColumn("title", F.concat(F.lit("t"), "item_id"))
    got = scenarios.scenario_bank(items, COUNTS)
    flags = F.concat(*[F.col("expected")[f"should_{e}"].cast("int").cast("string") for e in scenarios.EXPECTED])
    request = [F.col("request")[c].alias(c) for c in ("occasion", "style", "body_shape", "skin_tone", "price_max", "requested_outfit_id")]
    profile = [F.col("user_profile")[c].cast("int").alias(c) for c in ("height_cm", "weight_kg")]
    return got.select("scenario_id", "task_type", F.col("seed_item.item_id").alias("seed_item_id"), *request, *profile, flags.alias("flags"), "target_occasion", F.array_join(F.transform("candidates", lambda c: c["item_id"]), "|").alias("candidate_ids"))
