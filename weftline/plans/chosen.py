"""Queries of outfits chosen by score and price tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import selection
from weftline.plans.outfit_tags import RECORDS, _records
from weftline.plans.queries import CATALOG
from weftline.plans.registry import query

COUNTS = {"budget": 5, "mid": 0, "premium": 12}
_N = sum(COUNTS.values())
_BEST = "score desc, total, outfit_id desc"


@query(f"""with {CATALOG}, {RECORDS}, x as (select outfit_id, tier, total, score, row_number() over (partition by tier order by {_BEST}) as r from scored),
quota as (select outfit_id, tier, total, score from x where r <= case tier {' '.join(f"when '{t}' then {max(c, 1)}" for t, c in COUNTS.items())} end order by list_position({list(COUNTS)}, tier), {_BEST} limit {_N}),
fill as (select outfit_id, tier, total, score from x where outfit_id not in (select outfit_id from quota) order by {_BEST} limit (select {_N} - count(*) from quota)),
again as (select outfit_id, tier, total, score from scored order by {_BEST} limit (select {_N} - (select count(*) from quota) - (select count(*) from fill)))
select *, 'quota' as chosen from quota union all select *, 'fill' from fill union all select *, 'repeat' from again""")
def balanced_outfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outfits, each there twice, by price tier."""
    found = _records(spark, sf_dir).select("outfit_id", "price_tier", "price_total", "score")
    chosen = selection.select_balanced(found.unionAll(found), COUNTS)
    return chosen.select("outfit_id", F.col("price_tier").alias("tier"), F.col("price_total").alias("total"), "score", "chosen")


@query(f"with {CATALOG}, {RECORDS} select outfit_id, least(1.0, score * 1.5)::double as score from scored where least(1.0, score * 1.5) >= 0.9")
def rescored_outfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rescored(_records(spark, sf_dir).select("outfit_id", "score"), F.col("score") * 1.5, 0.9)
