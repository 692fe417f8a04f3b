"""Choosing outfits: scored again with a threshold, and as many of each price tier as asked for.

Columns: outfit_id, price_tier, price_total, score; others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.vocab import PRICE_TIERS
from weftline.sources.shared import written


def rescored(outfits: DataFrame, score: Column, threshold: float = 0.0) -> DataFrame:
    """Outfits with their score replaced, between 0 and 1, that reach the threshold; a null score is 0."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.cast("double"), F.lit(0.0))))
    return outfits.withColumn("score", bounded).where(F.col("score") >= threshold)


def select_balanced(outfits: DataFrame, tier_counts: dict[str, int]) -> DataFrame:
    """As many outfits as the counts add up to, the best first by score, then by low price, then by last id.

    Each tier gives as many different outfits as its count (one at least); the best of the rest fill up what is
    missing, whatever their tier, and the best are repeated if there are fewer outfits than asked for. Column
    chosen tells which: quota, fill or repeat. Of rows with one outfit_id the best counts. Ranks keep only the
    rows of each tier's count before they are shuffled; the result is as small as the counts.
    """
    n = sum(tier_counts.values())
    best = [F.desc_nulls_last("score"), F.asc("price_total"), F.desc("outfit_id")]
    rows = outfits.drop("chosen")
    # all columns are ordered, so rows that differ in others only are chosen alike in each run
    different = rows.groupBy("outfit_id").agg(F.min(F.struct((-F.col("score")).alias("_low"), "price_total", F.struct(*rows.columns).alias("row"))).alias("x")).select("x.row.*")
    count = F.lit(None).cast("int")
    for tier, c in tier_counts.items():
        count = F.when(F.col("price_tier") == tier, max(c, 1)).otherwise(count)
    most = max([1, *tier_counts.values()])
    ranked = different.where(F.col("price_tier").isin(*tier_counts)).withColumn("chosen", F.row_number().over(W.partitionBy("price_tier").orderBy(*best)))
    ranked = ranked.where((F.col("chosen") <= most) & (F.col("chosen") <= count))
    by_tier = F.array_position(F.array(*map(F.lit, PRICE_TIERS)), F.col("price_tier"))
    quota = written(ranked.withColumn("chosen", F.lit("quota")).orderBy(by_tier, *best).limit(n), "quota")
    missing = n - quota.count()
    rest = different.join(quota.select("outfit_id"), "outfit_id", "left_anti").select(rows.columns)
    fill = written(rest.orderBy(*best).limit(missing).withColumn("chosen", F.lit("fill")), "fill")
    missing -= fill.count()
    again = rows.orderBy(*best).limit(missing).withColumn("chosen", F.lit("repeat"))
    return quota.unionByName(fill).unionByName(again)
