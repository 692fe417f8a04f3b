"""Evaluation metrics and apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import free_name


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): Mann-Whitney with average ranks for ties. Counts per score are ranked, not rows, so the one global order is over different scores only."""
    by = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    before = F.coalesce(F.sum("n").over(W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("rank", before + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return sums.select(F.bround(area, 6).alias("auc"))


def nearest_rank(rows: DataFrame, group: str, value: str, q: float, name: str) -> DataFrame:
    """(group, name): the value at place bround(q * (n - 1)) of each group's order, from counts per value."""
    n, upto, every = (free_name(rows, c) for c in ("n", "upto", "every"))
    by = rows.groupBy(group, value).agg(F.count("*").alias(n))
    w = W.partitionBy(group)
    placed = by.withColumn(upto, F.sum(n).over(w.orderBy(value))).withColumn(every, F.sum(n).over(w))
    return placed.where(F.col(upto) > F.bround(q * (F.col(every) - 1), 0)).groupBy(group).agg(F.min(value).alias(name))


def fitb_accuracy(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """(accuracy): the share of rows whose prediction is the label, 6 decimals, 0 for no rows."""
    hit = F.coalesce(F.col(predicted) == F.col(label), F.lit(False)).cast("int")
    return rows.agg(F.bround(F.coalesce(F.avg(hit), F.lit(0.0)), 6).alias("accuracy"))


def recall_at_k(found: Column, relevant: Column, k: int) -> Column:
    """The share of the relevant ids that are among the first k found, 0 without any."""
    wanted = F.array_distinct(relevant)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(F.slice(found, 1, k), wanted)) / F.size(wanted)).otherwise(0.0)


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, quota): whole quotas in proportion to the weights that add up to total; ties of the remainder go to the smaller key."""
    every = W.partitionBy()
    raw = weights.withColumn("raw", F.col(weight) * total / F.sum(weight).over(every))
    floored = raw.withColumn("base", F.floor("raw")).withColumn("left", F.lit(total) - F.sum(F.floor("raw")).over(every))
    rank = F.row_number().over(W.orderBy(F.desc(F.col("raw") - F.col("base")), key))
    return floored.withColumn("rank", rank).select(key, (F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("bigint").alias("quota"))
