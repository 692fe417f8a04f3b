"""Places in an order of all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import free_name
from weftline.sources.shared import written


def ranked(rows: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """rows with a column of consecutive numbers in an order.

    Rows are dealt out by ranges of the order and written; a range's rows are numbered within it, after the counts of the
    ranges before. The order has to tell all rows apart for the same numbers each time.
    """
    part, before = free_name(rows, "_part"), free_name(rows, "_before")
    dealt = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    # one row a range
    counts = dealt.groupBy(part).agg(F.count("*").alias(before))
    lower = counts.select(part, F.coalesce(F.sum(before).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    within = F.row_number().over(W.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, within).join(F.broadcast(lower), part).withColumn(name, F.col(name) + F.col(before) + (start - 1)).select(*rows.columns, name)
