"""Catalog operators: loading, upsert, quality checks, batch gates, price audit, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import domain, free_name
from weftline.functions.vocab import CATEGORIES, FORMALITIES, GENDERS


def load_items(catalog: DataFrame, links: DataFrame, in_stock_only: bool = True) -> DataFrame:
    """Items with their offers; unknown categories drop the row, unknown gender and formality fall back."""
    items = catalog.select("item_id", domain(F.col("category"), CATEGORIES, None).alias("category"), domain(F.col("gender"), GENDERS, "unisex").alias("gender"), domain(F.col("formality"), FORMALITIES, "casual").alias("formality"), "color")
    offers = links.withColumn("in_stock", F.coalesce("in_stock", F.lit(False)))
    out = items.where(F.col("category").isNotNull()).join(offers, "item_id")
    return out.where("in_stock") if in_stock_only else out


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row by `order`."""
    rank = free_name(rows, "rank")
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Upsert: the rows of both, of each key that of the newer table, and within a table the last by `order`."""
    age = free_name(old, "age")
    both = old.withColumn(age, F.lit(0)).unionByName(new.withColumn(age, F.lit(1)))
    return latest(both, keys, [F.desc(age), *(order or [])]).drop(age)


def quality_report(catalog: DataFrame, links: DataFrame, low: int, high: int) -> DataFrame:
    """(code, level, n): how many rows each check finds; checks without findings are left out. Row checks take one pass of each table."""

    def row_checks(rows: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
        found = [F.when(failed, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, (level, failed) in checks.items()]
        each = rows.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
        return each.groupBy("x.code", "x.level").agg(F.count("*").alias("n"))

    def repeats(rows: DataFrame, code: str, *keys: str) -> DataFrame:
        more = rows.groupBy(*keys).agg((F.count("*") - 1).alias("more"))
        return more.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n")).select(F.lit(code).alias("code"), F.lit("error").alias("level"), "n")

    def missing(rows: DataFrame, others: DataFrame, code: str) -> DataFrame:
        return rows.join(others, "item_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit("error").alias("level"), "n")

    out = row_checks(catalog, {"invalid_category": ("error", ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)))})
    out = out.unionAll(row_checks(links, {"invalid_price": ("error", ~F.coalesce(F.col("price").between(low, high), F.lit(False))), "out_of_stock": ("warning", F.coalesce(~F.col("in_stock"), F.lit(False)))}))
    out = out.unionAll(repeats(catalog, "duplicate_item_id", "item_id")).unionAll(repeats(links, "duplicate_item_store_link", "item_id", "store_id"))
    out = out.unionAll(missing(catalog, links.select("item_id"), "catalog_without_link")).unionAll(missing(links, catalog.select("item_id"), "link_without_catalog"))
    return out.where("n > 0")


def gate(rows: DataFrame, group: str, order: list[str], bad: Column, chunk: int = 250, least_yield: float = 0.3) -> DataFrame:
    """(group, chunk, n, n_bad, status): chunks by position within a group; a chunk with a bad row is quarantined, as is a whole group of low yield.

    A group is ordered in one task; checks.gate_batches numbers groups of any size by ranges of a position.
    """
    place, failed = free_name(rows, "chunk"), free_name(rows, "failed")
    placed = rows.withColumn(place, F.floor((F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1) / chunk)).withColumn(failed, bad.cast("int"))
    chunks = placed.groupBy(group, F.col(place).alias("chunk")).agg(F.count("*").alias("n"), F.sum(failed).alias("n_bad"))
    good = F.sum(F.col("n") - F.col("n_bad")).over(W.partitionBy(group)) / F.sum("n").over(W.partitionBy(group))
    return chunks.withColumn("status", F.when((F.col("n_bad") > 0) | (good < least_yield), "quarantined").otherwise("passed"))


def price_outliers(links: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Offers far below their store's median price."""
    medians = links.where("store_id is not null").groupBy("store_id").agg(F.median("price").alias("median_price"))
    return links.join(medians, "store_id").where(F.col("price") < ratio * F.col("median_price")).select("item_id", "store_id", "price", "median_price")


def representative_slice(items: DataFrame, group: str, limit: int) -> DataFrame:
    """From each group at most `limit` items at evenly spaced places of its order by price and id."""
    # counts by price give each row its place but for equal prices, so no task orders a whole group
    price_sizes = items.groupBy(F.col(group).alias("s_group"), F.col("price").alias("s_price")).agg(F.count("*").alias("size"))
    w = W.partitionBy("s_group")
    lower = F.coalesce(F.sum("size").over(w.orderBy("s_price").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = price_sizes.select("s_group", "s_price", lower.alias("s_lower"), F.sum("size").over(w).alias("s_all"))
    both = items.join(sizes, F.col(group).eqNullSafe(F.col("s_group")) & F.col("price").eqNullSafe(F.col("s_price")))
    place = F.col("s_lower") + F.row_number().over(W.partitionBy(group, "price").orderBy("item_id")) - 1
    wanted = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (F.col("s_all") - 1) / F.lit(max(limit - 1.0, 1.0)), 0).cast("bigint"))
    return both.withColumn("s_place", place).where((F.col("s_all") <= limit) | F.array_contains(wanted, F.col("s_place").cast("bigint"))).select(items.columns)
