"""Edges, outfits and tags as tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src_id string, dst_id string, src_category string, dst_category string, weight double"
_LISTS = ("item_ids", "categories", "occasions", "styles", "body_shapes", "seasons", "colors")


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges sorted within files by source, so that a lookup skips row groups; replaces what is there."""
    names = [c.split()[0] for c in EDGE_SCHEMA.split(", ")]
    edges.select(*names).repartitionByRange("src_id").sortWithinPartitions("src_id", "dst_id").write.mode("overwrite").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edges of a path; none if nothing is there. Columns that are missing are an error."""
    try:
        found = spark.read.parquet(path)
    except Exception as e:
        if _missing(e):
            return spark.createDataFrame([], EDGE_SCHEMA)
        raise
    names = {c.split()[0]: c.split()[1] for c in EDGE_SCHEMA.split(", ")}
    lacking = sorted(set(names) - set(found.columns))
    if lacking:
        raise ValueError(f"edges lack columns: {', '.join(lacking)}")
    return found.select(*[F.col(c).cast(t) for c, t in names.items()])


def outfits_frame(records: DataFrame) -> DataFrame:
    """Outfit records as flat columns: lists as JSON, in a fixed order, schema_version first."""
    flat = [F.to_json(c).alias(c) if c in _LISTS else F.col(c) for c in records.columns if c not in ("items", "schema_version")]
    return records.select(F.lit("3.1").alias("schema_version"), *flat)


def write_outfits(records: DataFrame, path: str) -> None:
    outfits_frame(records).write.mode("overwrite").parquet(path)


def read_outfits(spark: SparkSession, path: str) -> DataFrame:
    """Outfit records of a path with their lists."""
    found = spark.read.parquet(path)
    return found.select(*[F.from_json(c, "array<string>").alias(c) if c in _LISTS else F.col(c) for c in found.columns])


def with_tags(catalog: DataFrame, tagged: DataFrame, fields: tuple[str, ...] = ("body_shapes", "seasons", "note")) -> DataFrame:
    """catalog with the fields of tagged (item_id, fields) where all of them are there; other rows stay as they are. Of repeated items the fullest, then the greatest counts."""
    full = F.lit(True)
    for c, t in tagged.select(*fields).dtypes:
        full = full & (F.size(c) > 0 if t.startswith("array") else F.coalesce(F.trim(c), F.lit("")) != "")
    new = tagged.where(F.coalesce(full, F.lit(False))).groupBy("item_id").agg(F.max(F.struct(*fields)).alias("_new"))
    both = catalog.join(new, "item_id", "left")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in catalog.columns])


def item_payload(items: DataFrame) -> DataFrame:
    """(item_id, payload): the JSON that an index of items is filtered by."""
    fields = F.struct("item_id", "category", "gender", "formality", F.col("price").alias("price_vnd"), F.coalesce("in_stock", F.lit(False)).alias("in_stock"), (F.coalesce("url", F.lit("")) != "").alias("has_vn_store"))
    return items.select("item_id", F.to_json(fields).alias("payload"))
