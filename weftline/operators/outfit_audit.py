"""Audits of outfit tags: normalised outfits, invalid values, outliers, flags, distributions and a review sample.

Outfits are rows of outfit_id, schema_version, items (array of structs as in tags), score, occasions, styles,
body_shapes, seasons, colors, gender, price_tier and price_total. Missing lists count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import formality_rank
from weftline.functions.vocab import BODY_SHAPES, CATEGORIES, FORMALITIES, FORMALITY_RELEVANT, GENDERS, OCCASIONS, PRICE_TIERS, SEASONS, STYLES
from weftline.operators import tags
from weftline.operators.audit import _findings
from weftline.operators.corpus import top_tags

# fixed values: domains of the lists, how many of each are usual, main garments, the version of a record
DOMAINS = {"occasions": OCCASIONS, "styles": STYLES, "body_shapes": BODY_SHAPES, "seasons": SEASONS}
SINGULAR = {"occasions": "occasion", "styles": "style", "body_shapes": "body_shape", "seasons": "season"}
MOST = {"occasions": 5, "styles": 4, "body_shapes": 3, "seasons": 3}
MOST_ITEMS = 6
MAIN = ("top", "bottom", "dress", "outerwear")
VERSION = "3.1"
_NONE = "array<string>"


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def normalized(outfits: DataFrame) -> DataFrame:
    """Outfits with categories, core_shape, is_complete, n_items, by list its valid and invalid values, expected_gender, item_genders, allowed_occasions (of the most formal garment), main_body_shapes and main_seasons (of the main garments)."""
    items = F.col("items")
    categories = F.transform(items, lambda x: x["category"])
    known = F.size(F.array_except(categories, F.array(*map(F.lit, CATEGORIES)))) == 0
    shape = F.when(known, tags.core_shape(categories)).otherwise("invalid")
    ranks = F.transform(F.filter(items, lambda x: x["category"].isin(*FORMALITY_RELEVANT) & (F.coalesce(x["formality"], F.lit("")) != "")), lambda x: F.coalesce(formality_rank(x["formality"]), F.lit(0)))
    top = F.element_at(F.array(*map(F.lit, FORMALITIES)), F.array_max(ranks) + 1)
    main = F.filter(items, lambda x: x["category"].isin(*MAIN))
    union = lambda field: F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(main, lambda x: _list(x[field]))), lambda t: t != "")))
    rows = outfits.withColumns({
        "categories": categories, "core_shape": shape, "n_items": F.size(items), "expected_gender": F.coalesce(tags.outfit_gender(items), F.lit("unisex")),
        "item_genders": F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: F.coalesce(x["gender"], F.lit(""))), lambda g: g != ""))),
        "allowed_occasions": F.when(F.size(ranks) > 0, F.array_sort(tags.occasions_for(top))).otherwise(F.array().cast(_NONE)), "main_body_shapes": union("body_shapes"), "main_seasons": union("seasons"),
        **{c: tags.split_by_domain(_list(F.col(c)), domain) for c, domain in DOMAINS.items()},
    })
    return rows.withColumn("is_complete", F.col("core_shape").isin("dress+shoes", "top+bottom+shoes"))


def invalid_values(rows: DataFrame) -> DataFrame:
    """(outfit_id, field, reason, evidence) of normalised outfits."""
    one = lambda field, reason, evidence: F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), evidence.alias("evidence"))
    outside = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    found = F.filter(F.array(
        F.when(outside("schema_version", (VERSION,)), one("schema_version", "invalid_schema_version", F.col("schema_version"))),
        F.when(F.col("core_shape") == "invalid", one("items", "missing_core_categories", F.to_json("categories"))),
        F.when(outside("gender", GENDERS), one("gender", "invalid_gender", F.col("gender"))),
        F.when(outside("price_tier", PRICE_TIERS), one("price_tier", "invalid_price_tier", F.col("price_tier"))),
    ), lambda x: x.isNotNull())
    of_list = lambda c: F.transform(F.col(c)["invalid"], lambda v: one(c, f"invalid_{SINGULAR[c]}", v))
    lists = [of_list(c) for c in DOMAINS]
    return rows.select("outfit_id", F.explode(F.concat(found, *lists)).alias("x")).select("outfit_id", "x.*")


def outliers(rows: DataFrame) -> DataFrame:
    """(outfit_id, outlier_type, evidence): outfits of many items or tags."""
    one = lambda kind, evidence: F.struct(F.lit(kind).alias("outlier_type"), evidence.alias("evidence"))
    found = [F.when(F.size(F.col(c)["valid"]) > most, one(f"many_{c}", F.array_join(F.col(c)["valid"], ", "))) for c, most in MOST.items()]
    return _findings(rows, ["outfit_id"], [F.when(F.col("n_items") > MOST_ITEMS, one("too_many_items", F.col("n_items").cast("string"))), *found])


def semantic_flags(rows: DataFrame) -> DataFrame:
    """(outfit_id, core_shape, gender, rule_id, severity, evidence): what doesn't go together."""
    one = lambda rule, severity, evidence: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), evidence.alias("evidence"))
    genders = F.filter("item_genders", lambda g: g != "unisex")

    def beyond(field: str, allowed: str, rule: str) -> Column:
        more = F.array_sort(F.array_distinct(F.array_except(F.col(field)["valid"], F.col(allowed))))
        return F.when(F.size(more) > 0, one(rule, "high", F.to_json(more)))

    return _findings(rows, ["outfit_id", "core_shape", "gender"], [
        F.when(F.size(genders) > 1, one("mixed_gender_items", "high", F.array_join(genders, ", "))),
        F.when(~F.col("gender").eqNullSafe(F.col("expected_gender")), one("outfit_gender_mismatch", "high", F.concat(F.lit("outfit="), F.coalesce("gender", F.lit("None")), F.lit(" expected="), "expected_gender"))),
        beyond("occasions", "allowed_occasions", "occasion_formality_mismatch"),
        beyond("body_shapes", "main_body_shapes", "body_shape_not_in_main_garments"),
        beyond("seasons", "main_seasons", "season_not_in_main_garments"),
        F.when(F.col("core_shape") == "invalid", one("invalid_item_combo", "high", F.to_json("categories"))).when(~F.array_contains("categories", "shoes"), one("missing_recommended_shoes", "low", F.to_json("categories"))),
    ])


def distribution(rows: DataFrame, group: str) -> DataFrame:
    """By group (null as unknown): total, mean numbers of items, body shapes and seasons, mean score, top occasion and style."""
    named = rows.withColumn(group, F.coalesce(group, F.lit("unknown")))
    mean = lambda c, name: F.bround(F.avg(c), 6).alias(name)
    by = named.groupBy(group).agg(F.count("*").alias("total"), mean("n_items", "avg_items"), mean("score", "avg_score"), mean(F.size(F.col("body_shapes")["valid"]), "avg_body_shapes"), mean(F.size(F.col("seasons")["valid"]), "avg_seasons"))
    for c in ("occasions", "styles"):
        best = top_tags(named.select(group, F.col(c)["valid"].alias(c)), group, c).withColumnRenamed("top_tag", f"top_{SINGULAR[c]}")
        by = by.join(best, group, "left")
    return by


def summary(rows: DataFrame) -> DataFrame:
    """One row: total, complete, completion_rate (6 decimals), with body shapes, with seasons, invalid values, outliers, flags."""
    total = rows.agg(F.count("*").alias("total"), F.count_if("is_complete").alias("complete"), F.bround(F.coalesce(F.avg(F.col("is_complete").cast("int")), F.lit(0.0)), 6).alias("completion_rate"), F.count_if(F.size(F.col("body_shapes")["valid"]) > 0).alias("with_body_shapes"), F.count_if(F.size(F.col("seasons")["valid"]) > 0).alias("with_seasons"))
    for name, found in (("invalid", invalid_values(rows)), ("outliers", outliers(rows)), ("flags", semantic_flags(rows))):
        total = total.join(found.agg(F.count("*").alias(name)))  # one row each
    return total


def review_sample(rows: DataFrame, flags: DataFrame, per_shape: int = 10, seed: str = "42") -> DataFrame:
    """(outfit_id, core_shape, flags): every outfit with a flag of high severity, and of the others per_shape of each shape in a hash order; one row an outfit."""
    by = flags.groupBy("outfit_id").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), "; ").alias("flags"), F.bool_or(F.col("severity") == "high").alias("sure"))
    each = rows.groupBy("outfit_id").agg(F.min("core_shape").alias("core_shape")).join(by, "outfit_id", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
    order = W.partitionBy("core_shape").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "outfit_id"), 256), "outfit_id")
    drawn = each.where("not sure").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_shape).drop("_place")
    return each.where("sure").unionByName(drawn).select("outfit_id", "core_shape", F.coalesce("flags", F.lit("")).alias("flags"))
