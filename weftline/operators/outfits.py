"""Outfits: clique expansion over the item graph, derived fields, search and preference ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import outfit_tier, stable_id
from weftline.operators.graph import directed
from weftline.sources.shared import written

#: Categories that may be added to an outfit's base, in this order. Fixed values.
OPTIONAL = ("shoes", "outerwear", "bag", "accessory")
#: Categories of what an outfit starts with: the seeds, and the bottom of a top.
SEEDS = ("top", "dress")
BASE = (*SEEDS, "bottom")


def _links(edges: DataFrame, categories: tuple[str, ...], to: tuple[str, ...] | None = None) -> DataFrame:
    """directed edges of the items of some categories, to all or some: item_id, partner_id, partner_category, weight and micro (weight in millionths)."""
    micro = F.bround(F.col("weight") * 1_000_000).cast("bigint").alias("micro")
    return directed(edges, categories, to).select("item_id", "partner_id", "partner_category", "weight", micro)


def ranked_partners(edges: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """_links with place: the rank among the item's partners of that category, by weight and then id."""
    order = W.partitionBy("item_id", "partner_category").orderBy(F.desc("weight"), "partner_id")
    return _links(edges, categories).withColumn("place", F.row_number().over(order)).drop("weight")


def _extended(outfits: DataFrame, ranked: DataFrame, edges: DataFrame, category: str, max_optional: int) -> DataFrame:
    """Adds to each outfit the seed's best partner of a category that has an edge to every item chosen so far, if there is one and room is left.

    Partners are joined by seed and looked up by edge, so no more rows arise than an item has partners of one category. Of the
    edges only those from what an outfit can hold by now to the category are dealt out.
    Both sides grow with the catalog, so they are merged: the size of a compressed file would have Spark send one of them out.
    """
    own = ranked.where(F.col("partner_category") == category).select(F.col("item_id").alias("own_seed"), F.col("partner_id").alias("cand"), F.col("place").alias("cand_place"), F.col("micro").alias("own_link"))
    # (seed, base_place) tells an outfit; its other columns ride along
    keys = ["seed", "base_place"]
    tried = outfits.where(F.col("added") < max_optional).join(own.hint("merge"), F.col("seed") == F.col("own_seed"))
    # that the seed has an edge to its partner is known, the others are looked up
    others = F.filter("items", lambda x: x != F.col("seed"))
    member = tried.select(*keys, F.size(others).alias("n"), "cand", "cand_place", "own_link", F.explode(others).alias("member"))
    alone = tried.where(F.size(others) == 0).select(*keys, "cand", "cand_place", F.col("own_link").alias("gain"))
    links = _links(edges, (*BASE, *OPTIONAL[: OPTIONAL.index(category)]), (category,))
    links = links.select(F.col("item_id").alias("member"), F.col("partner_id").alias("cand"), F.col("micro").alias("link"))
    met = member.join(links.hint("merge"), ["member", "cand"]).groupBy(*keys, "cand", "cand_place").agg(F.count("link").alias("met"), (F.sum("link") + F.first("own_link")).alias("gain"), F.first("n").alias("n"))
    best = met.where("met = n").select(alone.columns).unionByName(alone).groupBy(*keys).agg(F.min_by(F.struct("cand", "gain"), "cand_place").alias("best"))
    found = F.col("best").isNotNull()
    return outfits.join(best, keys, "left").select(
        "seed",
        "base_place",
        F.when(found, F.concat("items", F.array("best.cand"))).otherwise(F.col("items")).alias("items"),
        (F.col("total") + F.when(found, F.col("best.gain")).otherwise(0)).alias("total"),
        (F.col("added") + found.cast("int")).alias("added"),
    )


def assemble(seeds: DataFrame, edges: DataFrame, beam: int = 3, max_optional: int = 3) -> DataFrame:
    """(seed, items, score): outfits grown from seeds (item_id, category).

    A top starts with each of its first `beam` bottoms, a dress alone; other seeds give nothing. The score is the mean
    weight of all pairs, summed as integers; a dress without company has 0. Of outfits with the same items one stays. An item has the
    same category in seeds and edges. The edges are read more than once: pass a table. So are their ranked ones of tops and dresses
    and the outfits of each step, which are tables in the shared folder.
    """
    ranked = written(ranked_partners(edges, SEEDS), "ranked_partners")
    tops = seeds.where("category = 'top'").select(F.col("item_id").alias("seed"))
    bottoms = ranked.where((F.col("partner_category") == "bottom") & (F.col("place") <= max(1, beam))).select(F.col("item_id").alias("seed"), "partner_id", "place", "micro")
    first = tops.join(bottoms.hint("merge"), "seed").select("seed", F.col("place").alias("base_place"), F.array("seed", "partner_id").alias("items"), F.col("micro").alias("total"), F.lit(0).alias("added"))
    alone = seeds.where("category = 'dress'").select(F.col("item_id").alias("seed"), F.lit(1).alias("base_place"), F.array("item_id").alias("items"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("added"))
    grown = first.unionByName(alone)
    for category in OPTIONAL:
        grown = _extended(written(grown, "outfits"), ranked, edges, category, max_optional)
    pairs = F.size("items") * (F.size("items") - 1) / 2
    scored = grown.withColumn("score", F.when(pairs > 0, F.bround(F.col("total") / pairs / 1_000_000, 6)).otherwise(0.0))
    one = W.partitionBy(F.array_sort("items")).orderBy(F.desc("score"), "seed", "base_place")
    return scored.withColumn("rank", F.row_number().over(one)).where("rank = 1").select("seed", "items", "score")


def records(outfits: DataFrame, items: DataFrame) -> DataFrame:
    """outfits with outfit_id, price_total, tier and colors (sorted, distinct), from items (item_id, color, price)."""
    each = outfits.withColumn("outfit_id", stable_id(F.col("items"))).withColumn("item_id", F.explode("items"))
    by = each.join(items.select("item_id", "color", "price").hint("merge"), "item_id").groupBy("outfit_id", "seed", "items", "score")
    out = by.agg(F.sum("price").alias("price_total"), F.array_sort(F.collect_set("color")).alias("colors"))
    return out.withColumn("tier", outfit_tier(F.col("price_total")))


def search(found: DataFrame, price_max: int | None = None, exclude_colors: tuple[str, ...] = (), top_n: int = 40) -> DataFrame:
    """The first `top_n` records, by score and then items, both descending, within the price (inclusive) and without the colors."""
    if price_max is not None:
        found = found.where(F.col("price_total") <= price_max)
    if exclude_colors:
        found = found.where(~F.arrays_overlap("colors", F.array(*[F.lit(c.lower()) for c in exclude_colors])))
    return found.orderBy(F.desc("score"), F.desc("items")).limit(top_n)


def preference_score(score: Column, tier: Column, colors: Column, wanted_tier: str | None, favorite_colors: tuple[str, ...]) -> Column:
    """score, with 0.05 more if a favorite color is part of one of the colors and 0.10 less if the tier is another one."""
    liked = F.lit(False)
    for c in favorite_colors:
        needle = F.lit(c.lower())
        liked = liked | F.exists(colors, lambda x: F.contains(F.lower(x), needle))  # noqa: B023
    out = score + F.when(liked, 0.05).otherwise(0.0)
    return out if wanted_tier is None else out - F.when(tier != wanted_tier, 0.10).otherwise(0.0)
