"""Fields and scores of outfits, from a column of items: array<struct<item_id, category, gender, formality, colors, price, url, styles, body_shapes, seasons>>.

Missing arrays count as empty. All are built-in expressions over the array, so outfits need no exploding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.expressions import formality_rank, outfit_tier, stable_id
from weftline.functions.vocab import BODY_SHAPES, FORMALITIES, FORMALITY_OCCASIONS, FORMALITY_RELEVANT, FORMALITY_STYLES, SEASONS, STYLES

_NONE = "array<string>"


def _strings(values=()) -> Column:
    return F.array(*map(F.lit, values)).cast(_NONE)


def _each(items: Column, field: str) -> Column:
    return F.transform(items, lambda x: x[field])


def _all(items: Column, field: str) -> Column:
    """The values of an array field of all items."""
    return F.flatten(F.transform(items, lambda x: F.coalesce(x[field], _strings())))


def _lists(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    out = _strings()
    for k, values in table.items():
        out = F.when(key == k, _strings(values)).otherwise(out)
    return out


def split_by_domain(values: Column, allowed: tuple[str, ...]) -> Column:
    """struct<valid, invalid>: the values in and outside a domain, in order, repeats kept."""
    return F.struct(F.filter(values, lambda v: v.isin(*allowed)).alias("valid"), F.filter(values, lambda v: ~v.isin(*allowed)).alias("invalid"))


def occasions_for(formality: Column) -> Column:
    return _lists(FORMALITY_OCCASIONS, formality)


def formalities_for(occasion: Column) -> Column:
    """The formality bands that suit an occasion, the least formal first."""
    return F.filter(_strings(FORMALITIES), lambda f: F.array_contains(occasions_for(f), occasion))


def formality_span_ok(formalities: Column, tolerance: int = 1) -> Column:
    """Whether the known bands are at most `tolerance` apart."""
    ranks = F.filter(F.transform(formalities, formality_rank), lambda r: r.isNotNull())
    return F.coalesce(F.array_max(ranks) - F.array_min(ranks) <= tolerance, F.lit(True))


def _relevant(items: Column) -> Column:
    return F.filter(items, lambda x: x["category"].isin(*FORMALITY_RELEVANT))


def outfit_gender(items: Column) -> Column:
    """The one gender of the items besides unisex; unisex if there is none, null if they disagree."""
    told = F.array_distinct(F.filter(_each(items, "gender"), lambda g: g != "unisex"))
    return F.when(F.size(told) == 0, "unisex").when(F.size(told) == 1, F.get(told, F.lit(0)))


def is_coherent(items: Column) -> Column:
    return formality_span_ok(_each(_relevant(items), "formality"))


def is_valid_combo(items: Column) -> Column:
    return is_coherent(items) & outfit_gender(items).isNotNull()


def has_core(items: Column) -> Column:
    """Whether the items are a top, a bottom and shoes, or a dress and shoes."""
    has = lambda c: F.array_contains(_each(items, "category"), c)
    return has("shoes") & (has("dress") | (has("top") & has("bottom")))


def core_shape(categories: Column) -> Column:
    """top+bottom or dress, with +shoes; invalid for others or for both."""
    has = lambda c: F.array_contains(categories, c)
    shoes = F.when(has("shoes"), "+shoes").otherwise("")
    pair, dress = has("top") & has("bottom"), has("dress")
    return F.when(pair & ~dress, F.concat(F.lit("top+bottom"), shoes)).when(dress & ~has("top") & ~has("bottom"), F.concat(F.lit("dress"), shoes)).otherwise("invalid")


def outfit_occasions(items: Column) -> Column:
    """Occasions of the most formal of the garments that count, sorted; none without such a garment."""
    top = F.array_max(F.transform(_each(_relevant(items), "formality"), formality_rank))
    return F.coalesce(F.array_sort(occasions_for(F.element_at(_strings(FORMALITIES), top + 1))), _strings())


def outfit_styles(items: Column) -> Column:
    """Styles that the items' formality and their stores tell, sorted."""
    told = F.flatten(F.transform(items, lambda x: F.concat(_lists(FORMALITY_STYLES, x["formality"]), F.coalesce(x["styles"], _strings()))))
    return F.array_sort(F.array_intersect(told, _strings(STYLES)))


def outfit_colors(items: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(items, "colors")))


def _shared_tags(items: Column, field: str, order: tuple[str, ...]) -> Column:
    """Tags of the dresses if they have any; else those that all tagged main garments share, or have between them if they share none; in the order of the vocabulary."""

    def sets(*categories: str) -> Column:
        own = F.filter(items, lambda x: x["category"].isin(*categories) & (F.size(F.coalesce(x[field], _strings())) > 0))
        return F.transform(own, lambda x: x[field])

    dress, main = F.flatten(sets("dress")), sets("top", "bottom", "dress", "outerwear")
    shared = F.filter(F.flatten(main), lambda t: F.forall(main, lambda s: F.array_contains(s, t)))
    found = F.when(F.size(dress) > 0, dress).when(F.size(shared) > 0, shared).otherwise(F.flatten(main))
    return F.filter(_strings(order), lambda t: F.array_contains(found, t))


def outfit_body_shapes(items: Column) -> Column:
    return _shared_tags(items, "body_shapes", BODY_SHAPES)


def outfit_seasons(items: Column) -> Column:
    return _shared_tags(items, "seasons", SEASONS)


def price_total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["price"], F.lit(0).cast("bigint")))


def outfit_score(items: Column) -> Column:
    """A plain score between 0 and 1: core, price, repeated colors, links to stores, optional categories."""
    total = price_total(items)
    colors = F.transform(F.filter(_all(items, "colors"), lambda c: c != ""), lambda c: F.lower(c))
    repeated = F.size(colors) - F.size(F.array_distinct(colors))
    # fixed values: the weights and limits of the score
    score = F.when(has_core(items), 0.35).otherwise(0.05)
    score = score + F.when(total.between(300_000, 1_800_000), 0.20).when(total.between(150_000, 3_000_000), 0.10).otherwise(0.0)
    score = score + F.when(F.size(colors) > 0, F.least(F.lit(0.15), repeated * 0.05) + 0.05).otherwise(0.0)
    linked = F.size(F.filter(items, lambda x: F.coalesce(x["url"], F.lit("")) != ""))
    score = score + 0.15 * (linked / F.greatest(F.size(items), F.lit(1)))
    optional = F.size(F.array_intersect(_each(items, "category"), _strings(("outerwear", "bag", "accessory"))))
    score = score + F.least(F.lit(0.10), optional * 0.04)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(score, 6)))


def outfit_record(items: Column, score: Column) -> list[Column]:
    """The columns of an outfit record."""
    total = price_total(items)
    return [
        stable_id(_each(items, "item_id")).alias("outfit_id"),
        _each(items, "item_id").alias("item_ids"),
        _each(items, "category").alias("categories"),
        outfit_gender(items).alias("gender"),
        outfit_occasions(items).alias("occasions"),
        outfit_styles(items).alias("styles"),
        outfit_body_shapes(items).alias("body_shapes"),
        outfit_seasons(items).alias("seasons"),
        outfit_colors(items).alias("colors"),
        total.alias("price_total"),
        outfit_tier(total).alias("price_tier"),
        F.forall(items, lambda x: F.coalesce(x["url"], F.lit("")) != "").alias("has_store"),
        F.bround(score, 6).alias("score"),
    ]


def preference(record: dict[str, Column], styles=(), occasions=(), colors=(), tier: str | None = None) -> Column:
    """Score of a record for a taste: 0.10 for each style and occasion, 0.05 for each color that is part of one of the outfit's, 0.10 less for another price tier."""
    out = record["score"]
    for field, wanted in (("styles", styles), ("occasions", occasions)):
        for w in wanted:
            out = out + F.when(F.array_contains(record[field], w), 0.10).otherwise(0.0)
    for c in colors:
        needle = F.lit(c.lower())
        out = out + F.when(F.exists(record["colors"], lambda x: F.contains(F.lower(x), needle)), 0.05).otherwise(0.0)  # noqa: B023
    return out if tier is None else out - F.when(record["price_tier"] != tier, 0.10).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets, 3 decimals: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.bround(F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1))), 3)


def mean_vector(vectors: Column) -> Column:
    """Element means of the vectors that are not empty, as long as the shortest; an empty array without any."""
    some = F.filter(vectors, lambda v: v.isNotNull() & (F.size(v) > 0))
    width = F.array_min(F.transform(some, lambda v: F.size(v)))
    places = F.sequence(F.lit(1), width)
    mean = F.transform(places, lambda i: F.aggregate(some, F.lit(0.0), lambda s, v: s + F.element_at(v, i).cast("double")) / F.size(some))
    return F.when(F.size(some) > 0, mean).otherwise(F.array().cast("array<double>"))
