"""Column expressions of the catalog and of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.vocab import FORMALITIES, SIZES


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once a row however often `then` uses it: Spark writes a column out wherever it is used."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def to_int_price(raw: Column) -> Column:
    """A price as a whole number: "299,000", "299000.00" or 299000; null if it is none or not above 0."""
    number = F.bround(F.replace(raw, F.lit(","), F.lit("")).try_cast("double"))
    return F.when((number > 0) & (number < 1e18), number.cast("bigint"))


def domain(value: Column, allowed: tuple[str, ...], fallback: str | None) -> Column:
    """value if it is in the domain, else the fallback."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))


def item_tier(price: Column) -> Column:
    return F.when(price < 300_000, "budget").when(price <= 1_000_000, "mid").otherwise("premium")


def outfit_tier(price: Column) -> Column:
    return F.when(price < 300_000, "budget").when(price <= 800_000, "mid").otherwise("premium")


def formality_rank(value: Column) -> Column:
    """0 to 3; null if unknown."""
    return F.when(value.isin(*FORMALITIES), F.array_position(F.array(*map(F.lit, FORMALITIES)), value).cast("int") - 1)


def pair_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Compatibility of two items by formality (rank), colors (lower-case array) and price, between 0 and 1."""
    formality = F.when(a["rank"].isNull() | b["rank"].isNull(), 0.5).otherwise(1.0 - F.abs(a["rank"] - b["rank"]) / 3.0)
    color = F.when((F.size(a["colors"]) == 0) | (F.size(b["colors"]) == 0), 0.5).when(F.arrays_overlap(a["colors"], b["colors"]), 1.0).otherwise(0.4)
    high = F.greatest(a["price"], b["price"])
    price = F.when(high <= 0, 0.5).otherwise(F.try_divide(F.least(a["price"], b["price"]).cast("double"), high.cast("double")))
    return F.bround(F.least(F.greatest(0.4 * formality + 0.35 * color + 0.25 * price, F.lit(0.0)), F.lit(1.0)), 6)


def json_list(value: Column) -> Column:
    """The strings of a JSON list; malformed or other JSON gives an empty array, empty strings are dropped."""
    return F.coalesce(F.filter(F.from_json(value, "array<string>"), lambda x: x != ""), F.array().cast("array<string>"))


def stable_id(item_ids: Column) -> Column:
    """OF_ and the first eight digits of the name-based UUID (version 5, URL namespace) of the sorted ids."""
    name = F.array_join(F.array_sort(item_ids), "|")
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "utf-8")))
    return F.concat(F.lit("OF_"), F.substring(digest, 1, 8))


def strip_html(html: Column, limit: int = 600) -> Column:
    """Tags to blanks, common entities, white space collapsed, at most `limit` characters."""
    text = F.regexp_replace(html, r"<[^>]+>", " ")
    for name, value in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), 1, limit)


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), both.cast("double")))


def mixed_script(text: Column) -> Column:
    """Whether a text holds CJK, Cyrillic, Arabic or Devanagari characters."""
    return text.rlike("[一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿऀ-ॿ]")


def suggested_size(category: Column, gender: Column, height: Column, weight: Column, available: Column) -> Column:
    """Size by weight band and height, moved to the nearest available one, the smaller first; null if it can't be told."""

    def band(*limits: int) -> Column:
        out = F.lit(len(limits))
        for k in range(len(limits) - 1, -1, -1):
            out = F.when(weight < limits[k], k).otherwise(out)
        return out

    men, women = band(50, 60, 68, 78, 90), band(43, 49, 56, 63, 72)
    tall = F.when(gender == "men", F.when(height >= 182, 1).when(height < 162, -1).otherwise(0)).otherwise(F.when(height >= 172, 1).when(height < 150, -1).otherwise(0))
    want = F.least(F.greatest(F.when(gender == "men", men).otherwise(women) + tall, F.lit(0)), F.lit(len(SIZES) - 1))
    order = F.array(*map(F.lit, SIZES))
    places = F.filter(F.transform(available, lambda s: F.array_position(order, s).cast("int") - 1), lambda i: i >= 0)
    best = F.array_min(F.transform(places, lambda i: F.struct(F.abs(i - want).alias("d"), i.alias("i"))))
    fits = category.isin("top", "dress", "outerwear") & height.isNotNull() & weight.isNotNull()
    return F.when(fits, F.element_at(order, best["i"] + 1))
