"""From a store's raw products to catalog and link rows: fields, prices, categories, genders, formality, colors, sizes, ids.

A raw product has source_store_id, source_product_id, handle, title, vendor, product_type, tags (array), description_html,
images (array), variants (array of sku, price, compare_at_price, available, option1, option2, option3), product_url.
Null fields count as empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import taxonomy as tx
from weftline.functions.expressions import free_name, once, strip_html, to_int_price
from weftline.sources.shared import written

PRICE_MIN, PRICE_MAX = 30_000, 50_000_000
ITEM_PREFIX = "item_custom_"
VARIANTS = "array<struct<sku:string,price:string,compare_at_price:string,available:boolean,option1:string,option2:string,option3:string>>"
IMAGE_DIR = "data/custom/catalog/images/"
#: Feed positions that are numbered by one task.
FEED_RANGE = 1 << 16
SPACE = r"[ \t\n\x0B\f\r\x{85}\x{A0}]+"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def has_any(text: Column, markers) -> Column:
    """Whether a text holds one of the markers."""
    return F.coalesce(text.rlike("|".join(re.escape(m).replace("\\ ", " ") for m in markers)), F.lit(False))


def _has_word(words: Column, wanted) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, wanted)))


def hyphened_tokens(text: Column) -> Column:
    """Lower-case words, hyphens inside them kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_\-]+"), F.lit(0))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def raw_products(feed: DataFrame, website: Column) -> DataFrame:
    """Raw products from feed rows whose optional string columns are those of a product feed: id, handle, alias, url, title, name, vendor, product_type, tags (array, or a list with commas), body_html, content, summary, images (array), variants; source_store_id is kept."""

    def first(*names: str) -> Column:
        there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in feed.columns]
        return F.coalesce(*there, F.lit(""))

    url = F.trim(first("url"))
    handle = F.trim(first("handle", "alias"))
    handle = F.when(handle == "", F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)).otherwise(handle)
    absolute = url.startswith("http://") | url.startswith("https://")
    link = F.when(absolute, url).when(url.startswith("/"), F.concat(website, url)).when(handle != "", F.concat(website, F.lit("/products/"), handle)).otherwise("")
    tags = F.col("tags") if "array" in feed.schema["tags"].dataType.typeName() else F.filter(F.transform(F.split(_text(F.col("tags")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return feed.select(
        "source_store_id",
        F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), handle).alias("source_product_id"),
        handle.alias("handle"),
        F.trim(first("title", "name")).alias("title"),
        F.trim(first("vendor")).alias("vendor"),
        F.trim(first("product_type")).alias("product_type"),
        tags.alias("tags"),
        first("body_html", "content", "summary").alias("description_html"),
        F.filter("images", lambda i: i != "").alias("images"),
        "variants",
        link.alias("product_url"),
    )


def min_price(variants: Column) -> Column:
    return F.array_min(F.filter(F.transform(variants, lambda v: to_int_price(v["price"])), lambda p: p.isNotNull()))


def min_sale_price(variants: Column) -> Column:
    """The lowest price that is below the price it is compared with."""
    pairs = F.transform(variants, lambda v: F.struct(to_int_price(v["price"]).alias("p"), to_int_price(v["compare_at_price"]).alias("c")))
    return F.array_min(F.transform(F.filter(pairs, lambda x: x["p"] < x["c"]), lambda x: x["p"]))


def any_in_stock(variants: Column) -> Column:
    """Whether a variant is in stock; a product without variants is."""
    return (F.size(F.coalesce(variants, F.array().cast(VARIANTS))) == 0) | F.exists(variants, lambda v: F.coalesce(v["available"], F.lit(False)))


def primary_sku(variants: Column) -> Column:
    return _text(F.get(F.filter(F.transform(variants, lambda v: F.trim(_text(v["sku"]))), lambda s: s != ""), F.lit(0)))


def looks_like_size(value: Column) -> Column:
    return (value != "") & (F.lower(value).rlike("size|kích|free") | value.rlike(r"^[XSMLxsml0-9.\-/ ]{1,8}$"))


def _options(variants: Column) -> Column:
    """array<struct<value, available>> of the options of all variants, in order."""

    def own(v: Column) -> Column:
        stock = F.coalesce(v["available"], F.lit(False)).alias("available")
        return F.array(*[F.struct(F.trim(_text(v[k])).alias("value"), stock) for k in ("option1", "option2", "option3")])

    return F.filter(F.flatten(F.transform(F.coalesce(variants, F.array().cast(VARIANTS)), own)), lambda o: o["value"] != "")


def text_colors(text: Column) -> Column:
    """Colors that a lower-case text names, at most eight."""

    def named(text: Column) -> Column:
        return F.array(*[F.when(text.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(names)})($|[^\p{{L}}\p{{N}}_])"), F.lit(color)) for color, names in tx.COLOR_NAMES])

    return F.slice(F.array_distinct(F.filter(once(text, named), lambda c: c.isNotNull())), 1, 8)


def product_colors(variants: Column, text: Column) -> Column:
    """Colors of the options that are no sizes, then those a lower-case text names, without regard to case, at most eight."""
    options = F.transform(F.filter(_options(variants), lambda o: ~looks_like_size(o["value"])), lambda o: o["value"])

    def distinct(both: Column) -> Column:
        return once(F.transform(both, lambda c: F.lower(c)), lambda low: F.filter(both, lambda c, i: F.array_position(low, F.lower(c)) == i + 1))

    return F.slice(once(F.concat(options, text_colors(text)), distinct), 1, 8)


def product_sizes(variants: Column, in_stock: bool = False) -> Column:
    """Sizes in capitals, in the order of their first appearance; those in stock alone if asked for."""
    sizes = F.filter(_options(variants), lambda o: looks_like_size(o["value"]) & (o["available"] if in_stock else F.lit(True)))
    return F.array_distinct(F.transform(sizes, lambda o: F.upper(o["value"])))


def image_extension(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"(?i)\.(jpe?g|png|webp)(?:\?|$)", 1))
    return F.when(found == "", ".jpg").otherwise(F.concat(F.lit("."), F.replace(found, F.lit("jpeg"), F.lit("jpg"))))


def _first_category(words: Column) -> Column:
    """The category of the first word, or two words, that tells one."""
    pair, head, english = (_map(tx.lookup(t)) for t in (tx.COMPOUNDS, tx.HEAD_NOUNS, tx.ENGLISH_WORDS))

    def first(words: Column) -> Column:
        each = F.transform(words, lambda w, i: F.coalesce(pair[F.concat_ws(" ", w, F.get(words, i + 1))], head[w], english[w]))
        return F.get(F.filter(each, lambda c: c.isNotNull()), F.lit(0))

    return once(words, first)


def title_category(title: Column, product_type: Column, tags: Column) -> Column:
    """Category by words of the title, then the type, then the tags; null if out of scope or unknown."""
    low = F.lower(_text(title))
    out = has_any(low, tx.OUT_OF_SCOPE_TITLES) | _has_word(hyphened_tokens(low), tx.OUT_OF_SCOPE_WORDS)
    sources = (_text(title), _text(product_type), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))
    return F.when(~out, F.coalesce(*[_first_category(hyphened_tokens(s)) for s in sources]))


def store_category(product_type: Column, store: Column) -> Column:
    """Category by the store's product type, "drop" if out of scope, null if it tells nothing."""

    def told(kind: Column) -> Column:
        own = [F.when(store == s, _map(tx.lookup(t))[kind]) for s, t in tx.STORE_TYPES.items()]
        dropped = F.when(kind.isin(*tx.DROPPED_TYPES) | has_any(kind, tx.DROPPED_MARKERS), F.lit(tx.DROP))
        parts = [F.when(has_any(kind, listed), F.lit(category)) for category, listed in tx.TYPE_KEYWORDS]
        return F.when(kind != "", F.coalesce(*own, dropped, _map(tx.lookup(tx.PRODUCT_TYPES))[kind], *parts))

    return once(F.lower(F.trim(F.regexp_replace(_text(product_type), SPACE, " "))), told)


def resolve_category(title: Column, product_type: Column, tags: Column, store: Column) -> Column:
    """Category by the store's type, else by the title; null drops the product."""
    return once(store_category(product_type, store), lambda by_store: F.when(by_store == tx.DROP, F.lit(None)).otherwise(F.coalesce(by_store, title_category(title, product_type, tags))))


def infer_gender(title: Column, product_type: Column, store: Column, category: Column) -> Column:
    default = F.coalesce(_map(tx.STORE_GENDERS)[store], F.lit("unisex"))

    def told(text: Column, words: Column) -> Column:
        women = _has_word(words, tx.WOMEN_WORDS) | has_any(text, tx.WOMEN_MARKERS)
        men = _has_word(words, tx.MEN_WORDS)
        return (
            F.when(has_any(text, tx.KID_MARKERS) | _has_word(words, tx.KID_WORDS), "kid")
            .when(F.contains(text, F.lit("unisex")) | (men & women), "unisex")
            .when(men, "men")
            .when(women | F.coalesce(category == "dress", F.lit(False)) | has_any(text, tx.WOMEN_GARMENTS), "women")
            .otherwise(default)
        )

    return once(F.lower(F.concat_ws(" ", _text(title), _text(product_type))), lambda text: once(hyphened_tokens(text), lambda words: told(text, words)))


def infer_formality(title: Column, product_type: Column, tags: Column) -> Column:
    text = F.lower(F.concat_ws(" ", _text(title), _text(product_type), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))

    def told(text: Column) -> Column:
        out = F.lit("casual")
        for band, markers in reversed(tx.FORMALITY_MARKERS):
            out = F.when(has_any(text, markers), band).otherwise(out)
        return out

    return once(text, told)


def numbered(rows: DataFrame, position: str, name: str, start: int = 1) -> DataFrame:
    """rows with consecutive numbers in the order of a column of positions, counted by ranges of it so that no task sees all rows."""
    part, before = free_name(rows, "part"), free_name(rows, "before")
    marked = rows.withColumn(part, F.floor(F.col(position) / FEED_RANGE))
    sizes = marked.groupBy(part).agg(F.count("*").alias(before))
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = marked.join(sizes, part).withColumn(name, F.col(before) + F.row_number().over(W.partitionBy(part).orderBy(position)) + (start - 1))
    return placed.drop(part, before)


def max_index(item_ids: DataFrame, prefix: str = ITEM_PREFIX) -> DataFrame:
    """(max_index): the largest number behind the prefix in a column item_id, 0 without one."""
    number = F.expr(f"try_cast(regexp_extract(item_id, '^{prefix}([0-9]+)$', 1) as bigint)")
    return item_ids.agg(F.coalesce(F.max(number), F.lit(0)).alias("max_index"))


def link_map(links: DataFrame, position: str) -> DataFrame:
    """(store_id, source_product_id, item_id) of links in the order of a position: of each pair the last; null ids are left out."""
    some = links.where("source_product_id is not null")
    return some.groupBy("store_id", "source_product_id").agg(F.max_by("item_id", position).alias("item_id"))


def normalize_products(raws: DataFrame, position: str, known: DataFrame, start_index: int = 1, collected: str = "1970-01-01", collector: str = "feed") -> DataFrame:
    """Catalog and link columns of the raw products that have an image, a category and a plausible price.

    `known` (store_id, source_product_id, item_id) gives ids of products seen before; others get the next free ones in
    the order of `position`, the same product the same one.
    """
    text = F.lower(F.concat_ws(" ", *[F.when(F.trim(_text(c)) != "", c) for c in (F.col("title"), F.col("product_type"))], "tags"))
    rows = raws.select(
        "*",
        resolve_category(F.col("title"), F.col("product_type"), F.col("tags"), F.col("source_store_id")).alias("category"),
        min_price(F.col("variants")).alias("price_vnd"),
    ).where((F.size("images") > 0) & F.col("category").isNotNull() & F.col("price_vnd").between(PRICE_MIN, PRICE_MAX))
    image = F.element_at("images", 1)
    # all that takes time is worked out once a row, before the rows are dealt out by product
    rows = written(
        rows.select(
            F.col(position).alias("_at"),
            "category",
            _text(F.col("product_type")).alias("source_product_type"),
            infer_gender(F.col("title"), F.col("product_type"), F.col("source_store_id"), F.col("category")).alias("gender"),
            infer_formality(F.col("title"), F.col("product_type"), F.col("tags")).alias("formality"),
            image_extension(image).alias("_extension"),
            image.alias("image_url"),
            F.col("title").alias("title_vi"),
            strip_html(_text(F.col("description_html"))).alias("desc_vi"),
            product_colors(F.col("variants"), text).alias("colors"),
            F.col("source_store_id").alias("store_id"),
            "source_product_id",
            "product_url",
            "price_vnd",
            min_sale_price(F.col("variants")).alias("sale_price_vnd"),
            primary_sku(F.col("variants")).alias("sku"),
            any_in_stock(F.col("variants")).alias("in_stock"),
            product_sizes(F.col("variants")).alias("available_sizes"),
            product_sizes(F.col("variants"), True).alias("sizes_in_stock"),
        ),
        "products",
    )
    keys = ["store_id", "source_product_id"]
    seen = known.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("item_id").alias("_known"))
    rows = rows.join(seen, (F.col("store_id") == F.col("_k_store_id")) & (F.col("source_product_id") == F.col("_k_source_product_id")), "left").drop("_k_store_id", "_k_source_product_id")
    new = rows.where("_known is null").groupBy(*keys).agg(F.min("_at").alias("first_at"))
    new = numbered(new, "first_at", "number", start_index).select(*keys, F.concat(F.lit(ITEM_PREFIX), F.lpad(F.col("number").cast("string"), 5, "0")).alias("_new"))
    rows = rows.join(new, keys, "left").withColumn("item_id", F.coalesce("_known", "_new"))
    return rows.select(
        "item_id",
        "category",
        "source_product_type",
        "gender",
        "formality",
        F.concat(F.lit(IMAGE_DIR), "item_id", "_extension").alias("image_path"),
        "image_url",
        "title_vi",
        "desc_vi",
        "colors",
        F.lit(collected).alias("collected_date"),
        F.lit(collector).alias("collector"),
        "store_id",
        "source_product_id",
        "product_url",
        "price_vnd",
        "sale_price_vnd",
        "sku",
        "in_stock",
        "available_sizes",
        "sizes_in_stock",
    )


def retag(catalog: DataFrame, links: DataFrame, raws: DataFrame, position: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, links, transitions) after categories and genders are told anew from the raw products.

    The raw product of an item is that of its first link. Items without a category any more are dropped with their
    links; transitions counts (column, change as "old -> new").
    """
    first = links.groupBy("item_id").agg(F.min_by(F.struct("store_id", "source_product_id"), position).alias("l")).select("item_id", "l.store_id", "l.source_product_id")
    raw = raws.select(F.col("source_store_id").alias("store_id"), "source_product_id", "title", "product_type", "tags").dropDuplicates(["store_id", "source_product_id"])
    raw = raw.select("store_id", "source_product_id", F.struct("title", "product_type", "tags").alias("raw"))
    rows = catalog.join(first, "item_id", "left").join(raw, ["store_id", "source_product_id"], "left")
    found = F.col("raw").isNotNull()
    category = F.when(found, resolve_category(F.col("raw.title"), F.col("raw.product_type"), F.col("raw.tags"), F.col("store_id"))).otherwise(F.col("category"))
    rows = rows.withColumn("new_category", category)
    gender = F.when(found, infer_gender(F.col("raw.title"), F.col("raw.product_type"), F.col("store_id"), F.col("new_category"))).otherwise(F.col("gender"))
    rows = rows.withColumn("new_gender", gender)
    changes = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("old"), F.coalesce(F.col(f"new_{c}"), F.lit("none")).alias("new")) for c in ("category", "gender")])
    moved = rows.select(F.explode(F.filter(changes, lambda x: ~x["old"].eqNullSafe(x["new"]))).alias("x"))
    transitions = moved.groupBy("x.column", F.concat_ws(" -> ", "x.old", "x.new").alias("change")).agg(F.count("*").alias("n"))
    kept = rows.where("new_category is not null")
    kept = kept.select(*[F.col(f"new_{c}").alias(c) if c in ("category", "gender") else F.col(c) for c in catalog.columns])
    return kept, links.join(kept.select("item_id"), "item_id", "left_semi"), transitions


# fixed values: what product pages, their prices and their meta fields look like
PRODUCT_PATH = r"/products?/|/[a-z0-9-]+(?:-[a-z]{1,4}[0-9]{2,}|-[0-9]{4,}|z[0-9]{5,})$"
PRICE_IN_DATA = r'''(?i)(?:sale_price|original_price|price|final_price|retail_price)"?\s*[:=]\s*"?([0-9]{5,9})(?:\.0+)?"?'''
PRICE_SHOWN = r"(?iu)([0-9]{2,3}(?:[.,][0-9]{3}){1,2})\s*(?:đ|VND|VNĐ)"
META_FIELD = r"""(?i)<meta\s+[^>]*(?:property|name)=["'](og:[^"']+|twitter:[^"']+)["'][^>]*content=["']([^"']*)["'][^>]*>"""


def sitemap_locations(xml: Column) -> Column:
    """array<string>: the addresses in a sitemap."""
    return F.transform(F.regexp_extract_all(_text(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: unescape(u))


def unescape(text: Column) -> Column:
    """The entities that addresses and titles hold."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def product_pages(sitemaps: DataFrame, xml: str, website: str) -> DataFrame:
    """(loc, image_url, image_title) of the product pages in sitemaps of a website, each address once."""
    block = F.explode(F.regexp_extract_all(_text(F.col(xml)), F.lit(r"(?is)<url>.*?</url>"), F.lit(0)))

    def inner(tag: str) -> Column:
        return F.nullif(F.regexp_extract("block", rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1), F.lit(""))

    host = re.sub(r"^\w+://", "", website).split("/")[0].replace("www.", "")
    rows = sitemaps.select(block.alias("block")).select(unescape(inner("loc")).alias("loc"), unescape(inner("image:loc")).alias("image_url"), unescape(F.trim(F.regexp_replace(F.regexp_replace(inner("image:title"), "<[^>]+>", " "), r"\s+", " "))).alias("image_title"))
    path = F.lower(F.regexp_extract("loc", r"^\w+://[^/?#]*([^?#]*)", 1))
    own = F.contains(F.replace(F.regexp_extract("loc", r"^\w+://([^/?#]*)", 1), F.lit("www."), F.lit("")), F.lit(host))
    likely = path.rlike(PRODUCT_PATH)
    return rows.where(own & likely).groupBy("loc").agg(F.min_by(F.struct("image_url", "image_title"), F.struct(F.col("image_url").isNull(), "image_url", "image_title")).alias("x")).select("loc", "x.*")


def page_price(html: Column) -> Column:
    """The least plausible price of a page: one in its data, else one that is displayed."""

    def least(found: Column) -> Column:
        numbers = F.transform(found, lambda n: F.regexp_replace(n, "[.,]", "").cast("bigint"))
        return F.array_min(F.filter(numbers, lambda n: n.between(PRICE_MIN, PRICE_MAX)))

    data = F.regexp_extract_all(_text(html), F.lit(PRICE_IN_DATA), F.lit(1))
    shown = F.regexp_extract_all(_text(html), F.lit(PRICE_SHOWN), F.lit(1))
    return F.coalesce(least(data), least(shown))


def html_products(pages: DataFrame, store_id: Column, vendor: Column, url: str = "url", html: str = "html") -> DataFrame:
    """Raw products from product pages: title, description and image from their meta fields (of a repeated one the last), the price by page_price; pages without title, image or price are left out.

    Optional columns image_url and image_title (from a sitemap) come first.
    """
    keys, values = (F.regexp_extract_all(_text(F.col(html)), F.lit(META_FIELD), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(F.transform(keys, lambda x: F.lower(x)).alias("k"), F.transform(values, lambda x: unescape(F.trim(x))).alias("v"))
    rows = pages.withColumn("metas", pairs).withColumn("price", page_price(F.col(html)))

    def field(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("metas", lambda m: m["k"] == n), lambda m: m["v"])), -1), F.lit("")) for n in names])  # noqa: B023

    told = {c: F.nullif(F.col(c), F.lit("")) if c in pages.columns else F.lit(None).cast("string") for c in ("image_url", "image_title")}
    handle = F.substring_index(F.regexp_replace(F.regexp_extract(F.col(url), r"^\w+://[^/?#]*([^?#]*)", 1), "/+$", ""), "/", -1)
    rows = rows.select("*", handle.alias("page_handle"), F.coalesce(told["image_title"], field("og:title", "twitter:title")).alias("page_title"), F.coalesce(told["image_url"], field("og:image", "twitter:image")).alias("page_image"), _text(field("og:description", "twitter:description")).alias("page_text"))
    none = F.lit(None).cast("string")
    variant = F.struct(F.col("page_handle").alias("sku"), F.col("price").cast("string").alias("price"), none.alias("compare_at_price"), F.lit(True).alias("available"), *[none.alias(f"option{k}") for k in (1, 2, 3)])
    return rows.where("page_title is not null and page_image is not null and price is not null").select(
        store_id.alias("source_store_id"),
        F.col("page_handle").alias("source_product_id"),
        F.col("page_handle").alias("handle"),
        F.trim("page_title").alias("title"),
        vendor.alias("vendor"),
        F.lit("").alias("product_type"),
        F.array().cast("array<string>").alias("tags"),
        F.col("page_text").alias("description_html"),
        F.array("page_image").alias("images"),
        F.array(variant).alias("variants"),
        F.col(url).alias("product_url"),
    )


def backfill_sizes(links: DataFrame, found: DataFrame) -> DataFrame:
    """links whose available_sizes is empty get those found (item_id, sizes, sizes_stock), in capitals, each once."""

    def clean(sizes: str) -> Column:
        return F.array_distinct(F.filter(F.transform(sizes, lambda s: F.upper(F.trim(s))), lambda s: s != ""))

    new = found.select(F.col("item_id").alias("f_item"), clean("sizes").alias("f_sizes"), clean("sizes_stock").alias("f_stock"))
    fits = (F.size("available_sizes") == 0) & F.col("f_item").isNotNull() & (F.size("f_sizes") > 0)
    rows = links.join(new, F.col("item_id") == F.col("f_item"), "left")
    swapped = {"available_sizes": "f_sizes", "sizes_in_stock": "f_stock"}
    return rows.select(*[F.when(fits, F.col(swapped[c])).otherwise(F.col(c)).alias(c) if c in swapped else F.col(c) for c in links.columns])

