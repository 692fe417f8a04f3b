"""Reading tables, and views of the generic star schema as catalog, links, requests and dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocab import CATEGORIES, FORMALITIES, GENDERS, SIZES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by keys to as many tasks as a shuffle has: a small file of narrow rows is read by few, which would make all wide rows of a view."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def item_id(key: Column) -> Column:
    """item_ and a key of six digits at least; format_string, which parses its pattern for each row, is left to keys below 0."""
    digits = key.cast("string")
    return F.when(key < 0, F.format_string("item_%06d", key)).otherwise(F.concat(F.lit("item_"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0"))))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, category, gender, formality, color, price."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        item_id(k).alias("item_id"),
        pick(CATEGORIES, k % 7).alias("category"),
        pick(GENDERS, F.col("p_size") % 4).alias("gender"),
        pick(FORMALITIES, F.floor(k / 7) % 4).alias("formality"),
        F.lower(F.substring_index("p_name", " ", 1)).alias("color"),
        (F.floor("p_retailprice").cast("bigint") * 50 * (1 + k % 40)).alias("price"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, store_id, price, in_stock, sizes: the offers of an item by store, from the order lines."""
    lines = table(spark, sf_dir, "lineitem")
    by = lines.groupBy(F.format_string("item_%06d", F.col("l_partkey")).alias("item_id"), F.format_string("store_%02d", F.col("l_suppkey") % 20).alias("store_id"))
    price = F.max(F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint") * 100)
    return by.agg(price.alias("price"), F.max((F.col("l_returnflag") != "R").cast("int")).cast("boolean").alias("in_stock"), F.sort_array(F.collect_set(pick(SIZES, F.col("l_linenumber") % 6))).alias("sizes"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, prompt (first user turn), answer (first assistant turn), turns."""
    t = table(spark, sf_dir, "conversations")
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return t.groupBy("conv_id").agg(first("user").alias("prompt"), first("assistant").alias("answer"), F.count("*").alias("turns"))


#: Words of the feed view below.
FEED_TITLES = ("Áo thun nam", "Áo khoác nữ", "Quần jeans", "Chân váy xòe", "Giày sneaker", "Túi tote da", "Đầm dạ hội", "Mũ len bé trai", "Quần lót", "Random thing", "Blazer công sở", "Oxford sơ mi", "Capri pants men women", "T-shirt unisex")
FEED_WORDS = ("đen", "xanh navy", "trang", "be kem", "", "Xám Nhạt", "do - polo")
FEED_TYPES = ("", "ak", "Áo Khoác", "  Giày   Loafer ", "nước hoa", "quần tây dài", "sq", "unknown", "Tops", "Túi xách")
FEED_STORES = ("rubies", "aristino_vn", "yody_vn", "dirtycoins")
FEED_TAGS = ("sport", "nữ", "sale", "loafer")
FEED_IMAGES = (".jpg?v=1", ".JPEG", ".png", ".webp?x", ".gif")
FEED_CENTS = ("", ".00", ".5")
FEED_COLORS = ("Đen", "Trắng", "đen", "Free size")
FEED_SIZES = ("S", "m", "XL", "39", "")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product feed of several stores, one row per part: pos, source_store_id and the optional fields of a feed."""
    k = F.col("p_partkey")
    text = k.cast("string")

    def variant(j: Column) -> Column:
        price = 20_000 + (k * 7919 + j * 1000) % 600_000
        return F.struct(
            F.when((j == 1) & (k % 3 == 0), "").otherwise(F.concat(F.lit("S"), text, F.lit("-"), j.cast("string"))).alias("sku"),
            F.concat(price.cast("string"), pick(FEED_CENTS, k % 3)).alias("price"),
            F.when(j % 2 == 0, (price + 10_000).cast("string")).alias("compare_at_price"),
            ((k + j) % 2 == 0).alias("available"),
            pick(FEED_COLORS, (k + j) % 4).alias("option1"),
            pick(FEED_SIZES, (k * j) % 5).alias("option2"),
            F.lit(None).cast("string").alias("option3"),
        )

    variants = F.filter(F.transform(F.array(*map(F.lit, (1, 2, 3))), variant), lambda v, i: i < k % 4)
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        k.alias("pos"),
        pick(FEED_STORES, k % 4).alias("source_store_id"),
        F.when(k % 7 != 0, F.concat(F.lit("p"), (k % 1500).cast("string"))).alias("id"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("h"), text)).alias("handle"),
        F.when(k % 4 == 0, F.concat(F.lit("http://o/x"), text)).when(k % 4 == 1, F.concat(F.lit("/products/u"), text, F.lit("/"))).when(k % 4 == 2, "").otherwise(F.concat(F.lit("u"), text)).alias("url"),
        F.when(k % 6 != 0, F.concat_ws(" ", pick(FEED_TITLES, k % 14), pick(FEED_WORDS, F.floor(k / 14) % 7))).alias("title"),
        F.concat(F.lit(" "), pick(FEED_TITLES, k % 14)).alias("name"),
        pick(FEED_TYPES, F.floor(k / 3) % 10).alias("product_type"),
        F.concat(F.lit("tag"), (k % 5).cast("string"), F.lit(" , "), pick(FEED_TAGS, F.floor(k / 5) % 4), F.lit(",")).alias("tags"),
        F.concat(F.lit("<p>Mô tả &amp; <b>x</b> "), text, F.lit("</p>")).alias("body_html"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("http://x/i"), text, pick(FEED_IMAGES, k % 5)))).alias("images"),
        variants.alias("variants"),
    )
