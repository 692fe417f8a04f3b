"""Recommending: seeds for a request, search over outfit records, rerank for a taste, sizes for the best; and reports on outfits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import formality_rank, suggested_size
from weftline.functions.vocab import FORMALITY_RELEVANT, GENDERS, PRICE_TIERS
from weftline.operators import outfits as assembly
from weftline.operators import tags
from weftline.operators.metrics import nearest_rank
from weftline.operators.tags import formalities_for
from weftline.sources.shared import written
from weftline.sources.tables import dealt

#: Outfits of a class that the first pass of a search looks at, and how many times more each next pass does.
FIRST_LOOK, MORE = 256, 8
#: Parts of a class that tasks look at apart from each other.
SPREAD = 32


def seeds(requests: DataFrame, items: DataFrame) -> DataFrame:
    """(request_id, item_id): for each request (request_id, occasion, gender or null) the tops and dresses in stock with a link that suit it. Requests are few, so they are sent to the items."""
    fits = items.where(F.col("category").isin("top", "dress") & F.col("in_stock") & (F.coalesce("url", F.lit("")) != ""))
    wanted = requests.select("request_id", F.col("gender").alias("wanted_gender"), F.explode(formalities_for(F.col("occasion"))).alias("formality"))
    both = fits.join(wanted, "formality").where("wanted_gender is null or gender = wanted_gender or gender = 'unisex'")
    return both.select("request_id", "item_id")


def evaluation_seeds(items: DataFrame, occasion: str | None, limit: int = 0) -> DataFrame:
    """(item_id) of tops and dresses that suit an occasion, by id; all of them for a limit of 0."""
    rows = items.where(F.col("category").isin("top", "dress"))
    if occasion is not None:
        rows = rows.where(F.array_contains(formalities_for(F.lit(occasion)), F.col("formality")))
    rows = rows.select("item_id").orderBy("item_id")
    return rows.limit(limit) if limit else rows


def search(found: DataFrame, requests: DataFrame, top_n: int = 40) -> DataFrame:
    """For each request its first `top_n` records, with retrieval_rank: by score, then items, both descending.

    found: records with request_id; requests: request_id, price_max (inclusive), exclude_colors (lower case) and style, each or null.
    """
    rules = requests.select("request_id", "price_max", "exclude_colors", "style")
    both = found.join(rules, "request_id")
    low = F.transform("colors", lambda c: F.lower(c))
    fits = F.col("price_max").isNull() | (F.col("price_total") <= F.col("price_max"))
    fits = fits & ~F.coalesce(F.arrays_overlap(low, F.col("exclude_colors")), F.lit(False))
    fits = fits & (F.col("style").isNull() | F.array_contains("styles", F.col("style")))
    order = W.partitionBy("request_id").orderBy(F.desc("score"), F.desc("item_ids"))
    ranked = both.where(fits).withColumn("retrieval_rank", F.row_number().over(order))
    return ranked.where(F.col("retrieval_rank") <= top_n).drop("price_max", "exclude_colors", "style")


def wanted_seeds(requests: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, category, formality, gender) of the tops and dresses in stock with a link that suit any of the requests, each once: the bands that the requests' occasions allow are at most four."""
    bands = requests.select(F.explode(formalities_for(F.col("occasion"))).alias("formality")).distinct()
    fits = items.where(F.col("category").isin("top", "dress") & F.col("in_stock") & (F.coalesce("url", F.lit("")) != ""))
    return fits.join(F.broadcast(bands), "formality", "left_semi").select("item_id", "category", "formality", "gender")


def search_classes(found: DataFrame, requests: DataFrame, top_n: int = 40, first: int = FIRST_LOOK) -> DataFrame:
    """For each request its first `top_n` records as `search` gives them, without all pairs of requests and records.

    found: records with formality and seed_gender of their seed; requests: request_id, occasion, gender (or null: any),
    price_max, exclude_colors, style.
    """
    asked, hits, found = search_rules(found, requests, top_n, first)
    own = asked.select("request_id", "_rule").join(hits, "_rule")
    return own.join(found.hint("merge"), "_row").drop("_row", "_rule")


def search_rules(found: DataFrame, requests: DataFrame, top_n: int = 40, first: int = FIRST_LOOK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests with _rule, hits (_rule, _row, retrieval_rank), found with _row): each different rule is searched once, whatever the number of requests that share it.

    A rule is what a request asks for. A record's class is its seed's formality and gender, sixteen at most; a rule looks
    into the classes that suit it. Each pass gives it the `first` best of each class by score and items, the next one MORE
    times as many, until top_n records are found that stand before all that the classes still hold back, or nothing is
    held back. Only the columns that the rules look at go through the passes.
    """
    order = [F.desc("score"), F.desc("item_ids")]
    asked = written(requests.withColumn("_asks", F.struct("occasion", "gender", "price_max", "exclude_colors", "style")), "asked")
    rules = written(asked.select("_asks").distinct().withColumn("_rule", F.monotonically_increasing_id()), "rules")
    asked = asked.join(rules, "_asks").drop("_asks")
    genders = F.when(F.col("gender").isNull(), F.array(*map(F.lit, GENDERS))).otherwise(F.array_distinct(F.array("gender", F.lit("unisex"))))
    wants = rules.select("_rule", "_asks.*").select("_rule", "price_max", "exclude_colors", "style", F.explode(formalities_for(F.col("occasion"))).alias("formality"), genders.alias("genders"))
    left = written(wants.select("_rule", "price_max", "exclude_colors", "style", "formality", F.explode("genders").alias("seed_gender")), "wants")
    found, done, look = written(found.withColumn("_row", F.monotonically_increasing_id()), "found"), None, first
    slim = found.select("_row", "formality", "seed_gender", "score", "item_ids", "price_total", "styles", F.transform("colors", lambda c: F.lower(c)).alias("low"))
    place = F.row_number().over(W.partitionBy("formality", "seed_gender").orderBy(*order))
    placed = written(slim.withColumn("_place", place), "placed")
    while True:
        # the first that is not looked at tells what is held back
        held = placed.where(F.col("_place") == look + 1).select("formality", "seed_gender", F.struct("score", "item_ids").alias("next"))
        limit = left.join(F.broadcast(held), ["formality", "seed_gender"]).groupBy("_rule").agg(F.max("next").alias("limit"))
        # a rule meets each part of a class; neither side is sent out whole
        block = placed.where(F.col("_place") <= look).withColumn("_part", F.col("_place") % SPREAD)
        both = block.hint("merge").join(left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["formality", "seed_gender", "_part"])
        fits = F.col("price_max").isNull() | (F.col("price_total") <= F.col("price_max"))
        fits = fits & ~F.coalesce(F.arrays_overlap("low", "exclude_colors"), F.lit(False))
        fits = fits & (F.col("style").isNull() | F.array_contains("styles", F.col("style")))
        ranked = both.where(fits).select("_rule", "_row", "score", "item_ids").withColumn("retrieval_rank", F.row_number().over(W.partitionBy("_rule").orderBy(*order)))
        ranked = written(ranked.where(F.col("retrieval_rank") <= top_n), "ranked")
        sure = ranked.join(limit, "_rule", "left").where(F.col("limit").isNull() | (F.struct("score", "item_ids") > F.col("limit")))
        # open: something is held back, and fewer than top_n stand before it
        open_ = limit.join(sure.groupBy("_rule").agg(F.count("*").alias("n")), "_rule", "left").where(F.coalesce("n", F.lit(0)) < top_n).select("_rule")
        open_ = written(open_, "open")
        now = ranked.join(open_, "_rule", "left_anti").select("_rule", "_row", "retrieval_rank")
        done = now if done is None else done.unionByName(now)
        if open_.isEmpty():
            return asked, done, found
        left, look = written(left.join(open_, "_rule", "left_semi"), "wants"), look * MORE


def taste(record: dict[str, Column], quiz: dict[str, Column]) -> Column:
    """tags.preference for answers that are columns: styles, occasions and colors (arrays) and tier; null answers count as none."""
    out = record["score"]
    for field in ("styles", "occasions"):
        out = out + F.coalesce(F.size(F.filter(quiz[field], lambda w: F.array_contains(record[field], w))), F.lit(0)) * 0.10  # noqa: B023
    liked = F.filter(quiz["colors"], lambda c: F.exists(record["colors"], lambda x: F.contains(F.lower(x), F.lower(c))))
    out = out + F.coalesce(F.size(liked), F.lit(0)) * 0.05
    return out - F.when(quiz["tier"].isNotNull() & (record["price_tier"] != quiz["tier"]), 0.10).otherwise(0.0)


def outfit_sizes(items: Column, height: Column, weight: Column) -> Column:
    """array<struct<item_id, size>>: the items whose size can be told, from the sizes in stock, else all sizes."""
    each = F.transform(items, lambda x: F.struct(x["item_id"].alias("item_id"), suggested_size(x["category"], x["gender"], height, weight, F.when(F.size(x["sizes_in_stock"]) > 0, x["sizes_in_stock"]).otherwise(x["available_sizes"])).alias("size")))
    return F.filter(each, lambda x: x["size"].isNotNull())


def recommend(requests: DataFrame, items: DataFrame, edges: DataFrame, top_n: int = 40, top_k: int = 5) -> DataFrame:
    """Outfits for many requests in one plan: seeds, assembly, search, rerank, sizes of the first.

    requests: request_id, occasion, gender, price_max, exclude_colors, style, quiz (struct of styles, occasions, colors,
    tier; null without a quiz), height, weight. items: the fields of tags, in_stock, sizes_in_stock, available_sizes.
    Each seed's outfits are built once, each rule is searched once, and requests that say the same are answered once, whatever
    their number. Without a quiz the first top_k of the search stay in its order. Gives request_id, place, retrieval_rank,
    preference, sizes (place 1) and the record.
    """
    said = requests.select("request_id", F.struct(*[c for c in requests.columns if c != "request_id"]).alias("_said"))
    each = said.select("_said").distinct().withColumn("_one", F.monotonically_increasing_id())
    each = written(dealt(each, "_one"), "said")
    found = answers(each.select(F.col("_one").alias("request_id"), "_said.*"), items, edges, top_n, top_k)
    found = written(each.join(found.withColumnRenamed("request_id", "_one").hint("shuffle_hash"), "_one").drop("_one"), "answers")
    return said.join(found.hint("shuffle_hash"), "_said").drop("_said")


def answers(requests: DataFrame, items: DataFrame, edges: DataFrame, top_n: int = 40, top_k: int = 5) -> DataFrame:
    """recommend for requests that are answered one by one."""
    seeds_ = written(wanted_seeds(requests, items), "seeds")
    grown = assembly.assemble(seeds_.select("item_id", "category"), edges)
    slot = grown.select(F.monotonically_increasing_id().alias("row"), "seed", F.col("score").alias("mean"), "items")
    slot = written(slot, "assembled")
    x = F.struct(*[c for c in items.columns if c != "in_stock"])
    each = slot.select("row", F.posexplode("items").alias("at", "item_id")).join(items.select("item_id", x.alias("x")).hint("merge"), "item_id")
    parts = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("all")).select("row", F.transform("all", lambda a: a["x"]).alias("items"))
    rows = slot.select("row", "seed", "mean").join(parts, "row").join(seeds_.select(F.col("item_id").alias("seed"), "formality", F.col("gender").alias("seed_gender")).hint("merge"), "seed")
    records = rows.select(*tags.outfit_record(F.col("items"), F.col("mean")), "items", "formality", "seed_gender")
    asked, hits, found = search_rules(records, requests, top_n)
    # the hits of a rule with what a taste looks at; the whole record comes to the best alone
    seen = written(hits.join(found.select("_row", "score", "styles", "occasions", "colors", "price_tier").hint("merge"), "_row"), "hits")
    own = asked.select("request_id", "_rule", "quiz", "height", "weight").join(seen, "_rule")
    record = {c: F.col(c) for c in ("score", "styles", "occasions", "colors", "price_tier")}
    liked = F.when(F.col("quiz").isNull(), -F.col("retrieval_rank").cast("double")).otherwise(taste(record, {c: F.col("quiz")[c] for c in ("styles", "occasions", "colors", "tier")}))
    best = rerank(own, liked, top_k).select("request_id", "_row", "retrieval_rank", "place", F.when(F.col("quiz").isNotNull(), F.col("preference")).alias("preference"), "height", "weight")
    best = best.join(found.hint("merge"), "_row")
    sizes = F.when(F.col("place") == 1, outfit_sizes(F.col("items"), F.col("height"), F.col("weight")))
    return best.withColumn("sizes", sizes).drop("height", "weight", "items", "formality", "seed_gender", "_row")


def rerank(found: DataFrame, score: Column, top_k: int = 5) -> DataFrame:
    """For each request its first `top_k` records by a taste's score; ties stay in the order of retrieval."""
    scored = found.withColumn("preference", score)
    order = W.partitionBy("request_id").orderBy(F.desc("preference"), "retrieval_rank")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)


def outfit_counts(outfits: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, value, n, share) over outfits (item_ids, price_tier, gen_method, gender) and their items' stores (item_id, store_id)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("price_tier", "gen_method", "gender")])
    rows = outfits.select(F.explode(kinds).alias("x")).select("x.*")
    stores = outfits.select(F.explode("item_ids").alias("item_id")).join(items.select("item_id", "store_id"), "item_id").where("store_id is not null")
    by = rows.unionByName(stores.select(F.lit("store").alias("kind"), F.col("store_id").alias("value"))).groupBy("kind", "value").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.bround(F.col("n") / F.sum("n").over(W.partitionBy("kind")), 4))


def evaluate_outfits(outfits: DataFrame, items: DataFrame, tier_targets: dict[str, float]) -> DataFrame:
    """One row of quality metrics over outfits (item_ids, categories, price_tier, score) and items (item_id, gender, formality); items that are not known are unisex and casual."""
    key = outfits.select(F.sha2(F.array_join("item_ids", "|"), 256).alias("combo"), F.monotonically_increasing_id().alias("row"), "price_tier", "score", "categories", F.arrays_zip("item_ids", "categories").alias("slots"))
    each = key.select("row", F.explode("slots").alias("s")).select("row", F.col("s.item_ids").alias("item_id"), F.col("s.categories").alias("category"))
    known = each.join(items.select("item_id", "gender", "formality"), "item_id", "left")
    rank = F.when(F.col("category").isin(*FORMALITY_RELEVANT), formality_rank(F.coalesce("formality", F.lit("casual"))))
    per = known.groupBy("row").agg((F.size(F.array_remove(F.collect_set(F.coalesce("gender", F.lit("unisex"))), "unisex")) > 1).alias("mixed"), (F.max(rank) - F.min(rank) > 1).alias("clash"))
    flags = per.agg(F.count_if("mixed").alias("mixed_gender"), F.count_if("clash").alias("formality_clash"))
    has = lambda c: F.array_contains("categories", c)
    core = has("shoes") & (has("dress") | (has("top") & has("bottom")))
    tiers = [F.count_if(F.col("price_tier") == t).alias(f"tier_{t}") for t in PRICE_TIERS]
    total = key.agg(F.count("*").alias("total"), *tiers, F.count_distinct("combo").alias("unique_combos"), F.count_if(~core).alias("invalid_rule"), F.count_if(has("dress")).alias("dress_outfits"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.bround(F.avg("score"), 6).alias("score_mean"))
    usage = each.groupBy("item_id").agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    reuse = usage.agg(F.count("*").alias("distinct_items"), F.max("n").alias("reuse_max"))
    p95 = nearest_rank(usage, "g", "n", 0.95, "reuse_p95").drop("g")
    out = total.join(flags).join(reuse).join(p95, how="left")  # one row each
    share = lambda n: F.coalesce(F.try_divide(F.col(n), F.col("total")), F.lit(0.0))
    aims = sum(max(0.0, v) for v in tier_targets.values()) or 1.0
    off = F.greatest(*[F.abs(share(f"tier_{t}") - F.lit(max(0.0, tier_targets.get(t, 0.0)) / aims)) for t in PRICE_TIERS])
    return out.withColumn("dress_share", F.bround(share("dress_outfits"), 4)).withColumn("max_tier_deviation", F.bround(off, 4))


def fitb_recall(outfits: DataFrame, edges: DataFrame, completions, k: int = 5, masked: str = "shoes") -> DataFrame:
    """(eligible, hits, recall) of completing outfits (key, items: array<struct<item_id, category>>) without their item of the masked category.

    completions is graph.rank_completions. Outfits without such an item, or with nothing else, don't count.
    """
    hidden = F.get(F.filter("items", lambda x: x["category"] == masked), F.lit(0))
    rows = outfits.select("key", hidden["item_id"].alias("hidden"), F.transform(F.filter("items", lambda x: x["category"] != masked), lambda x: x["item_id"]).alias("items"))
    rows = written(rows.where("hidden is not null and size(items) > 0"), "masked")  # they are read three times
    found = completions(rows.select("key", "items"), edges, masked, k)
    hit = rows.join(found.hint("shuffle_hash"), (rows["key"] == found["key"]) & (rows["hidden"] == found["partner_id"]), "left_semi")
    both = rows.agg(F.count("*").alias("eligible")).join(hit.agg(F.count("*").alias("hits")))
    return both.withColumn("recall", F.bround(F.coalesce(F.try_divide("hits", "eligible"), F.lit(0.0)), 6))
