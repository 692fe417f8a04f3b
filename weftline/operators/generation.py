"""Outfits put together from catalog items: the best combinations, random ones, and the records made of both.

A combination is a top, a bottom and shoes, or a dress and shoes, that agree in gender (unisex goes with all; a missing
gender counts as unisex) and formality (tags.is_valid_combo). Items are rows of item_id, category, gender, formality,
colors (array), price and url; other columns ride along. Ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import formality_rank
from weftline.functions.vocab import GENDERS
from weftline.operators import tags
from weftline.operators.ordering import ranked
from weftline.sources.shared import written

# fixed values: categories that may be added to a combination, in this order, and the chance of each
OPTIONAL = ("outerwear", "bag", "accessory")
OPTIONAL_CHANCE = 0.35
SEED = 31
#: First items and pairs that are looked at in the first round; each round takes GROWTH times as many, at most MOST.
FIRSTS, PAIRS, GROWTH, MOST = 32, 256, 8, 4096
#: Items of a class and color, the last by id, whose combinations give the first bound.
HEADS = 3
#: Scores have six decimals: a better one is at least so much better.
STEP = 1e-6
_BITS = 60


def _narrow(items: DataFrame) -> DataFrame:
    """What gates and scores need of the items that can be part of a core."""
    colors = F.transform(F.filter(F.coalesce("colors", F.array().cast("array<string>")), lambda c: c != ""), lambda c: F.lower(c))
    linked = (F.coalesce("url", F.lit("")) != "").cast("int")
    return items.where(F.col("category").isin("top", "bottom", "dress", "shoes")).select(
        "item_id", "category", F.coalesce("gender", F.lit("unisex")).alias("gender"), formality_rank(F.col("formality")).alias("rank"), colors.alias("colors"), F.coalesce(F.col("price").cast("bigint"), F.lit(0)).alias("price"), linked.alias("linked")
    )


def _stats(parts: DataFrame) -> dict[str, dict]:
    """For each category the extremes that bound what an item can add to a score."""
    by = parts.groupBy("category").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.max(F.size("colors")).alias("colors"), F.max(F.size("colors") - F.size(F.array_distinct("colors"))).alias("repeats"), F.max("linked").alias("linked"))
    return {r["category"]: r.asDict() for r in by.collect()}


def _bound(rest: list[dict], share: bool = True) -> Column:
    """The best score of a partial combination (ids, price, colors, linked) that the categories of rest are added to; without share the first of them has no color of the partial one."""
    low, high = (F.col("price") + sum(r[c] for r in rest) for c in ("low", "high"))
    price = F.when((low <= 1_800_000) & (high >= 300_000), 0.20).when((low <= 3_000_000) & (high >= 150_000), 0.10).otherwise(0.0)
    repeated = F.size("colors") - F.size(F.array_distinct("colors")) + sum(r["colors"] if share or k else r["repeats"] for k, r in enumerate(rest))
    colored = (F.size("colors") > 0) | F.lit(any(r["colors"] for r in rest))
    color = F.when(colored, F.least(F.lit(0.15), repeated * 0.05) + 0.05).otherwise(0.0)
    linked = F.col("linked") + sum(r["linked"] for r in rest)
    # the same sums in the same order as tags.outfit_score, so rounding keeps the bound a bound
    return F.bround(F.lit(0.35) + price + color + 0.15 * (linked / (F.size("ids") + len(rest))) + 0.0, 6)


def _first(parts: DataFrame, category: str) -> DataFrame:
    rows = parts.where(F.col("category") == category)
    return rows.select(F.array("item_id").alias("ids"), "gender", F.col("rank").alias("least"), F.col("rank").alias("most"), "colors", "price", "linked")


def _added(left: DataFrame, right: DataFrame, shared_color: bool) -> DataFrame:
    """Each partial combination with each item that may be added, or only with those that have one of its colors. left: few rows."""
    goes = F.when(F.col("gender") == "unisex", F.array(*map(F.lit, GENDERS))).otherwise(F.array("gender", F.lit("unisex")))
    a = left.select("*", F.explode(goes).alias("r_gender"))
    b = right.select(F.col("item_id").alias("r_id"), F.col("gender").alias("r_gender"), F.col("rank").alias("r_rank"), F.col("colors").alias("r_colors"), F.col("price").alias("r_price"), F.col("linked").alias("r_linked"))
    keys = ["r_gender"]
    if shared_color:
        a, b = a.withColumn("color", F.explode(F.array_distinct("colors"))), b.withColumn("color", F.explode(F.array_distinct("r_colors")))
        keys.append("color")
    both = F.broadcast(a).join(b, keys)
    if shared_color:  # once, whatever the number of common colors
        both = both.where(F.col("color") == F.element_at(F.array_intersect("colors", "r_colors"), 1))
    least, most = F.least("least", "r_rank"), F.greatest("most", "r_rank")
    gender = F.when(F.col("gender") == "unisex", F.col("r_gender")).otherwise(F.col("gender"))
    return both.where(F.coalesce(most - least <= 1, F.lit(True))).select(
        F.concat("ids", F.array("r_id")).alias("ids"), gender.alias("gender"), least.alias("least"), most.alias("most"), F.concat("colors", "r_colors").alias("colors"), (F.col("price") + F.col("r_price")).alias("price"), (F.col("linked") + F.col("r_linked")).alias("linked")
    )


def _extended(left: DataFrame, right: DataFrame, rest: list[dict], bound: float) -> DataFrame:
    """Partial combinations with one more item (of the first category of rest) that can still reach the bound."""
    alone = _bound(rest, share=False) >= bound
    out = _added(left.where(alone), right, False).unionByName(_added(left.where(~alone & (_bound(rest) >= bound)), right, True))
    return out.where(_bound(rest[1:]) >= bound)


def best_combinations(items: DataFrame, n: int, firsts: int = FIRSTS, pairs: int = PAIRS) -> DataFrame:
    """(item_ids, score): the n best combinations by score and then ids, both descending; a rank join, not the cross product.

    A first bound comes from combinations of few items a class that share colors. Then tops and dresses are taken by
    falling id, a block at a time, joined with the bottoms that can still reach the bound, and the pairs by falling ids,
    again a block at a time, joined with shoes; where the bound can't be reached without a common color, the join is by
    color. The n-th best so far is the next bound. What comes later has smaller ids, so it must be better, not equal;
    as soon as nothing left can be, all is found. A block is at most MOST rows, so it can be sent to all tasks.
    """
    parts = written(_narrow(items), "parts")
    stats = _stats(parts)
    schema = "item_ids array<string>, score double"
    if n <= 0 or "shoes" not in stats or not ("dress" in stats or {"top", "bottom"} <= set(stats)):
        return parts.sparkSession.createDataFrame([], schema)
    bottoms, shoes = (parts.where(F.col("category") == c) for c in ("bottom", "shoes"))
    two = [stats["bottom"], stats["shoes"]] if "bottom" in stats else None

    def scored(left: DataFrame, shoes: DataFrame, bound: float) -> DataFrame:
        return _extended(left, shoes, [stats["shoes"]], bound).select(F.col("ids").alias("item_ids"), _bound([]).alias("score"))

    def best(df: DataFrame) -> DataFrame:
        return df.orderBy(F.desc("score"), F.desc("item_ids")).limit(n)

    def nth(found: DataFrame) -> float:
        least, count = found.agg(F.min("score"), F.count("*")).first()
        return least if count == n else -1.0

    bound = _first_bound(parts, stats, scored, nth, best) if two else -1.0
    found, last = parts.sparkSession.createDataFrame([], schema), None
    while True:
        tops = _first(parts, "top").where(_bound(two) >= bound) if two and "top" in stats else None
        dresses = _first(parts, "dress").where(_bound([stats["shoes"]]) >= bound)
        start = dresses.withColumn("is_top", F.lit(False)) if tops is None else dresses.withColumn("is_top", F.lit(False)).unionByName(tops.withColumn("is_top", F.lit(True)))
        if last is not None:
            start = start.where(F.col("ids") < F.array(F.lit(last)))
        block = written(start.orderBy(F.desc("ids")).limit(firsts), "firsts")
        last, count = block.agg(F.element_at(F.min("ids"), 1), F.count("*")).first()
        if not count:
            return found
        pair = block.where("not is_top").drop("is_top")
        if tops is not None:
            pair = pair.unionByName(_extended(block.where("is_top").drop("is_top"), bottoms, two, bound))
        pair, last_pair, size = written(pair, "pairs"), None, pairs
        while True:
            left = pair.where(_bound([stats["shoes"]]) >= bound)
            if last_pair is not None:
                left = left.where(F.col("ids") < F.array(*map(F.lit, last_pair)))
            some = written(left.orderBy(F.desc("ids")).limit(size), "pair_block")
            last_pair, taken = some.agg(F.min("ids"), F.count("*")).first()
            if not taken:
                break
            found = written(best(found.unionByName(scored(some, shoes, bound))), "found")
            bound = max(bound, nth(found) + STEP / 2)  # what comes now has smaller ids
            size = min(size * GROWTH, MOST)
        firsts = min(firsts * GROWTH, MOST)


def _first_bound(parts: DataFrame, stats: dict, scored, nth, best) -> float:
    """A score that at least n combinations reach, or -1."""
    order = W.partitionBy("category", "gender", "rank", "linked", F.get("colors", F.lit(0))).orderBy(F.desc("item_id"))
    heads = parts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= HEADS).drop("place")
    tops = _first(heads, "top").orderBy(F.desc("ids")).limit(MOST)
    pairs = _added(tops, heads.where("category = 'bottom'"), True).orderBy(F.desc(_bound([stats["shoes"]])), F.desc("ids")).limit(MOST)
    both = _added(pairs, heads.where("category = 'shoes'"), True).select(F.col("ids").alias("item_ids"), _bound([]).alias("score"))
    return nth(best(both))


def digits(*what: Column) -> Column:
    """A whole number of _BITS bits from the MD5 of some values."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *what)), 1, _BITS // 4), 16, 10).cast("bigint")


def _classes(counts: dict) -> tuple[list[tuple], int]:
    """Valid classes of combinations (start, [(first number, size) of each item's class]) and the number of all combinations. counts: {(category, gender, rank): (first number, size)}."""
    out, total = [], 0

    def goes(classes) -> bool:
        genders = {g for _, g, _ in classes} - {"unisex"}
        ranks = [r for _, _, r in classes if r >= 0]
        return len(genders) <= 1 and (not ranks or max(ranks) - min(ranks) <= 1)

    def of(category):
        return sorted(c for c in counts if c[0] == category)

    shapes = [(t, b, s) for t in of("top") for b in of("bottom") for s in of("shoes")] + [(d, s) for d in of("dress") for s in of("shoes")]
    for shape in filter(goes, shapes):
        size = 1
        for c in shape:
            size *= counts[c][1]
        out.append((total, [counts[c] for c in shape]))
        total += size
    return out, total


def random_combinations(items: DataFrame, n: int, seed: int = SEED, chance: float = OPTIONAL_CHANCE) -> DataFrame:
    """(draw, items, item_ids): n different random combinations (fewer if 4n draws give fewer), each valid combination equally likely, with optional items by chance.

    Items are numbered by class (category, gender, formality), so that a class is a range of numbers; the valid triples
    and pairs of classes, at most some hundreds, have sizes that add up to all combinations. A draw is a hash modulo that
    number: its place among the classes tells the class, the rest the item of each part. No combination is listed.
    An optional item is drawn among all of its category and added if the combination stays valid. Of equal results the
    first draw stays. The same seed gives the same result.
    """
    rank = F.coalesce(formality_rank(F.col("formality")), F.lit(-1))
    rows = items.withColumn("gender", F.coalesce("gender", F.lit("unisex"))).withColumn("_rank", rank)
    placed = written(ranked(rows, ["category", "gender", "_rank", "item_id"], "_number"), "numbered")
    found = placed.groupBy("category", "gender", "_rank").agg(F.min("_number").alias("first"), F.count("*").alias("size")).collect()  # at most 140 classes
    counts = {(r["category"], r["gender"], r["_rank"]): (r["first"], r["size"]) for r in found}
    classes, total = _classes(counts)
    x = F.struct(*items.columns)
    if not total or n <= 0:
        return rows.where("false").select(F.lit(0).cast("bigint").alias("draw"), F.array(x).alias("items"), F.array("item_id").alias("item_ids"))
    whole = "decimal(38,0)"
    text = [F.lit(str(seed)), F.col("draw").cast("string")]
    high, low = (digits(*text, F.lit(c)).cast("decimal(19,0)") for c in ("high", "low"))
    index = (high * F.lit(1 << _BITS).cast("decimal(19,0)") + low).cast(whole) % F.lit(str(total)).cast(whole)
    table = F.array(*[F.struct(F.lit(str(start)).cast(whole).alias("start"), F.array(*[F.struct(F.lit(a).cast("bigint").alias("first"), F.lit(size).cast("bigint").alias("size")) for a, size in parts]).alias("parts")) for start, parts in classes])
    at = F.size(F.filter(F.array(*[F.lit(str(start)).cast(whole) for start, _ in classes]), lambda s: s <= F.col("index")))
    draws = items.sparkSession.range(4 * n).select(F.col("id").alias("draw")).withColumn("index", index).withColumn("c", F.element_at(table, at)).select("draw", (F.col("index") - F.col("c.start")).cast(whole).alias("rest"), "c.parts")
    # the rest, written with a digit for each part: shoes last; a quotient is at most tops times bottoms of a class
    three = F.size("parts") == 3
    size = lambda k: F.get("parts", F.lit(k))["size"].cast("decimal(19,0)")
    draws = draws.withColumn("last", F.when(three, size(2)).otherwise(size(1))).withColumn("middle", F.when(three, size(1)).otherwise(F.lit(1).cast("decimal(19,0)")))
    draws = draws.withColumn("d0", F.expr("cast(rest % last as bigint)")).withColumn("q", F.expr("cast(rest div last as decimal(38,0))"))
    draws = draws.withColumn("d1", F.expr("cast(q % middle as bigint)")).withColumn("d2", F.expr("cast(q div middle as bigint)"))
    places = F.when(three, F.array("d2", "d1", "d0")).otherwise(F.array("d2", "d0"))
    numbers = F.zip_with("parts", places, lambda p, d: p["first"] + d)
    optional = []
    for c in OPTIONAL:
        own = [v for k, v in counts.items() if k[0] == c]
        if own:
            first, size_ = min(a for a, _ in own), sum(s for _, s in own)
            hit = digits(*text, F.lit(c)) < int(chance * (1 << _BITS))
            optional.append(F.when(hit, F.lit(first) + digits(*text, F.lit(c), F.lit("item")) % size_))
        else:
            optional.append(F.lit(None).cast("bigint"))
    slots = F.concat(F.transform(numbers, lambda v, i: F.struct(i.cast("int").alias("slot"), v.alias("number"))), F.array(*[F.struct(F.lit(10 + k).alias("slot"), o.alias("number")) for k, o in enumerate(optional)]))
    each = draws.select("draw", F.explode(slots).alias("s")).where("s.number is not null").select("draw", "s.*")
    owned = placed.select(F.col("_number").alias("number"), x.alias("x"))
    got = each.join(owned, "number").groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("all"))
    out = got.select("draw", F.transform(F.filter("all", lambda a: a["slot"] < 10), lambda a: a["x"]).alias("items"), "all")
    for k in range(len(OPTIONAL)):
        more = F.concat("items", F.transform(F.filter("all", lambda a: a["slot"] == 10 + k), lambda a: a["x"]))  # noqa: B023
        out = out.withColumn("items", F.when(tags.is_valid_combo(more), more).otherwise(F.col("items")))
    out = out.select("draw", "items", F.transform("items", lambda i: i["item_id"]).alias("item_ids"))
    different = out.groupBy("item_ids").agg(F.min_by(F.struct("draw", "items"), "draw").alias("d")).select("d.draw", "d.items", "item_ids")
    return different.orderBy("draw").limit(n)


def build_records(items: DataFrame, n: int, fitb_ratio: float = 0.70, threshold: float = 0.0, seed: int = SEED) -> DataFrame:
    """Outfit records of n combinations: the best and, for the rest, random ones, scored, those that reach the threshold by score and id, with ids OF_00001 and so on in that order.

    Columns are those of tags.outfit_record, record_id, items and gen_method (fitb_beam or random_scored). A combination
    that both give is there twice.
    """
    best = max(0, min(n, round(n * fitb_ratio)))
    pool = pooled(items, best, n - best, seed)
    kept = pool.where(F.col("score") >= threshold)
    # n rows at most
    order = [F.desc("score"), F.desc("outfit_id"), F.desc("gen_method")]
    placed = ranked(kept, order, "_place", 1)
    return placed.withColumn("record_id", F.concat(F.lit("OF_"), F.lpad(F.col("_place").cast("string"), 5, "0"))).drop("_place")


def pooled(items: DataFrame, best: int, random: int, seed: int = SEED) -> DataFrame:
    """Records of the best and of random combinations, each with items and gen_method."""
    first = with_items(best_combinations(items, best).select("item_ids"), items).withColumn("gen_method", F.lit("fitb_beam"))
    rows = first.unionByName(random_combinations(items, random, seed).select("items", F.lit("random_scored").alias("gen_method")))
    return rows.select(*tags.outfit_record(F.col("items"), tags.outfit_score(F.col("items"))), "items", "gen_method")


def with_items(combinations: DataFrame, items: DataFrame) -> DataFrame:
    """combinations (item_ids, each once) as arrays of items."""
    each = combinations.select("item_ids", F.posexplode("item_ids").alias("at", "item_id"))
    x = F.struct(*[F.coalesce("gender", F.lit("unisex")).alias("gender") if c == "gender" else F.col(c) for c in items.columns])
    got = each.join(items.select("item_id", x.alias("x")), "item_id").groupBy("item_ids").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("all"))
    return got.select(F.transform("all", lambda a: a["x"]).alias("items"))
