"""A bank of scenarios for dialogues, grounded in catalog items: members of pools assigned in turn.

Items: item_id, category, formality, price, title, colors (array), url, in_stock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.vocab import BODY_SHAPES, OCCASIONS, SKIN_TONES, STYLES
from weftline.operators.distill import cyclic
from weftline.operators.ordering import ranked
from weftline.operators.tags import formalities_for
from weftline.sources.shared import written


@dataclass(frozen=True)
class Task:
    """What a kind of scenario is made of: the pool its seeds come from ("first" or "second" occasion), only its first three (head), the shift within it, candidates shown, whether the request names the occasion, sizes, and what is expected of the answer."""

    pool: str
    head: bool = False
    shift: int = 0
    candidates: bool = True
    asks_occasion: bool = True
    target: bool = False
    below_all: bool = False
    fake_id: bool = False
    height: int = 160
    weight: int = 52
    expects: tuple[str, ...] = ()


# fixed values: the kinds of scenarios in their order, and their bases of height and weight
TASKS = {
    "tool_calling_grounded": Task("first", head=True, height=160, weight=52, expects=("call_tool",)),
    "recommend_explain_grounded": Task("first", head=True, height=159, weight=51),
    "ask_missing_info_grounded": Task("first", asks_occasion=False, target=True, height=158, weight=50, expects=("ask_followup",)),
    "no_result_or_relax_constraints": Task("second", candidates=False, below_all=True, height=162, weight=54, expects=("relax_constraints",)),
    "polite_decline_anti_hallucination": Task("first", head=True, candidates=False, fake_id=True, height=164, weight=56, expects=("decline",)),
    "multi_turn_grounded": Task("second", asks_occasion=False, target=True, height=161, weight=53, expects=("call_tool", "ask_followup")),
    "body_fit_grounded": Task("first", head=True, shift=1, height=157, weight=49),
}
EXPECTED = ("call_tool", "ask_followup", "decline", "relax_constraints")
SECOND = "travel"
HEAD = 3
PRICE_LEAST, PRICE_STEP = 300_000, 50_000
SNAPSHOT = ("item_id", "title", "category", "formality", "price", "colors", "url")


def seed_items(items: DataFrame) -> DataFrame:
    """(occasion, SNAPSHOT) of the tops and dresses in stock with a link that suit each occasion."""
    fits = items.where(F.col("category").isin("top", "dress") & F.col("in_stock") & (F.coalesce("url", F.lit("")) != ""))
    occasions = F.array(*map(F.lit, OCCASIONS))
    each = fits.withColumn("occasion", F.explode(F.filter(occasions, lambda o: F.array_contains(formalities_for(o), F.col("formality")))))
    plain = {"title": F.coalesce("title", F.lit("")), "price": F.coalesce(F.col("price").cast("bigint"), F.lit(0)), "colors": F.filter(F.coalesce("colors", F.array().cast("array<string>")), lambda c: c != "")}
    return each.withColumns(plain).select("occasion", *SNAPSHOT)


def scenario_bank(items: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(scenario_id, task_type, request, user_profile, seed_item, candidates, expected, target_occasion): counts[task] scenarios of each task.

    The first occasion (by the vocabulary) with seeds and a second one (travel, else the next, else the same) give two
    pools, numbered by item_id. Scenario k of a task takes member k modulo its pool's size, or modulo three of the first
    three; words go round the vocabulary by k. Ids count through all tasks in the order of TASKS. Without any seed the
    bank is empty.
    """
    unknown = sorted(set(counts) - set(TASKS))
    if unknown:
        raise ValueError(f"unknown tasks: {', '.join(unknown)}")
    spark = items.sparkSession
    pools = seed_items(items)
    there = [o for o in OCCASIONS if o in {r["occasion"] for r in pools.select("occasion").distinct().collect()}]
    first = there[0] if there else OCCASIONS[0]
    second = SECOND if SECOND in there else there[1] if len(there) > 1 else first
    by_occasion = {}
    for o in {first, second}:
        by_occasion[o] = written(ranked(pools.where(F.col("occasion") == o).drop("occasion"), ["item_id", "price"], "slot"), "pool")
    facts = {o: p.agg(F.count("*").alias("n"), F.min("price").alias("low")).first() for o, p in by_occasion.items()}
    plan, at = [], 0
    for name, task in TASKS.items():
        o = first if task.pool == "first" else second
        n = counts.get(name, 0) if facts[o]["n"] else 0
        size = min(HEAD, facts[o]["n"]) if task.head else facts[o]["n"]
        plan.append((name, o, at, n, size or 1, task.shift, task.candidates, task.asks_occasion, task.target, facts[o]["low"] if task.below_all else None, task.fake_id, task.height, task.weight, [e in task.expects for e in EXPECTED]))
        at += max(0, n)
    schema = "task_type string, occasion string, start bigint, n bigint, size bigint, shift int, shows boolean, asks boolean, has_target boolean, low bigint, fake boolean, height int, weight int, expects array<boolean>"
    each = spark.createDataFrame(plan, schema).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    each = each.withColumn("slot", (F.col("k") + F.col("shift")) % F.col("size"))
    snapshot = F.struct(*SNAPSHOT)
    every = None
    for o, p in by_occasion.items():
        own = p.select(F.lit(o).alias("occasion"), "slot", snapshot.alias("seed_item"))
        every = own if every is None else every.unionByName(own)
    heads = every.where(F.col("slot") < HEAD).groupBy("occasion").agg(F.array_sort(F.collect_list(F.struct("slot", "seed_item"))).alias("h"))
    heads = heads.select("occasion", F.transform("h", lambda x: x["seed_item"]).alias("head"))  # three items each
    rows = each.join(every, ["occasion", "slot"]).join(F.broadcast(heads), "occasion")
    k = F.col("k")
    price = F.when(F.col("low").isNotNull(), F.greatest(F.lit(0), F.col("low") - 1)).otherwise(F.greatest(F.col("seed_item.price"), F.lit(PRICE_LEAST)))
    request = F.struct(
        F.when(F.col("asks"), F.col("occasion")).alias("occasion"), cyclic(STYLES, k).alias("style"), cyclic(BODY_SHAPES, k).alias("body_shape"), cyclic(SKIN_TONES, k).alias("skin_tone"), (price + k % 5 * PRICE_STEP).alias("price_max"),
        F.array().cast("array<string>").alias("exclude_colors"), F.when(F.col("fake"), F.format_string("OUTFIT_FAKE_%03d", k + 1)).alias("requested_outfit_id"),
    )
    return rows.select(
        F.format_string("SC_%06d", F.col("start") + k + 1).alias("scenario_id"), "task_type", request.alias("request"), F.struct((F.col("height") + k % 10).alias("height_cm"), (F.col("weight") + k % 8).alias("weight_kg")).alias("user_profile"), "seed_item",
        F.when(F.col("shows"), F.col("head")).otherwise(F.slice("head", 1, 0)).alias("candidates"), F.struct(*[F.get("expects", F.lit(i)).alias(f"should_{e}") for i, e in enumerate(EXPECTED)]).alias("expected"), F.when(F.col("has_target"), F.col("occasion")).alias("target_occasion"),
    )


def summarize_bank(bank: DataFrame) -> DataFrame:
    """(part, name, n): scenarios by task and by the occasion that requests name, and all of them."""
    by = lambda part, c: bank.where(c.isNotNull()).groupBy(c.alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    return by("task", F.col("task_type")).unionByName(by("occasion", F.col("request.occasion"))).unionByName(by("size", F.lit("all")))

