"""Distilling a corpus of examples: families capped, topics in shares, strata interleaved, synthetic turns made unique.

Examples: key, prompt, answer. Other columns ride along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import free_name
from weftline.functions.vocab import BODY_SHAPES, OCCASIONS, SKIN_TONES, STYLES
from weftline.operators import dialogue
from weftline.operators.catalog import latest
from weftline.operators.ordering import ranked
from weftline.sources.shared import written

# fixed values: wanted length of an answer, and fields of the synthetic calls
WANTED_WORDS = 120
PRICE_BASE, PRICE_STEP, BUDGET_BASE, BUDGET_STEP = 700_000, 200_000, 500, 100
EXCLUDED = ("cam", "hồng_neon")


def largest_remainder(weights: dict[str, float], total: int) -> dict[str, int]:
    """total in proportion to weights, whole numbers; of equal remainders the last key first."""
    every = sum(weights.values())
    if total <= 0 or every <= 0:
        return dict.fromkeys(weights, 0)
    raw = {k: total * w / every for k, w in weights.items()}
    out = {k: math.floor(x) for k, x in raw.items()}
    for k in sorted(raw, key=lambda k: (raw[k] - out[k], k), reverse=True)[: total - sum(out.values())]:
        out[k] += 1
    return out


def topic_targets(counts: dict[str, int], target: int) -> dict[str, int]:
    """How many examples of each topic: shares by the square root of its count; a topic that has no more than its share gives all, and the rest is shared anew among the others."""
    out, left = dict.fromkeys(sorted(counts), 0), target
    active = {t for t, n in counts.items() if n > 0}
    while left > 0 and active:
        quotas = largest_remainder({t: math.sqrt(counts[t]) for t in sorted(active)}, left)
        full = {t for t in active if quotas[t] >= counts[t]}
        for t in full or active:
            out[t] = counts[t] if full else quotas[t]
        if not full:
            break
        left -= sum(counts[t] for t in full)
        active -= full
    return out


def signature(*parts: Column) -> Column:
    """A digest of parts, told apart."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def clean_examples(examples: DataFrame, max_words: int = 280, echo: float = 0.65) -> DataFrame:
    """The examples without a quality flag."""
    q = dialogue.example_quality(F.col("prompt"), F.col("answer"), max_words, echo)
    name = free_name(examples, "_quality")
    return examples.withColumn(name, q).where(F.size(F.col(name)["flags"]) == 0).drop(name)


def flag_counts(examples: DataFrame, max_words: int = 280, echo: float = 0.65) -> DataFrame:
    """(flag, n): examples by quality flag, those without as clean."""
    flags = dialogue.example_quality(F.col("prompt"), F.col("answer"), max_words, echo)["flags"]
    each = examples.select(F.explode(F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit("clean")))).alias("flag"))
    return each.groupBy("flag").agg(F.count("*").alias("n"))


def select_distilled(examples: DataFrame, target: int, max_per_family: int = 2, max_words: int = 280, echo: float = 0.65, key: str = "key") -> DataFrame:
    """The chosen examples with topic, style, length_class, family, score, and round and stratum: where in the interleaving each was taken.

    Examples with a flag go; of equal ones the first key stays. If more than target are left, each family (first content
    words of the prompt) keeps its max_per_family best: by score, then nearness to WANTED_WORDS, then signature. If there
    are still more, the strata (topic, style, length) are interleaved, the smallest first: round r takes the r-th best of
    each, as long as the topic has quota (topic_targets) left. That is each topic's first rows by (round, stratum), so
    ranks do it. What topics leave open is filled by the same order. With target or fewer left, all of them are chosen; with
    none, the result is empty.

    Ranks are cut at the cap and at the target before they are shuffled, so no task holds a whole family or stratum.
    """
    if target <= 0 or max_per_family <= 0:
        raise ValueError("target and max_per_family must be positive")
    names = [c for c in examples.columns if c != key]
    rows = examples.select(F.col(key).alias("key"), *names)
    scores = dialogue.quality_scores(rows, "key")  # the words of all prompts count, as in the whole corpus
    prompt, answer = F.col("prompt"), F.col("answer")
    kept = latest(clean_examples(rows, max_words, echo).withColumn("_signature", signature(prompt, answer)), ["_signature"], [F.col("key")])
    kept = kept.join(scores, "key").withColumns({"topic": dialogue.topic(prompt, answer), "style": dialogue.prompt_style(prompt), "length_class": dialogue.answer_length(answer), "family": dialogue.family_key(prompt)})
    kept = written(kept, "clean_examples")
    out = [F.col("key").alias(key), *names, "topic", "style", "length_class", "family", "score"]
    if kept.count() > target:
        best = [F.desc("score"), F.abs(dialogue.word_count(answer) - WANTED_WORDS), F.col("_signature")]
        place = F.row_number().over(W.partitionBy("family").orderBy(*best))
        kept = written(kept.withColumn("_place", place).where(F.col("_place") <= max_per_family).drop("_place"), "capped_examples")
    sizes = kept.groupBy("topic", "style", "length_class").agg(F.count("*").alias("n")).collect()  # topics x styles x lengths
    counts: dict[str, int] = {}
    for r in sizes:
        counts[r["topic"]] = counts.get(r["topic"], 0) + r["n"]
    quotas = topic_targets(counts, target)
    order = sorted(((r["n"], (r["topic"], r["style"], r["length_class"])) for r in sizes))
    spark = kept.sparkSession
    strata = spark.createDataFrame([(*k, i + 1, quotas[k[0]]) for i, (_, k) in enumerate(order)], "topic string, style string, length_class string, stratum int, quota int")
    within = F.row_number().over(W.partitionBy("stratum").orderBy(F.desc("score"), "_signature"))
    turns = kept.join(F.broadcast(strata), ["topic", "style", "length_class"]).withColumn("round", within).where(F.col("round") <= target)
    turn = F.row_number().over(W.partitionBy("topic").orderBy("round", "stratum"))
    placed = written(turns.withColumn("_turn", turn).where(F.col("_turn") <= target), "turns")
    first = placed.where(F.col("_turn") <= F.col("quota"))
    missing = min(target, sum(counts.values())) - sum(quotas.values())
    if missing > 0:  # rounding left something open
        first = first.unionByName(placed.where(F.col("_turn") > F.col("quota")).orderBy("round", "stratum").limit(missing))
    return first.select(*out, "round", "stratum")


def cyclic(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def synthetic_call(index: Column) -> Column:
    """The JSON of a search call whose arguments go round the vocabulary."""
    args = [("occasion", OCCASIONS), ("style", STYLES), ("body_shape", BODY_SHAPES), ("skin_tone", SKIN_TONES)]
    fields = [F.concat(F.lit(f'"{name}": "'), cyclic(values, index), F.lit('"')) for name, values in args]
    price = F.concat(F.lit('"price_max": '), (PRICE_BASE + index % 3 * PRICE_STEP).cast("string"))
    colors = F.concat(F.lit('"exclude_colors": ["'), cyclic(EXCLUDED, index), F.lit('"]'))
    return F.concat(F.lit('{"name": "search_outfits", "arguments": {'), F.concat_ws(", ", *fields, price, colors), F.lit("}}"))


def rendered(template: str, hint: Column, index: Column) -> Column:
    """A template with {style}, {occasion}, {body_shape}, {budget}, {hint} and {call} filled in by the index."""
    values = {"style": cyclic(STYLES, index), "occasion": cyclic(OCCASIONS, index), "body_shape": cyclic(BODY_SHAPES, index), "budget": (BUDGET_BASE + index % 5 * BUDGET_STEP).cast("string"), "hint": hint, "call": synthetic_call(index)}
    out = F.lit(template)
    for name, value in values.items():
        if "{" + name + "}" in template:
            out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def synthesize(seeds: DataFrame, templates: dict[str, list[tuple[str, str]]], counts: dict[str, int], suffixes: tuple[str, ...], seed: str = "42", key: str = "key", no_hint: str = "") -> DataFrame:
    """(cursor, task_type, messages): counts[task] chats of each task, by its template of (role, text) turns.

    Examples number 0, 1, ... through all tasks in the order of templates. Example i takes its hint (the first sentence
    of an answer) from seed i modulo the number of seeds, in a hash order, and its words from the vocabulary by i. Where
    messages repeat, the k-th repetition gets a suffix behind its last turn, the k-th of suffixes in a round, counted from
    1, with the number of the round once all have been used; what still repeats is mended in the next pass, until nothing
    does. So no two are equal, whatever the counts.
    """
    unknown = sorted(set(counts) - set(templates))
    if unknown:
        raise ValueError(f"no template for {unknown}")
    spark = seeds.sparkSession
    hints = seeds.select(F.col(key).cast("string").alias("key"), dialogue.first_sentence(F.col("answer")).alias("hint"))
    hints = hints.select("key", F.when(F.coalesce("hint", F.lit("")) == "", no_hint).otherwise(F.col("hint")).alias("hint"), F.sha2(F.concat_ws(":", F.lit(seed), "key"), 256).alias("digest"))
    hints = written(ranked(hints, ["digest", "key"], "slot"), "hints")
    size = hints.count()
    if not size:
        raise ValueError("seeds must not be empty")
    tasks, start = [], 0
    for task in templates:
        tasks.append((task, start, start + counts.get(task, 0)))
        start += counts.get(task, 0)
    plan = spark.createDataFrame(tasks, "task_type string, first bigint, stop bigint").where("stop > first")
    each = plan.select("task_type", F.explode(F.sequence("first", F.col("stop") - 1)).alias("cursor")).withColumn("slot", F.col("cursor") % size)
    rows = each.join(hints, "slot")
    messages = F.lit(None).cast("array<struct<role:string,content:string>>")
    for task, turns in templates.items():
        own = F.array(*[F.struct(F.lit(role).alias("role"), rendered(text, F.col("hint"), F.col("cursor")).alias("content")) for role, text in turns])
        messages = F.when(F.col("task_type") == task, own).otherwise(messages)
    return unique_messages(rows.select("cursor", "task_type", messages.alias("messages")), suffixes)


def _with_suffix(messages: Column, number: Column, suffixes: tuple[str, ...]) -> Column:
    again = F.floor(number / len(suffixes))
    suffix = F.concat(cyclic(suffixes, number), F.when(again > 0, F.concat(F.lit(" ("), (again + 1).cast("string"), F.lit(")"))).otherwise(""))
    last = F.element_at(messages, -1)
    text = dialogue.clean_text(F.concat_ws(" ", last["content"], suffix))
    return F.concat(F.slice(messages, 1, F.size(messages) - 1), F.array(F.struct(last["role"].alias("role"), text.alias("content"))))


def unique_messages(rows: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """rows (cursor, messages) with suffixes where messages repeat; the first by cursor of equal ones stays as it is."""
    digest = F.sha2(F.to_json("messages"), 256)
    left = rows.withColumn("_own", F.col("messages")).withColumn("_number", F.lit(0).cast("bigint"))
    done = None
    while True:
        left = left.withColumn("_signature", digest)
        if done is not None:
            left = left.join(done.select("_signature", F.lit(True).alias("_taken")), "_signature", "left")
        else:
            left = left.withColumn("_taken", F.lit(None).cast("boolean"))
        turn = F.row_number().over(W.partitionBy("_signature").orderBy("cursor"))
        tried = written(left.withColumn("_turn", turn), "tried")
        fresh = tried.where("_taken is null and _turn = 1")
        done = fresh if done is None else done.unionByName(fresh)
        again = tried.where("not (_taken is null and _turn = 1)")
        if again.isEmpty():
            return done.select(*rows.columns)
        # the k-th of equal ones tries the k-th suffix from where it was
        number = F.col("_number") + F.when(F.col("_taken"), F.col("_turn")).otherwise(F.col("_turn") - 1)
        left = again.withColumn("_number", number).withColumn("messages", _with_suffix(F.col("_own"), F.col("_number"), suffixes)).drop("_signature", "_taken", "_turn")
        done = written(done, "unique")


def bundle(examples: DataFrame, folder: str, target: int, templates: dict, counts: dict[str, int], suffixes: tuple[str, ...], system: str, max_per_family: int = 2, seed: str = "42") -> DataFrame:
    """Distilled and synthetic examples as JSON lines below a folder (knowledge, behavioral, train), and (part, name, value): the counts of a manifest.

    Examples: key, prompt, answer. Each file's rows have messages, task_type and source_set; train is both in one.
    """
    chosen = written(select_distilled(examples, target, max_per_family), "distilled")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    knowledge = chosen.select(F.array(turn("system", F.lit(system)), turn("user", F.col("prompt")), turn("assistant", F.col("answer"))).alias("messages"), F.lit("stylist_knowledge").alias("task_type"), F.lit("stylist_knowledge").alias("source_set"))
    made = synthesize(chosen, templates, counts, suffixes, seed)
    behavioral = written(made.select(F.concat(F.array(turn("system", F.lit(system))), "messages").alias("messages"), "task_type", F.lit("behavioral_synthetic").alias("source_set")), "synthetic")
    both = written(knowledge.unionByName(behavioral), "train")
    for name, rows in (("knowledge", both.where("source_set = 'stylist_knowledge'")), ("behavioral", behavioral), ("train", both)):
        rows.write.mode("overwrite").json(f"{folder}/{name}.jsonl", ignoreNullFields=False)
    clean = clean_examples(examples)
    parts = [
        examples.agg(F.count("*").alias("n")).select(F.lit("size").alias("part"), F.lit("raw").alias("name"), "n"),
        clean.agg(F.count("*").alias("n")).select(F.lit("size"), F.lit("clean"), "n"),
        both.groupBy("source_set").agg(F.count("*").alias("n")).select(F.lit("size"), "source_set", "n"),
        flag_counts(examples).select(F.lit("flag"), "flag", "n"),
        chosen.groupBy("topic").agg(F.count("*").alias("n")).select(F.lit("topic"), "topic", "n"),
        behavioral.groupBy("task_type").agg(F.count("*").alias("n")).select(F.lit("task"), "task_type", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("part", "name", F.col("n").alias("value"))
