"""Packaging chat rows for training: two sources in one, repeats dropped, an evaluation part by task, a report.

Rows: messages (array<struct<role, content>>), task_type, source_set; other columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import dialogue
from weftline.sources.shared import written

UNKNOWN = "unknown"


def message_signature(messages: Column) -> Column:
    return F.sha2(F.to_json(messages), 256)


def merged_rows(grounded: DataFrame, knowledge: DataFrame, position: str) -> DataFrame:
    """The rows of both, repeats of the same messages dropped: of each the first by source (grounded first) and position. Columns that one lacks are null."""
    both = grounded.withColumn("_source", F.lit(0)).unionByName(knowledge.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_signature", message_signature(F.col("messages")))
    turn = F.row_number().over(W.partitionBy("_signature").orderBy("_source", position))
    return both.withColumn("_turn", turn).where("_turn = 1").drop("_source", "_signature", "_turn")


def evaluation_quotas(counts: dict[str, int], fraction: float, most: int) -> dict[str, int]:
    """How many rows of each task are held out: its fraction, rounded down, at least one of two or more and never all, and in the order of tasks no more than most together. If that gives none, the last task gives one."""
    out, left = {}, most
    for task in sorted(counts):
        n = counts[task]
        wanted = int(n * fraction)
        if n > 1 and fraction > 0:
            wanted = max(1, wanted)
        out[task] = min(wanted, left, max(0, n - 1))
        left -= out[task]
    if not any(out.values()) and sum(counts.values()) > 1 and most > 0:
        out[max(counts)] = 1
    return out


def split_rows(rows: DataFrame, fraction: float = 0.03, most: int = 256, seed: str = "42") -> DataFrame:
    """rows with is_eval: of each task the first by a hash of the messages, as many as evaluation_quotas says. Ranks are cut at the largest quota before they are shuffled. Rows have different messages."""
    named = rows.withColumn("_task", F.coalesce("task_type", F.lit(UNKNOWN))).withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), message_signature(F.col("messages"))), 256))
    counts = {r["_task"]: r["n"] for r in named.groupBy("_task").agg(F.count("*").alias("n")).collect()}  # one row a task
    quotas = evaluation_quotas(counts, fraction, most)
    spark = rows.sparkSession
    table = spark.createDataFrame(list(quotas.items()), "_task string, _quota int")
    largest = max([1, *quotas.values()])
    placed = named.select("_task", "_h").withColumn("_place", F.row_number().over(W.partitionBy("_task").orderBy("_h"))).where(F.col("_place") <= largest)
    held = placed.join(F.broadcast(table), "_task").where(F.col("_place") <= F.col("_quota")).select("_h", F.lit(True).alias("_held"))
    return named.join(held, "_h", "left").select(*rows.columns, F.coalesce("_held", F.lit(False)).alias("is_eval"))


def report(rows: DataFrame) -> DataFrame:
    """One row: total, different messages, rows with calls, of these valid and invalid ones, repeated scenario ids, mean and most turns."""
    answers = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    each = rows.select(message_signature(F.col("messages")).alias("s"), F.coalesce("scenario_id", F.lit("")).alias("id"), F.coalesce(F.size("messages"), F.lit(0)).alias("turns"), answers.alias("text"))
    each = each.withColumn("calls", F.contains("text", F.lit("<tool_call>"))).withColumn("valid", F.col("calls") & (F.size(dialogue.call_texts(F.col("text"))) > 0) & (F.size(dialogue.text_call_errors(F.col("text"))) == 0))
    return each.agg(
        F.count("*").alias("total_rows"), F.count_distinct("s").alias("unique_message_rows"), F.count_if("calls").alias("tool_call_rows"), F.count_if("valid").alias("valid_tool_rows"), F.count_if(F.col("calls") & ~F.col("valid")).alias("invalid_tool_rows"),
        (F.count("*") - F.count_distinct("id")).alias("duplicate_scenario_ids"), F.bround(F.coalesce(F.avg("turns"), F.lit(0.0)), 2).alias("avg_turns"), F.coalesce(F.max("turns"), F.lit(0)).alias("max_turns"),
    )


def package(grounded: DataFrame, knowledge: DataFrame, folder: str, position: str, fraction: float = 0.03, most: int = 256, seed: str = "42") -> DataFrame:
    """train.jsonl and eval.jsonl below a folder, and (part, name, n): their sizes, and rows by task and source. Fewer than two different rows are an error."""
    rows = written(split_rows(merged_rows(grounded, knowledge, position), fraction, most, seed), "packaged")
    if len(rows.limit(2).collect()) < 2:
        raise ValueError("need at least 2 rows to package")
    for name, part in (("train", rows.where("not is_eval")), ("eval", rows.where("is_eval"))):
        part.drop("is_eval").write.mode("overwrite").json(f"{folder}/{name}.jsonl", ignoreNullFields=False)
    by = lambda part, c: rows.groupBy(F.coalesce(c, F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    return by("size", F.when(F.col("is_eval"), "eval").otherwise("train")).unionByName(by("task", F.col("task_type"))).unionByName(by("source", F.col("source_set")))


def narrow_budget(price_max: Column, found: Column, share: float = 0.5) -> Column:
    """Whether the dearest of the found prices (array) stays below a share of a cap: the cap is higher than what there is."""
    return F.coalesce((price_max > 0) & (F.array_max(found) < price_max * share), F.lit(False))
