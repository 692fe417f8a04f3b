"""Evaluation in long form: scores of answers by task, samples and outfits of a tagging benchmark, metrics of experiments."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weftline.functions.expressions import tokens
from weftline.operators import dialogue, tags
from weftline.sources.shared import written

SCORES = ("tool_call_f1", "text_similarity", "format_compliance")


def with_similarity(rows: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """rows with the F1 of the tokens that two texts share, counted with repeats; 0 without a common one. Both texts are in one row, so no token leaves its task."""
    kept = rows.columns
    told = rows.select("*", tokens(a).alias("_a"), tokens(b).alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("_a"), batch.column("_b"), strict=True):
                x, y = x.as_py() or [], y.as_py() or []
                common = sum((Counter(x) & Counter(y)).values())
                found.append(2.0 * common / (len(x) + len(y)) if common else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.float64())], [*kept, name])

    return told.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def text_similarities(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """(key, similarity) of each row: with_similarity of two texts."""
    return with_similarity(rows.select(key, a.alias("_x"), b.alias("_y")), F.col("_x"), F.col("_y"), "similarity").select(key, "similarity")


def evaluate_samples(samples: DataFrame, key: str = "key") -> DataFrame:
    """samples (key, task_type, generated, reference) with the SCORES of each; f1 is null where the reference has no call. Keys are unique."""
    rows = with_similarity(samples, F.col("generated"), F.col("reference"), "text_similarity")
    return rows.withColumn("tool_call_f1", dialogue.call_f1(F.col("generated"), F.col("reference"))).withColumn("format_compliance", dialogue.format_ok(F.col("generated"), F.col("reference")).cast("double"))


def summarize_scores(scored: DataFrame, task: str = "task_type", scores: tuple[str, ...] = SCORES) -> DataFrame:
    """(task, count, mean_...): by task, and over all (task null), one rollup; null and NaN scores don't count, no scores give 0. A blank task is unknown."""
    named = scored.withColumn(task, F.when(F.coalesce(F.trim(task), F.lit("")) == "", "unknown").otherwise(F.col(task)))
    means = [F.bround(F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0)), 4).alias(f"mean_{c}") for c in scores]
    return named.rollup(task).agg(F.count("*").alias("count"), *means)


def generated_answers(rows: DataFrame, context: str, make_generator: Callable[[], Callable[[str], str]], name: str = "generated") -> DataFrame:
    """rows with the answers of a model to a context column, in place of a column of that name: make_generator runs once a task and gives a function of a text."""
    rows = rows.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = None
        for b in batches:
            generate = generate or make_generator()
            texts = [None if t is None else generate(t) for t in b.column(context).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))


def metrics_long(reports: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, metric, value): every other column of reports as a row of its own; nulls are left out."""
    values = [c for c in reports.columns if c not in ids]
    wide = reports.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot(ids, values, "metric", "value").where("value is not null")


#: Columns that a line of a metrics file may have.
_CELLS = 16


def read_metrics(spark, folder: str) -> DataFrame:
    """(experiment, ablation, metric, value, timestamp, commit_sha) of the CSV files of a folder; the experiment is the file's name.

    Each file has a header of its own: cells are told by it, whatever their order; columns that a file lacks are null. A
    file of metrics is small, so it is read as one row.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = files.select(F.col("_metadata.file_name").alias("experiment"), F.get(lines, F.lit(0)).alias("header"), F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    names = [f"c{k}" for k in range(_CELLS)]
    schema = ", ".join(f"{n} string" for n in names)
    rows = rows.select("experiment", F.from_csv("header", schema).alias("h"), F.from_csv("line", schema).alias("x"))

    def cell(name: str) -> Column:
        return F.coalesce(*[F.when(F.trim(F.col("h")[n]) == name, F.col("x")[n]) for n in names]).alias(name)

    return rows.select("experiment", *map(cell, ("ablation", "metric", "value", "timestamp", "commit_sha")))


def latest_metrics(rows: DataFrame) -> DataFrame:
    """(experiment, ablation, metric, value, timestamp): the last row of each metric by timestamp, then value; a timestamp that can't be read is the earliest, a missing ablation or metric is unknown."""
    stamp = F.coalesce(F.try_to_timestamp("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    named = rows.select("experiment", F.coalesce("ablation", F.lit("unknown")).alias("ablation"), F.coalesce("metric", F.lit("unknown")).alias("metric"), "value", "timestamp", stamp.alias("at"))
    last = named.groupBy("experiment", "ablation", "metric").agg(F.max_by(F.struct("value", "timestamp"), F.struct("at", "value", "timestamp")).alias("x"))
    return last.select("experiment", "ablation", "metric", "x.value", "x.timestamp")


def metrics_table(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each experiment and ablation, with the last value of each metric in a column of its own."""
    return latest_metrics(rows).groupBy("experiment", "ablation").pivot("metric", metrics).agg(F.first("value"))


def markdown_lines(rows: DataFrame) -> DataFrame:
    """(experiment, place, line): a Markdown table of metrics, an experiment's heading before its rows by ablation and metric."""
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    none = F.lit("")
    heads = rows.groupBy("experiment").agg(F.max(F.try_to_timestamp("timestamp")).alias("at"))
    head = heads.select("experiment", F.lit(0).alias("place"), line(F.concat(F.lit("**"), "experiment", F.lit("**")), none, none, none, F.coalesce(F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit("---"))).alias("line"))
    named = rows.withColumn("ablation", F.coalesce("ablation", F.lit("unknown")))
    order = W.partitionBy("experiment").orderBy("ablation", "metric", "timestamp", "value")  # an experiment's metrics are few
    body = named.select("experiment", F.row_number().over(order).alias("place"), line(none, F.col("ablation"), F.col("metric"), F.col("value"), F.coalesce("timestamp", F.lit("---"))).alias("line"))
    return head.unionByName(body)


def summarize_items(records: DataFrame, group: str = "category") -> DataFrame:
    """(group, n, complete_rate, body_jaccard, season_jaccard, latency_mean, latency_median, latency_p95): by group and over all (group null).

    The median is the mean of the middle two; p95 is the value at place floor(0.95 * (n - 1)) of the order. Latencies are
    counted by value before they are ordered.
    """
    rate = lambda c: F.bround(F.coalesce(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)), 3)
    rows = records.withColumn("latency", F.coalesce(F.col("latency_s").cast("double"), F.lit(0.0)))
    base = rows.rollup(group).agg(F.grouping(group).alias("every"), F.count("*").alias("n"), rate("ok").alias("complete_rate"), rate("body_jaccard").alias("body_jaccard"), rate("season_jaccard").alias("season_jaccard"), rate("latency").alias("latency_mean"))
    by = rows.groupBy(group, "latency").agg(F.count("*").alias("c"))
    both = by.select(F.lit(0).alias("every"), group, "latency", "c").unionByName(by.groupBy("latency").agg(F.sum("c").alias("c")).select(F.lit(1).alias("every"), F.lit(None).cast(by.schema[group].dataType).alias(group), "latency", "c"))
    w = W.partitionBy("every", group)
    placed = both.withColumn("upto", F.sum("c").over(w.orderBy("latency"))).withColumn("all", F.sum("c").over(w))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("latency")))

    last = F.col("all") - 1
    middle = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2
    ranks = placed.groupBy("every", group).agg(F.bround(middle, 3).alias("latency_median"), F.bround(at(F.floor(last * 0.95)), 3).alias("latency_p95"))
    ranks = ranks.withColumnsRenamed({"every": "r_every", group: "r_group"})
    return base.join(ranks, (F.col("every") == F.col("r_every")) & F.col(group).eqNullSafe(F.col("r_group"))).drop("every", "r_every", "r_group")


def covered_outfits(outfits: DataFrame, items: DataFrame, predicted: DataFrame, relevant: tuple[str, ...]) -> DataFrame:
    """Outfits (outfit_id, item_ids) whose items of relevant categories are all predicted: a division by anti-join. items: item_id, category; predicted: item_id, each once."""
    each = outfits.select("outfit_id", F.explode("item_ids").alias("item_id"))
    needed = each.join(items.where(F.col("category").isin(*relevant)).select("item_id").hint("merge"), "item_id", "left_semi")
    lacking = needed.join(predicted.select("item_id").hint("merge"), "item_id", "left_anti").select("outfit_id").distinct().hint("merge")
    return outfits.join(lacking, "outfit_id", "left_anti")


def summarize_outfits(outfits: DataFrame, items: DataFrame, predicted: DataFrame, reference: DataFrame, relevant: tuple[str, ...]) -> DataFrame:
    """One row for each covered outfit: body_shapes and seasons derived from predicted and reference tags (item_id, body_shapes, seasons), their jaccards, complete."""
    rows = covered_outfits(outfits, items, predicted, relevant).select("outfit_id", F.posexplode("item_ids").alias("at", "item_id")).join(items.select("item_id", "category").hint("merge"), "item_id")

    def of(own: DataFrame, name: str) -> Column:
        return own.select("item_id", F.struct("body_shapes", "seasons").alias(name)).hint("merge")  # as many as the catalog has: a small file of them is large in memory

    both = rows.join(of(predicted, "p"), "item_id", "left").join(of(reference, "r"), "item_id", "left")
    parts = both.groupBy("outfit_id").agg(F.array_sort(F.collect_list(F.struct("at", "category", "p", "r"))).alias("all"))
    side = lambda n: F.transform("all", lambda a: F.struct(a["category"].alias("category"), a[n]["body_shapes"].alias("body_shapes"), a[n]["seasons"].alias("seasons")))
    parts = parts.select("outfit_id", side("p").alias("p"), side("r").alias("r"))
    parts = parts.select("outfit_id", *[f(F.col(n)).alias(f"{n}_{c}") for n in ("p", "r") for c, f in (("body", tags.outfit_body_shapes), ("season", tags.outfit_seasons))])
    return parts.select(
        "outfit_id", F.col("p_body").alias("body_shapes"), F.col("p_season").alias("seasons"), tags.jaccard(F.col("p_body"), F.col("r_body")).alias("body_jaccard"), tags.jaccard(F.col("p_season"), F.col("r_season")).alias("season_jaccard"),
        ((F.size("p_body") > 0) & (F.size("p_season") > 0)).alias("complete"),
    )


def benchmark_sample(outfits: DataFrame, items: DataFrame, item_count: int, outfit_count: int, seed: str = "42") -> DataFrame:
    """(item_id, place, why): the items of outfit_count outfits drawn by hash, then items by category in turn until there are item_count.

    items (item_id, category, tagged): only tagged ones fill up. Categories take turns by name, each in a hash order of
    its own; that is the order of (place in category, category). Raises if the outfits need more items than item_count,
    or if there are too few to fill up.
    """
    if item_count <= 0 or outfit_count <= 0:
        raise ValueError("item_count and outfit_count must be positive")
    digest = lambda c: F.sha2(F.concat_ws(":", F.lit(seed), c), 256)
    drawn = written(outfits.withColumn("_h", digest("outfit_id")).orderBy("_h", "outfit_id").limit(outfit_count), "drawn")
    slots = drawn.select("_h", "outfit_id", F.posexplode("item_ids").alias("at", "item_id"))
    needed = slots.groupBy("item_id").agg(F.min(F.struct("_h", "outfit_id", "at")).alias("first"))
    needed = written(needed.select("item_id", F.row_number().over(W.orderBy("first")).alias("place")), "needed")  # the items of the drawn outfits
    n = needed.count()
    if n > item_count:
        raise ValueError(f"{outfit_count} outfits require {n} items, more than {item_count}")
    rest = items.where("tagged").join(needed, "item_id", "left_anti").withColumn("_h", digest("item_id"))
    turn = rest.withColumn("_turn", F.row_number().over(W.partitionBy("category").orderBy("_h", "item_id"))).where(F.col("_turn") <= item_count - n)
    fill = written(turn.orderBy("_turn", "category").limit(item_count - n), "fill")
    if n + fill.count() < item_count:
        raise ValueError(f"only {n + fill.count()} items for {item_count}")
    filled = fill.select("item_id", (F.row_number().over(W.orderBy("_turn", "category")) + n).alias("place"), F.lit("fill").alias("why"))
    return needed.select("item_id", "place", F.lit("outfit").alias("why")).unionByName(filled)
