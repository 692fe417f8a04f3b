"""Mixing sources to target weights by Pareto order sampling.

The mix is as large as its input. Each source gets a share by its weight, at most `cap` times its own size;
the excess goes to the other sources by weight until none is above its cap. Within a source a document's
expected number of copies is c * w: w grows with the power `length_power` of the document's size class, and
c is such that the expected words meet the target with no document above `cap` copies. The whole part of
that number is certain. For the rest, documents are ranked by their random odds divided by their inclusion
odds, u/(1-u) / (p/(1-p)), and taken in this order up to the words that are left of the target.

u comes from the MD5 of the document's id and a seed, so reruns agree. The cut is found from the words of
each of 65,536 ranges of rank, and only the range in which it falls is ranked row by row, so no source's
documents meet in one task.

Null texts and texts without words have size 0 and take no part in the sums; a source without any words has
target 0. Null sources are one source and come last. Rows with one doc_id are drawn together: their order is
by size, then by text hash. An empty table gives no rows.

Texts of any length are counted whole. Extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import n_words, written

WEIGHTS = (5, 2, 1)
CAP = 3
LENGTH_POWER = 0.125
RANK_BITS = 16
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    A source is capped if it would be above its cap with all sources capped that have a smaller ratio of size to weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    total, before = W.partitionBy(), W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("all_size", F.sum("source_size").over(total)).withColumn("all_weight", F.sum("weight").over(total))
    by = by.withColumn("left_size", F.col("all_size") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    by = by.withColumn("rate", F.when(F.col("left_size") * F.col("weight") <= cap * F.col("source_size") * F.col("left_weight"), F.try_divide("left_size", "left_weight")))
    by = by.withColumn("rate", F.max("rate").over(total))
    target = F.least(F.col("weight") * F.coalesce("rate", F.lit(float("inf"))), cap * F.col("source_size").cast("double"))
    return by.select("source", "source_size", target.alias("target"))


def _expected(sizes: DataFrame, targets: DataFrame, cap: float, power: float) -> DataFrame:
    """(source, class, target, source_size, c * w as copies): the expected copies of a document by source and size class."""
    classes = sizes.groupBy("source", "class").agg(F.sum("size").alias("words")).withColumn("w", F.pow(F.lit(2.0), F.col("class") * power))
    cols = classes.join(targets, classes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    # classes with the largest w reach the cap first
    before = W.partitionBy("source").orderBy(F.desc("w")).rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy("source").orderBy(F.desc("w")).rowsBetween(0, W.unboundedFollowing)
    c = F.try_divide(F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0)), F.sum(F.col("w") * F.col("words")).over(onward))
    cols = cols.withColumn("c", c)
    cols = cols.withColumn("c", F.max(F.when((F.col("c") * F.col("w") <= cap * (1 + 1e-12)), F.col("c"))).over(W.partitionBy("source")))
    copies = F.when(F.col("words") == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.coalesce(F.col("c") * F.col("w"), F.lit(float(cap)))))
    return cols.select("source", "class", "source_size", "target", copies.alias("copies"))


def _mixed(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, power: float, seed: int) -> DataFrame:
    """Rows (kept struct of the columns to keep, size, source_size, target, copies)."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("long")
    text = docs[text_col]
    size = n_words(text)
    rows = docs.select(
        F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(keep)]).alias("kept"),
        docs[id_col].alias("id"),
        docs[source_col].alias("source"),
        size.alias("size"),
        draw.alias("draw"),
        F.xxhash64(text).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(-1).cast("int"))
    # words are counted once; the table as written fixes the row numbers, so the cut is found on narrow rows
    rows = written(rows, "sizes")
    narrow = rows.drop("kept")
    expected = written(_expected(narrow, source_targets(narrow, weights, cap), cap, power), "expected_copies")
    cuts = written(_cuts(_ranked(narrow, expected)), "cuts").withColumnRenamed("source", "cut_source")
    at_cut = F.col("range").eqNullSafe(F.col("at"))
    counted = F.when(F.col("p") > 0, F.col("size")).otherwise(0)
    order = W.partitionBy("source").orderBy("rank", "id", "size", "tie", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    # the document at the cut is taken if at least half of it is needed
    edge = _placed(narrow, expected, cuts).where(at_cut).withColumn("reach", F.col("had") + F.sum(counted).over(order))
    edge = edge.where((F.col("p") > 0) & (F.col("reach") - counted / 2.0 <= F.col("need")))
    edge = written(edge.select(F.col("row").alias("edge_row")), "taken_at_cut")
    placed = _placed(rows, expected, cuts).join(edge, at_cut & (F.col("row") == F.col("edge_row")), "left")
    more = F.when(at_cut, F.col("edge_row").isNotNull()).otherwise((F.col("p") > 0) & (F.col("range") <= F.col("below")))
    return placed.select("kept", "size", "source_size", "target", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long").alias("copies"))


def _placed(rows: DataFrame, expected: DataFrame, cuts: DataFrame) -> DataFrame:
    """Ranked rows with their source's cut."""
    return _ranked(rows, expected).join(cuts, F.col("source").eqNullSafe(F.col("cut_source")))


def _ranked(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """rows with whole copies, the inclusion probability p of one more, rank between 0 and 1, and the rank's range."""
    drawn = rows.join(expected, rows["source"].eqNullSafe(expected["source"]) & (rows["class"] == expected["class"])).drop(expected["source"], expected["class"])
    drawn = drawn.withColumn("whole", F.floor(F.col("copies") + 1e-9)).withColumn("p", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)))
    u = (F.col("draw") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    drawn = drawn.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(1.0))
    return drawn.withColumn("range", F.least(F.floor(F.col("rank") * (1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)))


def _cuts(ranked: DataFrame) -> DataFrame:
    """For each source: need (words left of its target behind the certain copies), below (the last range taken whole), had (its words and those before it), at (the range of the cut)."""
    by = ranked.groupBy("source", "range").agg(F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    whole = W.partitionBy("source")
    upto = whole.orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    by = by.withColumn("need", F.col("target") - F.sum("certain").over(whole)).withColumn("upto", F.sum("words").over(upto))
    taken = F.col("upto") <= F.col("need")
    return by.groupBy("source").agg(
        F.first("need").alias("need"),
        F.max(F.when(taken, F.col("range"))).alias("below"),
        F.coalesce(F.max(F.when(taken, F.col("upto"))), F.lit(0)).alias("had"),
        F.min(F.when(~taken, F.col("range"))).alias("at"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, length_power: float = LENGTH_POWER, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies (how often the mix takes it), taken (words)."""
    rows = _mixed(docs, [id_col], id_col, text_col, source_col, weights, cap, length_power, seed)
    return rows.select(F.col("kept.c0").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, length_power: float = LENGTH_POWER, seed: int = SEED) -> DataFrame:
    """The documents, with all their columns, each as often as the mix takes it."""
    rows = _mixed(docs, docs.columns, id_col, text_col, source_col, weights, cap, length_power, seed).where("copies > 0")
    rows = rows.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(f"kept.c{k}").alias(c) for k, c in enumerate(docs.columns)])
