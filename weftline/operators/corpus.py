"""Text corpora: exact duplicates, quality flags, families, frequencies, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import free_name, mixed_script, set_overlap, tokens
from weftline.operators.catalog import latest


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(digest, first, copies) of each different text."""
    return docs.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest")).agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))


def dialogue_flags(dialogues: DataFrame, max_words: int = 280, echo: float = 0.65) -> DataFrame:
    """Quality flags of (prompt, answer): mixed script, too long, answer's first sentence echoes the prompt."""
    words = F.size(F.filter(F.split("answer", r"[ \t\n\x0B\f\r]+"), lambda x: x != ""))
    first = F.split("answer", r"[.!?\n]").getItem(0)
    overlap = set_overlap(F.array_distinct(tokens(F.col("prompt"))), F.array_distinct(tokens(first)))
    both = dialogues.where("prompt is not null and answer is not null")
    out = both.select("conv_id", words.cast("bigint").alias("n_words"), F.bround(overlap, 6).alias("echo_overlap"), (mixed_script(F.col("prompt")) | mixed_script(F.col("answer"))).alias("mixed_script"))
    return out.withColumn("too_long", F.col("n_words") > max_words).withColumn("question_echo", F.col("echo_overlap") >= echo)


def families(docs: DataFrame, text: str = "text", words: int = 3, least: int = 3) -> DataFrame:
    """(family, n): texts by their first content words."""
    content = F.filter(tokens(F.col(text)), lambda t: F.char_length(t) >= least)
    key = F.when(F.size(content) >= words, F.array_join(F.slice(content, 1, words), " ")).otherwise(F.lower(text))
    return docs.groupBy(key.alias("family")).agg(F.count("*").alias("n"))


def family_sizes(found: DataFrame) -> DataFrame:
    """(bucket, families, texts): histogram of family sizes."""
    n = F.col("n")
    bucket = F.when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")
    return found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("families"), F.sum("n").alias("texts"))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n_docs)."""
    each = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n_docs"))


def stratified_split(rows: DataFrame, key: str, stratum: str, share: float = 0.1, seed: str = "42") -> DataFrame:
    """rows with is_eval: of each stratum the first by hash order, its share rounded half to even and one at least."""
    digest, part, before, every, place = (free_name(rows, c) for c in ("digest", "part", "before", "every", "place"))
    marked = rows.withColumn(digest, F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)).withColumn(part, F.substring(digest, 1, 4))
    # a stratum is counted by ranges of the hash, so no task orders a whole stratum
    sizes = marked.groupBy(F.col(stratum).alias("s_stratum"), F.col(part).alias("s_part")).agg(F.count("*").alias("s_size"))
    w = W.partitionBy("s_stratum")
    sizes = sizes.select("s_stratum", "s_part", F.coalesce(F.sum("s_size").over(w.orderBy("s_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum("s_size").over(w).alias(every))
    both = marked.join(sizes, F.col(stratum).eqNullSafe(F.col("s_stratum")) & (F.col(part) == F.col("s_part")))
    both = both.withColumn(place, F.col(before) + F.row_number().over(W.partitionBy(stratum, part).orderBy(digest, key)))
    return both.select(*rows.columns, (F.col(place) <= F.greatest(F.lit(1), F.bround(F.col(every) * share, 0))).alias("is_eval"))


def last_event(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Replay of a log: the last event of each key."""
    return latest(events, [key], [F.desc(c) for c in order])


def distinct_first(rows: DataFrame, signature: Column, position: str) -> DataFrame:
    """The rows without repeats of a signature: of each the first by position."""
    name = free_name(rows, "signature")
    return latest(rows.withColumn(name, F.sha2(signature, 256)), [name], [F.col(position)]).drop(name)


def word_stats(rows: DataFrame, words: str) -> DataFrame:
    """(mean, median, p90, most, total, approx_tokens) of a column of word counts; zeros for no rows."""
    by = rows.groupBy(F.col(words).alias("v")).agg(F.count("*").alias("c")).withColumn("g", F.lit(1))
    w = W.partitionBy("g")
    placed = by.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("every", F.sum("c").over(w))

    def at(q: float) -> Column:
        return F.coalesce(F.min(F.when(F.col("upto") > F.bround((F.col("every") - 1) * F.lit(q), 0), F.col("v"))), F.lit(0)).cast("double")

    total = F.coalesce(F.sum(F.col("v") * F.col("c")), F.lit(0))
    return placed.agg(F.bround(F.coalesce(total / F.sum("c"), F.lit(0.0)), 2).alias("mean"), at(0.5).alias("median"), at(0.9).alias("p90"), F.coalesce(F.max("v"), F.lit(0)).alias("most"), total.alias("total"), F.bround(total * F.lit(1.25), 0).cast("bigint").alias("approx_tokens"))


def top_tags(rows: DataFrame, group: str, tags: str) -> DataFrame:
    """(group, top_tag): the most frequent tag that is not blank of each group, of equal ones the first by name; a null group is "unknown"."""
    each = rows.select(F.coalesce(F.col(group), F.lit("unknown")).alias(group), F.explode(tags).alias("tag")).where("trim(tag) <> ''")
    counts = each.groupBy(group, "tag").agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("top_tag"))


def group_distribution(rows: DataFrame, group: str, flags: list[str], value: str, tags: str) -> DataFrame:
    """By group (null as "unknown"): total, the share of each flag, linear p50, p90 and the maximum of a value, and the top tag."""
    named = rows.withColumn(group, F.coalesce(F.col(group), F.lit("unknown")))
    shares = [F.bround(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")), 6).alias(f"{f}_share") for f in flags]
    by = named.groupBy(group).agg(F.count("*").alias("total"), *shares, F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("most"))
    return by.join(top_tags(named, group, tags), group, "left")


def model_summary(log: DataFrame, model: str) -> DataFrame:
    """By model over a tagging log (ok, body_shapes, seasons, note, latency_s): total, ok, how many with each tag, mean latency of all rows with one (3 decimals)."""
    has = lambda c: F.count_if(F.coalesce(F.size(c) > 0, F.lit(False)))
    return log.groupBy(model).agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), has("body_shapes").alias("with_body"), has("seasons").alias("with_season"), F.count_if(F.coalesce(F.trim("note"), F.lit("")) != "").alias("with_note"), F.bround(F.coalesce(F.avg("latency_s"), F.lit(0.0)), 3).alias("mean_latency"))
