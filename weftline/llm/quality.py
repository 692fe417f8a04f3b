"""Quality rules: counts of each text and the perplexity of a modified Kneser-Ney n-gram model of its language.

The model counts n-grams of ORDER whole code points over every document, one model per language; null
languages have one of their own. Counts, the counts of different characters before each shorter n-gram,
discounts and interpolated probabilities are tables that Spark joins and groups by n-gram, so the model
grows with the input and no task holds a language. As every text that is scored was counted too, each of
its n-grams is in the longest table, which alone is kept: 64-bit hashes of language and n-gram with costs
(negative log-probabilities in whole millionths of a nat), packed by ranges of the hash into sorted arrays.
Ranges are sent out together while they are within MODEL_BYTES, else the documents are scored in several
rounds; costs are whole numbers, so their sums don't depend on the rounds.

A document is rejected if a base rule fails, or if the mean negative log-probability of its characters is
outside its language's band: the median over that language's documents that pass the base rules, plus and
minus DEVIATIONS scaled median absolute deviations: the whole numbers that reject most documents of sf0.1
labelled bad while they reject fewer than one in a hundred of those labelled good. GUARD_WIDTH stands in
only for a deviation of 0. Medians come from counts by thousandths of a nat, so they are exact and the
same in each run.

Texts are never cut. A null text counts as empty: no words, base_failed. Repeated rows stay, each with its
own verdict; equal texts of one language get equal verdicts. An empty table gives no rows.

Extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import free_name, small_batches, written

#: Code points of an n-gram, 4 to 6; the last three are packed into one number, those before into another.
ORDER, BITS, LOW = 4, 21, 3
MASK = (1 << BITS) - 1
CODE_POINTS = 0x110000
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Scaled deviations below and above the median; widths in nats where the deviation is 0.
DEVIATIONS, GUARD_WIDTH = (7.0, 4.0), (0.4, 1.0)
MODEL_BYTES, KEY_BYTES, RANGE_KEYS = 64 << 20, 12, 250_000
#: N-grams that a task takes at once; different ones that it keeps before it gives them back.
PIECE, HELD = 500_000, 500_000
STATS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,cost:bigint>"


def ngrams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams that end at each character, as (code points before the last three, last three), in pieces; blanks stand before the text."""
    cp = np.frombuffer((" " * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32)

    def packed(c: np.ndarray, start: int, width: int, n: int) -> np.ndarray:
        out = c[start : start + n].astype(np.int64)
        for k in range(start + 1, start + width):
            out <<= BITS
            out |= c[k : k + n]
        return out

    for at in range(0, len(cp) - ORDER + 1, PIECE):
        c = cp[at : at + PIECE + ORDER - 1]
        n = len(c) - ORDER + 1
        yield packed(c, 0, ORDER - LOW, n), packed(c, ORDER - LOW, LOW, n)


def ngram_keys(hi: np.ndarray, lo: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """64-bit hashes of n-grams of the language with this seed."""
    h = hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h += seed
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= lo.view(np.uint64)
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(by)
        h *= np.uint64(times)
    return h ^ (h >> np.uint64(31))


def seed(lang: str) -> np.uint64:
    from xxhash import xxh64_intdigest

    return np.uint64(xxh64_intdigest(lang.encode()))


def lang_key(lang: Column) -> Column:
    """A language's name in the model: never null, and different for null and empty."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, hi, lo, n) over rows (lang, text), lang as lang_key gives it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        codes: dict[str, int] = {}
        seeds: list[np.uint64] = []
        pending: list[list[np.ndarray]] = []
        taken = 0
        held: list[list[np.ndarray]] = []  # columns: hash, hi, lo, code of the language, n

        def fold() -> None:
            hi, lo, code = (np.concatenate(x) for x in zip(*pending, strict=True))
            pending.clear()
            found = pa.array(ngram_keys(hi, lo, np.array(seeds)[code])).dictionary_encode()
            which, m = found.indices.to_numpy(), len(found.dictionary)
            at = np.empty(m, np.int64)
            at[which] = np.arange(len(which))
            held.append([found.dictionary.to_numpy(), hi[at], lo[at], code[at], np.bincount(which, minlength=m)])

        def add_up() -> None:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.argsort(cols[0], kind="stable")
            cols = [c[order] for c in cols]
            first = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            held[:] = [[*(c[first] for c in cols[:4]), np.add.reduceat(cols[4], first)]]

        def given() -> Iterator[pa.RecordBatch]:
            _, hi, lo, code, n = held.pop()
            for at in range(0, len(n), 100_000):
                to = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(code[to])), pa.array(hi[to]), pa.array(lo[to]), pa.array(n[to].astype(np.int64))], ["lang", "hi", "lo", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                if lang not in codes:
                    codes[lang] = len(names)
                    names.append(lang)
                    seeds.append(seed(lang))
                for hi, lo in ngrams(text):
                    pending.append([hi, lo, np.full(len(hi), codes[lang], np.int32)])
                    taken += len(hi)
                    if taken >= PIECE:
                        taken = 0
                        fold()
                        if sum(len(x[0]) for x in held) > HELD:
                            add_up()
                            if len(held[0][0]) > HELD // 2:
                                yield from given()
        if pending:
            fold()
        if held:
            add_up()
            yield from given()

    small_batches(docs.sparkSession)
    parts = docs.select("lang", "text").mapInArrow(count, "lang string, hi bigint, lo bigint, n bigint")
    return parts.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


def _context() -> list[Column]:
    """(hi, lo) of an n-gram without its last character."""
    hi, lo = F.col("hi"), F.col("lo")
    return [F.shiftright(hi, BITS).alias("c_hi"), F.shiftleft(hi.bitwiseAND(MASK), BITS * (LOW - 1)).bitwiseOR(F.shiftright(lo, BITS)).alias("c_lo")]


def _shorter(order: int) -> list[Column]:
    """(hi, lo) of the last order - 1 characters of an n-gram."""
    n = order - 1
    return [F.col("hi").bitwiseAND((1 << BITS * max(n - LOW, 0)) - 1).alias("s_hi"), F.col("lo").bitwiseAND((1 << BITS * min(n, LOW)) - 1).alias("s_lo")]


def _discounts(types: DataFrame) -> DataFrame:
    """(d_lang, d1, d2, d3): modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    n = {k: F.count_if(F.col("n") == k).cast("double") for k in range(1, 5)}
    by = types.groupBy(F.col("lang").alias("d_lang")).agg(*[n[k].alias(f"n{k}") for k in n])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    some = F.least("n1", "n2", "n3", "n4") > 0
    d = [F.when(some, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0)), F.lit(0.05)), F.lit(float(k)))).otherwise(0.5 * k).alias(f"d{k}") for k in (1, 2, 3)]
    return by.select("d_lang", *d)


def probabilities(docs: DataFrame) -> DataFrame:
    """(lang, hi, lo, p) of all n-grams of ORDER in rows (lang, text)."""
    types = {ORDER: written(count_ngrams(docs), "ngrams")}
    for k in range(ORDER - 1, 0, -1):  # shorter ones count the different characters before them
        shorter = types[k + 1].select("lang", *_shorter(k + 1))
        types[k] = written(shorter.groupBy("lang", F.col("s_hi").alias("hi"), F.col("s_lo").alias("lo")).agg(F.count("*").alias("n")), "ngrams")
    lower = None
    for k in range(1, ORDER + 1):
        rows = types[k].select("lang", "hi", "lo", "n", *_context(), *_shorter(k))
        # the discounts of a context from whole counts, so that no order of addition matters
        seen = [F.count_if(F.col("n") == 1).alias("t1"), F.count_if(F.col("n") == 2).alias("t2"), F.count_if(F.col("n") > 2).alias("t3")]
        context = rows.groupBy(F.col("lang").alias("x_lang"), F.col("c_hi").alias("x_hi"), F.col("c_lo").alias("x_lo")).agg(F.sum("n").alias("total"), *seen)
        both = rows.join(context, (F.col("lang") == F.col("x_lang")) & (F.col("c_hi") == F.col("x_hi")) & (F.col("c_lo") == F.col("x_lo")))
        both = both.join(_discounts(types[k]), F.col("lang") == F.col("d_lang"))
        if lower is None:
            both = both.withColumn("lower_p", F.lit(1.0 / CODE_POINTS))
        else:
            less = lower.select(F.col("lang").alias("l_lang"), F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo"), F.col("p").alias("lower_p"))
            both = both.join(less, (F.col("lang") == F.col("l_lang")) & (F.col("s_hi") == F.col("l_hi")) & (F.col("s_lo") == F.col("l_lo")))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        left = F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")
        p = (F.col("n") - d + left * F.col("lower_p")) / F.col("total")
        lower = written(both.select("lang", "hi", "lo", p.alias("p")), "probabilities")
    return lower


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(part, n, keys, costs) for each range of hashes: all n-grams of all documents, sorted."""

    @F.arrow_udf("bigint")
    def keys(lang: pa.Array, hi: pa.Array, lo: pa.Array) -> pa.Array:
        names = lang.dictionary_encode()
        seeds = np.array([seed(x) for x in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
        return pa.array(ngram_keys(hi.to_numpy(zero_copy_only=False).astype(np.int64), lo.to_numpy(zero_copy_only=False).astype(np.int64), seeds).view(np.int64))

    def packed(group: pa.Table) -> pa.Table:
        key = group.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        cost = group.column("cost").to_numpy()[order].astype(np.int32)
        return pa.table({"part": group.column("part")[:1], "n": pa.array([len(key)], pa.int64()), "keys": pa.array([key[order].tobytes()]), "costs": pa.array([cost.tobytes()])})

    found = probabilities(docs.select(lang_key(docs[lang_col]).alias("lang"), docs[text_col].alias("text")))
    bits = max(int(found.count() / RANGE_KEYS).bit_length(), 1)
    rows = found.select(keys("lang", "hi", "lo").alias("key"), F.round(-1e6 * F.log("p")).cast("bigint").alias("cost"))
    rows = rows.select(F.shiftrightunsigned("key", 64 - bits).alias("part"), "key", "cost")
    return written(rows.groupBy("part").applyInArrow(packed, "part bigint, n bigint, keys binary, costs binary"), "kneser_ney")


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # of bytes, split() knows ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeat = 0
    if n > WINDOW:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        m = n - WINDOW + 1
        w = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            w *= np.uint64(0x9E3779B97F4A7C15)
            w += h[k : k + m]
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(m, bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            step = np.zeros(n + 1, np.int64)
            step[:m] += twice
            step[WINDOW : WINDOW + m] -= twice
            repeat = int((np.cumsum(step[:n]) > 0).sum())
    return n, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def _cost(text: str | None, lang: str, keys: np.ndarray, costs: np.ndarray) -> int:
    """Sum of the costs of the text's n-grams that are among the keys."""
    total = 0
    if text and len(keys):
        for hi, lo in ngrams(text):
            key = ngram_keys(hi, lo, seed(lang))
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            total += int(costs[at][keys[at] == key].sum(dtype=np.int64))
    return total


def _arrays(model) -> tuple[np.ndarray, np.ndarray]:
    parts = model.value if model is not None else []
    return tuple(np.frombuffer(b"".join(p[k] for p in parts), kind) for k, kind in enumerate((np.uint64, np.int32)))


def stats_column(text: Column, lang: Column, model) -> Column:
    """STATS of whole texts. model: a broadcast list of (keys, costs) by ascending range, or None for costs of 0."""

    @F.arrow_udf(STATS)
    def stats(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        arrays = _arrays(model)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cost")
        kind = pa.struct([(k, pa.int64()) for k in names])
        for texts, langs in batches:
            rows = [dict(zip(names, (*text_stats(t), _cost(t, x, *arrays)), strict=True)) for t, x in zip(texts.to_pylist(), langs.to_pylist(), strict=True)]
            yield pa.array(rows, kind)

    return stats.asNondeterministic()(text, lang_key(lang))


def cost_column(text: Column, lang: Column, model) -> Column:
    """Sums of the costs that one round's model gives."""

    @F.arrow_udf("bigint")
    def costs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        arrays = _arrays(model)
        for texts, langs in batches:
            yield pa.array([_cost(t, x, *arrays) for t, x in zip(texts.to_pylist(), langs.to_pylist(), strict=True)], pa.int64())

    return costs.asNondeterministic()(text, lang_key(lang))


def _rounds(models: DataFrame, limit: int) -> list[tuple[int, int]]:
    """First and last range of each round; a round's ranges are within the limit together, or one."""
    out: list[list[int]] = []
    size = 0
    for r in models.select("part", "n").orderBy("part").collect():
        size += r["n"] * KEY_BYTES
        if not out or size > limit:
            out.append([r["part"], r["part"]])
            size = r["n"] * KEY_BYTES
        out[-1][1] = r["part"]
    return [tuple(x) for x in out]


def scored(docs: DataFrame, name: str, lang_col: str = "lang", text_col: str = "text", limit: int = MODEL_BYTES) -> DataFrame:
    """docs with a column of STATS under the given name, and in it nll, null for texts without a character."""
    spark = docs.sparkSession
    models = train(docs, lang_col, text_col)
    rounds = _rounds(models, limit)

    def sent(between: tuple[int, int]):
        found = models.where(F.col("part").between(*between)).orderBy("part").collect()
        return spark.sparkContext.broadcast([(bytes(r["keys"]), bytes(r["costs"])) for r in found])

    columns = [F.col(f"`{c}`") for c in docs.columns]
    if len(rounds) <= 1:
        model = sent(rounds[0]) if rounds else None
        out = docs.withColumn(name, stats_column(docs[text_col], docs[lang_col], model))
        cost = F.col(name)["cost"]
    else:
        row, total = free_name(docs, "row"), free_name(docs, "total_cost")
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        costs = None
        for between in rounds:
            model = sent(between)
            own = written(rows.select(row, cost_column(rows[text_col], rows[lang_col], model).alias(total)), "costs")
            costs = own if costs is None else costs.unionByName(own)
            model.destroy()
        out = rows.join(costs.groupBy(row).agg(F.sum(total).alias(total)), row).withColumn(name, stats_column(rows[text_col], rows[lang_col], None))
        cost = F.col(total)
    n = F.char_length(F.col(f"`{text_col}`"))
    s = F.col(name)
    counts = [s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select(*columns, F.struct(*counts, F.when(n > 0, cost / (1e6 * n)).alias("nll")).alias(name))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def bands(stats: DataFrame) -> DataFrame:
    """(band_lang, lower, upper) from rows (lang, nll) of documents that pass the base rules."""

    def median(rows: DataFrame, value: str, name: str) -> DataFrame:
        by = rows.groupBy("lang", value).agg(F.sum("n").alias("n"))
        w = W.partitionBy("lang")
        by = by.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
        return by.where(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min(value).alias(name))

    bins = stats.where("nll is not null").groupBy("lang", F.floor(F.col("nll") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    mid = median(bins, "bin", "mid").withColumnRenamed("lang", "mid_lang")
    off = bins.join(mid, F.col("lang").eqNullSafe(F.col("mid_lang"))).select("lang", "mid", "n", F.abs(F.col("bin") - F.col("mid")).alias("off"))
    mad = median(off, "off", "mad").withColumnRenamed("lang", "mad_lang")
    both = mid.join(mad, F.col("mid_lang").eqNullSafe(F.col("mad_lang")))
    centre = (F.col("mid") + 0.5) / 1000
    low, high = (F.when(F.col("mad") > 0, n * 1.4826 * F.col("mad") / 1000).otherwise(guard) for n, guard in zip(DEVIATIONS, GUARD_WIDTH, strict=True))
    return both.select(F.col("mid_lang").alias("band_lang"), (centre - low).alias("lower"), (centre + high).alias("upper"))


def judged(docs: DataFrame, name: str, lang_col: str = "lang", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all unless given) of docs, and under `name` STATS with base_failed, lower, upper and kept."""
    kept = docs.columns if keep is None else keep
    lang = free_name(docs, "judged_lang")
    rows = scored(docs, name, lang_col, text_col).withColumn(lang, F.col(f"`{lang_col}`"))
    rows = written(rows.select(*[F.col(f"`{c}`") for c in kept], lang, name), "quality_scores")
    s = rows[name]
    limits = bands(rows.where(~base_failed(s)).select(rows[lang].alias("lang"), s["nll"].alias("nll")))
    limits = limits.select(*[F.col(c).alias(free_name(rows, c)) for c in limits.columns])
    b_lang, low, high = limits.columns
    joined = rows.join(limits, rows[lang].eqNullSafe(limits[b_lang]), "left")
    s = F.col(name)
    inside = F.coalesce((s["nll"] >= F.col(low)) & (s["nll"] <= F.col(high)), F.lit(True))
    verdict = F.struct(*[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "nll")], base_failed(s).alias("base_failed"), F.col(low).alias("lower"), F.col(high).alias("upper"), (~base_failed(s) & inside).alias("kept"))
    return joined.select(*[F.col(f"`{c}`") for c in kept], verdict.alias(name))


def quality(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, nll, base_failed, lower, upper, kept."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    return judged(rows, "q", keep=["doc_id"]).select("doc_id", "q.*")


def keep_good(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns."""
    name = free_name(docs, "quality")
    return judged(docs, name, lang_col, text_col).where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
