"""Language identification by a blended-spectrum string kernel.

The kernel of two texts counts the character n-grams (1 to 4, without case) that both hold, each once, over
the square root of the product of what each holds. Landmarks (Nyström) stand for the training texts: a text
is described by its kernels with them, whitened by the landmarks' own kernel matrix, and one ridge
regression per language (one against the rest, targets 1 and -1) scores the description. The n-grams that
count are those of the landmarks. A batch of texts is a 0/1 matrix over them, so its kernels are one matrix
product with the landmarks' matrix and its scores a second one.

Learning uses a bounded sample, whatever the input: for each language the first `sample` training documents
by a hash of their id, of at most `max_chars` characters, the first `landmarks` of them as landmarks (whole
texts throughout). Training documents have an id with crc32 modulo 5 not 0, a language, and a letter.
Scoring covers all documents, whole texts.

A text that is null or has no letter is "und" with score 0, as is all text if nothing could be learned. A
null id is never used for learning, and is not held out. Repeated rows stay; of rows that share an id one is learned
from, that with the least hash of its text. An empty table gives no rows. Very long texts are scored whole. Ties between languages go to
the first by name. The score is the winner's regression value moved from -1..1 to 0..1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, written

MAX_N = 4
SAMPLE, LANDMARKS, MAX_CHARS = 300, 40, 20_000
RIDGE, JITTER = 1e-3, 1e-6
#: Parts of a language's documents that are ranked apart before the best of them are ranked together.
SLOTS = 64
FOLDS = 5
UNKNOWN = "und"
#: Cells of a batch's 0/1 matrix.
CELLS = 8_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> Iterator[np.ndarray]:
    """For each n, the 64-bit codes of a text's n-grams."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    code = cp
    for n in range(1, MAX_N + 1):
        if n > 1:
            code = code[:-1] * _STEP + cp[n - 1 :]
        if not len(code):
            return
        yield code


def gram_set(text: str) -> np.ndarray:
    return np.unique(np.concatenate([*grams(text), np.zeros(0, np.uint64)]))


@dataclass
class Model:
    """Landmarks, and the weights that turn kernels with them into scores."""

    languages: list[str]
    codes: np.ndarray
    marks: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        bits = max(12, int(len(self.codes) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, np.int32)
        left, at, k = np.arange(len(self.codes)), self._home(self.codes), 0
        self.probes = 0
        while len(left):  # open addressing, all codes of one probe at a time
            self.probes += 1
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            placed = self.slot[at] == left
            left, at = left[~placed], (at[~placed] + np.uint64(1)) & self.mask
        self.size = np.sqrt(np.maximum(self.marks.sum(axis=0), 1)).astype(np.float32)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _STEP) >> self.shift

    def present(self, text: str, row: np.ndarray) -> None:
        """Set the cells of the text's n-grams in a row."""
        for code in grams(text):
            at = self._home(code)
            for _ in range(self.probes):
                found = self.slot[at]
                used = found >= 0
                hit = used & (self.codes[found] == code)
                row[found[hit]] = 1
                on = used & ~hit
                if not on.any():
                    break
                code, at = code[on], (at[on] + np.uint64(1)) & self.mask

    def kernels(self, texts: list[str]) -> np.ndarray:
        """Kernels of each text with each landmark."""
        out = np.zeros((len(texts), self.marks.shape[1]), np.float32)
        step = max(1, CELLS // max(1, len(self.codes)))
        for a in range(0, len(texts), step):
            x = np.zeros((len(texts[a : a + step]), len(self.codes)), np.float32)
            for row, t in zip(x, texts[a : a + step], strict=True):
                self.present(t, row)
            out[a : a + step] = (x @ self.marks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) / self.size
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernels(texts) @ self.weights


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, max_chars: int = MAX_CHARS, ridge: float = RIDGE) -> Model | None:
    """Learn from rows (doc_id, lang, text); None if there is nothing to learn from."""
    spark = docs.sparkSession
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.char_length("text") <= max_chars) & has_letter(F.col("text")) & ~held_out(F.col("doc_id")))
    # one row an id, told by the hash of its text, so that rows that share an id count once
    narrow = usable.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "lang")).alias("one")).select("doc_id", "one.lang", "one.t", F.xxhash64("doc_id").alias("h"))
    # first the best of each slot of a language, then the best of those: no language's rows meet in one task
    for keys in (["lang", "slot"], ["lang"]):
        order = W.partitionBy(*keys).orderBy("h", "doc_id")
        narrow = narrow.withColumn("slot", F.pmod(F.col("h"), F.lit(SLOTS))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
    chosen = narrow.select("doc_id", "lang", "t", "rank")
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # at most `sample` ids for each language
    train = usable.withColumn("t", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "lang", "t"])
    train = train.groupBy("doc_id", "lang", "rank").agg(F.min("text").alias("text"))  # equal rows are one
    train = written(train.select("doc_id", "lang", "rank", "text"), "language_sample")  # bounded by `sample` and `max_chars`

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("doc_id"), b.column("rank"), pa.array([gram_set(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["lang", "doc_id", "rank", "codes"])

    found = sorted((r["lang"], r["rank"], bytes(r["codes"])) for r in train.where(F.col("rank") <= landmarks).mapInArrow(sets, "lang string, doc_id bigint, rank int, codes binary").collect())
    if not found:
        return None
    codes_of = [np.frombuffer(c, np.uint64) for _, _, c in found]
    codes = np.unique(np.concatenate(codes_of))
    marks = np.zeros((len(codes), len(found)), np.float32)
    for k, own in enumerate(codes_of):
        marks[np.searchsorted(codes, own), k] = 1
    languages = sorted({lang for lang, _, _ in found})
    model = Model(languages, codes, marks, np.zeros((len(found), len(languages)), np.float32))
    sent = spark.sparkContext.broadcast(model)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = sent.value.kernels(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("rank"), pa.array([x.tobytes() for x in k], pa.binary())], ["lang", "rank", "k"])

    rows = sorted((r["lang"], r["rank"], bytes(r["k"])) for r in train.mapInArrow(kernels, "lang string, rank int, k binary").collect())
    k = np.frombuffer(b"".join(x for _, _, x in rows), np.float32).reshape(len(rows), -1).astype(float)
    y = np.array([[1.0 if lang == own else -1.0 for own in languages] for lang, _, _ in rows])
    own = (marks.T @ marks).astype(float) / np.outer(model.size, model.size)
    value, vector = np.linalg.eigh(own + JITTER * np.eye(len(own)))
    white = vector / np.sqrt(np.maximum(value, JITTER)) @ vector.T
    phi = k @ white
    w = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(languages, codes, marks, (white @ w).astype(np.float32))


def predicted_column(text: Column, model) -> Column:
    """struct<lang_pred, score> of whole texts; model: a broadcast Model or None."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        for batch in batches:
            texts = batch.to_pylist()
            known = [k for k, t in enumerate(texts) if t is not None and m is not None]
            out = [{"lang_pred": UNKNOWN, "score": 0.0}] * len(texts)
            if known:
                scores = m.scores([texts[k] for k in known])
                for k, best, s in zip(known, scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist(), strict=True):
                    out[k] = {"lang_pred": m.languages[best], "score": min(max((s + 1) / 2, 0.0), 1.0)}
            yield pa.array(out, kind)

    return predict.asNondeterministic()(text)


def identify(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Other columns are left out, so their names can't clash."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    model = spark.sparkContext.broadcast(fit(rows, **options))
    p = rows.select("doc_id", predicted_column(F.when(has_letter(F.col("text")), F.col("text")), model).alias("p"))
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")
