"""Whitening of embeddings: covariance by Chan's merging, eigenvectors on the driver, checked by a second pass.

A component c counts as x = floor(1024 * c) + 100000. The first pass gives one summary a partition: the number of
vectors, the exact sums by dimension, the mean, and the scatter of the vectors about that mean. Two summaries merge by
Chan's formula (scatter a + scatter b + the outer product of the difference of the means times n_a * n_b / n), in
treeReduce, so nothing is ever squared before it is centred and no more than a few matrices meet in one place. The
driver gets one summary of (dimensions)^2 numbers and its eigenvectors. The second pass projects all vectors, merges
the scatter of the projections in the same way and gives the largest departure of their covariance from the identity.

Vectors that are null or hold a null or a component that isn't finite are dropped. Where lengths differ, missing
components are 0 (x = 100000). Components of x are bounded at 2^52 either way. A null id stays null, repeated rows stay,
each counts. An empty table, or one without usable vectors or dimensions, gives no rows. Fewer dimensions than
`components` give as many components. A direction in which the vectors don't vary (eigenvalue below 1e-12 of the
largest, or 0) can't be whitened: whitened is 0 there, explained is what it is (0 if nothing varies), and the check
leaves it out. deviation is null where it doesn't fit a long. Other columns are left out, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.topk import SCALE, vectors

OFFSET = 100_000
COMPONENTS = 8
#: Largest size of x, and the share of the largest eigenvalue below which a direction doesn't vary.
MOST, FLAT = 2.0**52, 1e-12
BATCH_ROWS = 8192


def shifted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, no_id, x) of a batch's usable vectors."""
    for ids, no_id, x in vectors(batch, SCALE):
        yield ids, no_id, np.clip(x + OFFSET, -MOST, MOST)


@dataclass
class Summary:
    """n vectors: sums (exact, whole numbers), mean, scatter about the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    def padded(self, dims: int, fill: float) -> "Summary":
        """With more dimensions, in which all vectors hold the same."""
        more = dims - len(self.mean)
        if not more:
            return self
        return Summary(self.n, self.sums + [self.n * int(fill)] * more, np.append(self.mean, np.full(more, fill)), np.pad(self.scatter, (0, more)))


def summary(x: np.ndarray, whole: bool = True) -> Summary:
    sums = [sum(map(int, c)) if len(c) * np.abs(c).max(initial=0) >= 2**53 else int(c.sum()) for c in x.T] if whole else [0] * x.shape[1]
    mean = x.mean(axis=0)
    centred = x - mean
    return Summary(len(x), sums, mean, centred.T @ centred)


def merged(a: Summary | None, b: Summary | None, fill: float = OFFSET) -> Summary | None:
    """Chan's formula."""
    if a is None or b is None:
        return a or b
    dims = max(len(a.mean), len(b.mean))
    a, b = a.padded(dims, fill), b.padded(dims, fill)
    n = a.n + b.n
    apart = b.mean - a.mean
    return Summary(n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], a.mean + apart * (b.n / n), a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def reduced(rows: DataFrame, summarize) -> Summary | None:
    """The merged summary of all partitions; summarize: a function of record batches that gives one Summary or None."""
    fields = "n bigint, sums array<string>, mean binary, scatter binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = summarize(batches)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([s.n]), pa.array([list(map(str, s.sums))]), pa.array([s.mean.tobytes()]), pa.array([s.scatter.tobytes()])], ["n", "sums", "mean", "scatter"])

    def read(row) -> Summary:
        mean = np.frombuffer(bytes(row["mean"]))
        return Summary(row["n"], list(map(int, row["sums"])), mean, np.frombuffer(bytes(row["scatter"])).reshape(len(mean), len(mean)))

    each = rows.mapInArrow(partial, fields).rdd.map(read)
    return each.treeReduce(merged) if each.getNumPartitions() and not each.isEmpty() else None


def covariance(rows: DataFrame) -> Summary | None:
    """First pass over (id, vector)."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Summary | None:
        out = None
        for batch in batches:
            for _, _, x in shifted(batch):
                out = merged(out, summary(x))
        return out

    return reduced(rows, summarize)


@dataclass
class Whitening:
    """What turns x into whitened components: mean, a column of weights a component, their shares of the variance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    weights: np.ndarray
    explained: np.ndarray
    varies: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.weights

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, len(self.mean) - x.shape[1])), constant_values=OFFSET)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2 of each row, exact; None beyond a long."""
        most = self.n * (np.abs(x).max(initial=0) + np.abs(self.mean).max(initial=0)) + 1
        if most < 2**62:
            apart = x.astype(np.int64) * self.n - np.array(self.sums, np.int64)
            if float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 2**62:
                return (apart**2).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]
        return [e if e < 2**63 else None for e in exact]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from all usable vectors of (id, vector); None without any."""
    s = covariance(rows)
    if s is None or not len(s.mean):
        return None
    # the mean from exact sums: a double each, without what merging rounds
    mean = np.array([t / s.n for t in s.sums])
    v = s.scatter / s.n
    value, vector = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-value, kind="stable")[:components]
    value, vector = np.maximum(value[order], 0), vector[:, order]
    varies = value > FLAT * value.max(initial=0)
    weights = np.where(varies, vector / np.sqrt(np.where(varies, value, 1)), 0)
    total = float(np.trace(v))
    return Whitening(s.n, s.sums, mean, weights, value / total if total > 0 else value * 0, varies)


def identity_error(rows: DataFrame, model) -> float:
    """Second pass: the largest absolute entry of the covariance of whitened minus the identity, over the directions that vary. model: a broadcast Whitening."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Summary | None:
        out = None
        for batch in batches:
            for _, _, x in shifted(batch):
                out = merged(out, summary(model.value.whitened(model.value.padded(x)), whole=False))
        return out

    s, varies = reduced(rows, summarize), model.value.varies
    apart = (s.scatter / s.n - np.eye(len(varies)))[np.ix_(varies, varies)]
    return float(np.abs(apart).max(initial=0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    rows = rows.select(rows[id_col].cast("bigint").alias("vec_id"), rows[vector_col].alias("v")).where("v is not null")
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"
    fitted = fit(rows, components)
    if fitted is None:
        return spark.createDataFrame([], schema).select(F.col("vec_id").cast(kind), *[c.split()[0] for c in schema.split(", ")[1:]], F.lit(0.0).alias("identity_error"))
    model = spark.sparkContext.broadcast(fitted)  # (dimensions) x (components) numbers
    error = identity_error(rows, model)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = m.weights.shape[1]
        for batch in batches:
            for ids, no_id, x in shifted(batch):
                x = m.padded(x)
                columns = [
                    pa.array(np.repeat(ids, k), mask=np.repeat(no_id, k)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, m.n)),
                    pa.array([d for d in m.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(m.whitened(x).ravel()),
                    pa.array(np.tile(m.explained, len(x))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    found = rows.mapInArrow(give, schema)
    return found.withColumn("vec_id", F.col("vec_id").cast(kind)).withColumn("identity_error", F.lit(error))
