"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Components count as floor(scale * x). The candidates stand in blocks of at most CELLS components. For each block and
dimension there is a sorted list of (value, row). A group of queries reads a block's lists in sequence, from the high
end where a query's weight is positive and from the low end where it is negative, STEPS deep at a time. What was read
is exact; what was not is at best what the list showed last, at worst the list's other end. That gives each candidate
a lower and an upper bound for each query, by two matrix products a side. A candidate stays in the race for a query as
long as its upper bound reaches the k-th best lower bound (of this block, or of the blocks before). A query stops
reading when at most FEW candidates of the block stay; their final scores are resolved, and the k best of all blocks
so far go on. Lists that are read to their end give exact scores.

Candidates are never compared outside of this: blocks meet query groups by (group, slice of blocks), each such cell is
one key, its blocks pass through a worker one at a time, and k rows a query and cell are merged in Spark. Equal scores
go to the smaller id, a null id last.

Vectors that are null or hold a null or a component that isn't finite take no part. An empty vector takes part; where
lengths differ, what is missing counts as 0. Rows that repeat are candidates each, and queries each; a query leaves
out its own row only, not another with its id. A row without id is a candidate, never a query. An empty table gives no
rows. Other columns are left out, so their names can't clash. Scores are exact up to 2^63 and the nearest long beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, partitions, scratch

SCALE = 1024
#: Components of a block of candidates, and of a group of queries.
CELLS = 1 << 18
#: Rows that are read of an input batch at once, and blocks of an Arrow batch.
INPUT_ROWS, BLOCKS = 4096, 4
#: How deep the lists are read at each step, as a share of their length.
STEPS = (0.5, 0.75, 0.875, 0.9375, 1.0)
#: A query stops reading when no more than this share of a block is left.
FEW = 1 / 64
#: Queries that are scored at once.
AT_ONCE = 256
BLOCK = "dims int, ids binary, no_id binary, lists binary, places binary"
FOUND = "grp int, query int, query_id bigint, vec_id bigint, score bigint, is_own boolean"


def vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, no_id, matrix) of a batch's usable vectors, those of one length together."""
    ids, found = batch.column(0), batch.column(1)
    if not len(batch):
        return
    size = found.value_lengths().to_numpy(zero_copy_only=False)  # nan: no vector
    flat = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nan: no component
    known = ~np.isnan(size)
    length = np.where(known, size, 0).astype(np.int64)
    start = np.cumsum(length) - length
    no_id = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(length[known]).tolist():
        rows = np.flatnonzero(known & (length == d))
        x = flat[(start[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)
        good = np.isfinite(x).all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(x[good] * scale), -1e300, 1e300)
            yield number[rows[good]], no_id[rows[good]], x


class _Gathered:
    """Rows that wait until there are enough of one length."""

    def __init__(self, cells: int):
        self.cells, self.parts = cells, {}

    def add(self, ids, no_id, x):
        """Full blocks."""
        d = x.shape[1]
        most = max(1, self.cells // max(d, 1))
        parts = self.parts.setdefault(d, [])
        parts.append((ids, no_id, x))
        while sum(len(p[0]) for p in parts) >= most:
            whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield tuple(c[:most] for c in whole)
            parts[:] = [tuple(c[most:] for c in whole)]

    def rest(self):
        for parts in self.parts.values():
            if sum(len(p[0]) for p in parts):
                yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _sorted_lists(scale: int, cells: int):
    """Rows (id, vector) to blocks: for each dimension the values in ascending order and the rows that hold them."""

    def block(ids, no_id, x):
        places = np.argsort(x, axis=0, kind="stable").T
        lists = np.take_along_axis(x.T, places, axis=1)
        return [x.shape[1], ids.tobytes(), no_id.tobytes(), lists.astype("<f8").tobytes(), places.astype("<u4").tobytes()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = _Gathered(cells)
        for batch in batches:
            for part in vectors(batch, scale):
                for full in waiting.add(*part):
                    yield _rows([block(*full)], BLOCK)
        for last in waiting.rest():
            yield _rows([block(*last)], BLOCK)

    return pack


def _rows(rows: list[list], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _pack_queries(scale: int):
    """The queries of a partition as one row for each length: (grp, dims, ids, vectors)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for batch in batches:
            for ids, _, x in vectors(batch, scale):
                by.setdefault(x.shape[1], []).append((ids, x))
        grp = TaskContext.get().partitionId()
        for d, parts in by.items():
            yield _rows([[grp, d, np.concatenate([p[0] for p in parts]).tobytes(), np.concatenate([p[1] for p in parts]).astype("<f8").tobytes()]], "grp int, dims int, ids binary, vectors binary")

    return pack


class _Race:
    """The k best candidates of each query of a group so far, kept sorted."""

    def __init__(self, k: int):
        self.k, self.parts, self.ids = k, [], None

    def add_queries(self, dims: int, ids: bytes, x: bytes) -> None:
        own = np.frombuffer(ids, np.int64)
        self.parts.append((own, np.frombuffer(x, "<f8").reshape(len(own), dims)))

    def begin(self) -> None:
        dims = max(x.shape[1] for _, x in self.parts)
        self.ids = np.concatenate([ids for ids, _ in self.parts])
        self.q = np.concatenate([np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for _, x in self.parts])
        size = (len(self.ids), self.k)
        self.score, self.no_id, self.id = np.full(size, -np.inf, np.longdouble), np.zeros(size, bool), np.zeros(size, np.int64)

    def meet(self, dims: int, ids: bytes, no_id: bytes, lists: bytes, places: bytes) -> None:
        """All queries read a block's lists."""
        ids, no_id = np.frombuffer(ids, np.int64), np.frombuffer(no_id, bool)
        n = len(ids)
        own = min(dims, self.q.shape[1])
        lists = np.frombuffer(lists, "<f8").reshape(dims, n)[:own]
        places = np.frombuffer(places, "<u4").reshape(dims, n)[:own]
        most = np.abs(lists).max(initial=0) * np.abs(self.q).max(initial=0) * max(own, 1)
        exact = np.float64 if most < 2**53 else np.longdouble  # the latter holds every long
        across = np.arange(own)[:, None]
        # weights above 0 read from the high end: what was read, else the last value seen (best) or the low end (worst)
        high_best, high_worst = np.empty((n, own), exact), np.empty((n, own), exact)
        # weights below 0 read from the low end
        low_best, low_worst = np.empty((n, own), exact), np.empty((n, own), exact)
        from_high, from_low = np.zeros((n, own), bool), np.zeros((n, own), bool)
        block = np.empty((n, own), exact)
        block[places, across] = lists
        racing, depth = np.arange(len(self.q)), 0
        for share in STEPS:
            to = n if share >= 1 else int(np.ceil(share * n))
            for seen, best, worst, part in ((from_high, high_best, high_worst, slice(n - to, n - depth)), (from_low, low_best, low_worst, slice(depth, to))):
                rows = places[:, part]
                seen[rows, across] = True
                best[rows, across] = worst[rows, across] = lists[:, part]
            depth = to
            np.copyto(high_best, lists[:, n - depth], where=~from_high)
            np.copyto(high_worst, lists[:, 0], where=~from_high)
            np.copyto(low_best, lists[:, depth - 1], where=~from_low)
            np.copyto(low_worst, lists[:, n - 1], where=~from_low)
            left = []
            for at in range(0, len(racing), AT_ONCE):
                some = racing[at : at + AT_ONCE]
                plus, minus = np.maximum(self.q[some, :own], 0).astype(exact), np.minimum(self.q[some, :own], 0).astype(exact)
                lower = plus @ high_worst.T + minus @ low_worst.T
                upper = lower if depth == n else plus @ high_best.T + minus @ low_best.T
                least = self.score[some, -1].astype(exact)
                if n >= self.k:
                    least = np.maximum(least, np.partition(lower, n - self.k, axis=1)[:, n - self.k])
                stay = upper >= least[:, None]  # equal scores may win by id
                done = stay.sum(axis=1) <= max(2 * self.k, FEW * n) if depth < n else np.full(len(some), True)
                of, cand = np.nonzero(stay & done[:, None])
                score = lower[of, cand] if depth == n else np.einsum("ij,ij->i", self.q[some[of], :own].astype(exact), block[cand])
                self._settle(some, of, score, no_id[cand], ids[cand])
                left.append(some[~done])
            racing = np.concatenate(left)
            if not len(racing):
                return

    def _settle(self, some: np.ndarray, of: np.ndarray, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        """Final scores join the best of some queries; of: place of the query among them."""
        has, k = np.unique(of), self.k
        own = some[has]
        of = np.concatenate([np.repeat(has, k), of])
        score, no_id, ids = (np.concatenate([old[own].ravel(), new]) for old, new in ((self.score, score), (self.no_id, no_id), (self.id, ids)))
        order = np.lexsort((ids, no_id, -score, of))
        start = np.searchsorted(of[order], has)
        keep = order[(start[:, None] + np.arange(k)).ravel()]
        for best, new in ((self.score, score), (self.no_id, no_id), (self.id, ids)):
            best[own] = new[keep].reshape(-1, k)

    def result(self, grp: int) -> pa.RecordBatch:
        """A row (grp, query, query_id, vec_id, score, is_own) for each of the best."""
        query, at = np.nonzero(self.score > -np.inf)
        score = np.clip(self.score[query, at], -(2**63), 2**63 - 1).astype(np.int64)
        own_score = np.clip((self.q.astype(np.longdouble) ** 2).sum(axis=1), 0, 2**63 - 1).astype(np.int64)
        is_own = ~self.no_id[query, at] & (self.id[query, at] == self.ids[query]) & (score == own_score[query])
        columns = [pa.array(np.full(len(query), grp, np.int32)), pa.array(query.astype(np.int32)), pa.array(self.ids[query]), pa.array(self.id[query, at], mask=self.no_id[query, at]), pa.array(score), pa.array(is_own)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def _races(k: int):
    """Sorted rows of cells (grp, slice), each the group's queries and then blocks, to the k best of each query and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, race = None, None
        for batch in batches:
            for r in range(len(batch)):
                grp, part, is_block, dims, ids, no_id, lists, places = (c[r].as_py() for c in batch.columns)
                if (grp, part) != cell:
                    if race is not None and race.ids is not None:
                        yield race.result(cell[0])
                    cell, race = (grp, part), _Race(k)
                if not is_block:
                    race.add_queries(dims, ids, lists)
                    continue
                if not race.parts:
                    continue  # no query of this group has a usable vector
                if race.ids is None:
                    race.begin()
                race.meet(dims, ids, no_id, lists, places)
        if race is not None and race.ids is not None:
            yield race.result(cell[0])

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of rows for each of queries, which must be some of the rows."""
    spark = rows.sparkSession

    def narrow(df: DataFrame) -> DataFrame:
        return df.select(df[id_col].cast("bigint").alias("vec_id"), df[vector_col].alias("v"))

    asked = narrow(queries).where("vec_id is not null and v is not null")
    count, dims = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not count:
        return spark.createDataFrame([], schema)
    groups = -(-count * max(dims, 1) // cells)
    with arrow_rows(spark, INPUT_ROWS):
        blocks = scratch(spark, "topk_blocks")
        narrow(rows).mapInArrow(_sorted_lists(scale, cells), BLOCK).write.parquet(blocks)
        packed = scratch(spark, "topk_queries")
        asked.repartition(groups).mapInArrow(_pack_queries(scale), "grp int, dims int, ids binary, vectors binary").write.parquet(packed)
    blocks, packed = spark.read.schema(BLOCK).parquet(blocks), spark.read.parquet(packed)
    slices = max(1, -(-partitions(spark) // groups))
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    part = F.pmod(F.xxhash64("ids", "lists"), F.lit(slices)).cast("int").alias("slice")
    offered = blocks.select(each, part, F.lit(True).alias("is_block"), "dims", "ids", "no_id", "lists", "places")
    slots = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    none = F.lit(None).cast("binary")
    wanted = packed.select("grp", slots, F.lit(False).alias("is_block"), "dims", "ids", none.alias("no_id"), F.col("vectors").alias("lists"), none.alias("places"))
    cell = (F.col("grp") * slices + F.col("slice")).cast("int")
    dealt = wanted.unionByName(offered).withColumn("cell", cell).repartitionById(groups * slices, F.col("cell")).drop("cell").sortWithinPartitions("grp", "slice", "is_block")
    with arrow_rows(spark, BLOCKS):
        found = scratch(spark, "topk_found")
        dealt.mapInArrow(_races(k + 1), FOUND).write.parquet(found)  # one more than k: the query's own row goes
    found = spark.read.schema(FOUND).parquet(found)
    # one row is the query's own: any with its id and its score with itself
    own = F.row_number().over(W.partitionBy("grp", "query").orderBy(F.desc("is_own"), F.desc("score"), F.col("vec_id").asc_nulls_last()))
    others = found.withColumn("place", own).where(~(F.col("is_own") & (F.col("place") == 1)))
    order = W.partitionBy("grp", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
