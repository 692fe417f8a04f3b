"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has 64 bits, from the XXH64 hashes (seed 42) of a text's 4-word shingles, repeats included.
Two fingerprints link if at most `errors` bits differ. With errors + 1 blocks of bits, linked fingerprints
agree in one block at least, so the fingerprints are dealt out by each block and its value, and one trie
stands over each such group, that block first. The join walks pairs of nodes of equal depth together,
adds up the bits in which their paths differ and drops a pair once the error budget is exceeded; where few
fingerprints are left below a pair, the remaining bits are compared at once. A group with very many
fingerprints is dealt out once more by blocks of its remaining bits, which loses no pair.

A group gives back links that span its linked sets, never all pairs. Components come from rounds of star
contraction over these links; they are checkpointed and none of them reaches the driver.

Only different fingerprints are joined, so copies cost nothing. A text without words, or a null text, has
fingerprint zero and is linked like any other. Rows may repeat; each is returned. A null doc_id is never
the smallest id of a component unless all are null.

Texts of any length are taken whole. An empty table gives no rows. Extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, free_name, partitions, small_batches, written

SHINGLE, SEED, BITS, ERRORS = 4, 42, 64, 4
#: Fingerprints of one group beyond which it is dealt out again; pairs compared at once below a node pair; node pairs held at once.
GROUP_ROWS, LEAF_PAIRS, FRONTIER = 50_000, 64, 125_000


def fingerprint(text: str | None) -> bytes:
    """Eight bytes, the highest bit first."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split() if text else []  # of bytes, lower() and split() know ASCII only
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxh64_digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-SHINGLE].tolist()]
        hashes = [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes()


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a bigint (two's complement)."""

    @F.arrow_udf("bigint")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.frombuffer(b"".join(fingerprint(t) for t in batch.to_pylist()), ">i8").astype(np.int64))

    return prints.asNondeterministic()(text)


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(start, width) of n blocks."""
    cuts = [bits * k // n for k in range(n + 1)]
    return list(zip(cuts, np.diff(cuts).tolist(), strict=False))


def _turned(value: Column, fixed: int, by: int) -> Column:
    """The low BITS - fixed bits rotated left by `by`, the high ones kept."""
    if not by:
        return value
    free = BITS - fixed
    low = F.lit(-1 if not fixed else (1 << free) - 1)
    rest = value.bitwiseAND(low)
    turned = F.shiftleft(rest, by).bitwiseOR(F.shiftrightunsigned(rest, free - by)).bitwiseAND(low)
    return turned if not fixed else turned.bitwiseOR(value.bitwiseAND(F.lit(-(1 << free))))


def _dealt(groups: DataFrame, fixed: int, errors: int) -> DataFrame:
    """Each row once for each block of its free bits, that block moved behind the fixed bits and added to the key."""
    rows = []
    for k, (start, width) in enumerate(_blocks(BITS - fixed, errors + 1)):
        turned = _turned(F.col("turned"), fixed, start)
        key = F.xxhash64("key", F.lit(k), F.shiftrightunsigned(turned, BITS - fixed - width))
        rows.append(F.struct(key.alias("key"), F.lit(fixed + width).alias("depth"), turned.alias("turned"), F.col("fp").alias("fp")))
    return groups.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


class _Linked:
    """Linked sets over 0..n-1, kept as a label for each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def trie_links(key: np.ndarray, depth: np.ndarray, value: np.ndarray, errors: int = ERRORS) -> np.ndarray:
    """Labels of the linked sets of the values, joined within each key; the first `depth` bits of a key's values agree.

    The tries stand over a sorted array: a node is a range [lo, hi) of values with one prefix.
    """
    order = np.lexsort((value, key))
    key, value, depth = key[order], value[order], depth[order].astype(np.int64)
    n, linked = len(value), _Linked(len(value))
    lo = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    hi = np.r_[lo[1:], n]
    ones: dict[int, np.ndarray] = {}
    for at in np.unique(depth[lo]):
        own = depth[lo] == at
        zero = np.zeros(own.sum(), np.int64)
        todo = [(int(at), lo[own], hi[own], lo[own], hi[own], zero)]
        while todo:
            d, alo, ahi, blo, bhi, diff = todo.pop()
            if len(alo) > FRONTIER:
                half = len(alo) // 2
                todo += [(d, *(x[:half] for x in (alo, ahi, blo, bhi, diff))), (d, *(x[half:] for x in (alo, ahi, blo, bhi, diff)))]
                continue
            leaf = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (d == BITS)
            _compare(value, linked, *(x[leaf] for x in (alo, ahi, blo, bhi)), errors)
            alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
            if not len(alo):
                continue
            if d not in ones:
                ones[d] = np.r_[0, np.cumsum((value >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int64)]
            amid, bmid = ahi - (ones[d][ahi] - ones[d][alo]), bhi - (ones[d][bhi] - ones[d][blo])
            same = alo == blo
            sides = [(alo, amid, blo, bmid, diff, None), (amid, ahi, bmid, bhi, diff, None), (alo, amid, bmid, bhi, diff + 1, None), (amid, ahi, blo, bmid, diff + 1, ~same)]
            grown = []
            for a0, a1, b0, b1, x, mask in sides:
                keep = (a1 > a0) & (b1 > b0) & (x <= errors)
                if mask is not None:
                    keep &= mask
                grown.append([y[keep] for y in (a0, a1, b0, b1, x)])
            todo.append((d + 1, *(np.concatenate(x) for x in zip(*grown, strict=True))))
        ones.clear()
    label = np.empty(n, np.int64)
    label[order] = order[linked.label]
    return label


def _compare(value: np.ndarray, linked: _Linked, alo, ahi, blo, bhi, errors: int) -> None:
    """Compare all values below each pair of nodes, in pieces of bounded size."""
    size = (ahi - alo) * (bhi - blo)
    at = 0
    ends = np.cumsum(size)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * FRONTIER, "right")))
        s = size[at:to]
        which = np.repeat(np.arange(at, to), s)
        k = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
        wide = (bhi - blo)[which]
        i, j = alo[which] + k // wide, blo[which] + k % wide
        near = (i != j) & (np.bitwise_count(value[i] ^ value[j]) <= errors)
        linked.add(i[near], j[near])
        at = to


def _group_links(errors: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spanning(key, depth, turned, fp):
            label = trie_links(key, depth, turned.view(np.uint64), errors)
            other = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(fp[other]), pa.array(fp[label[other]])], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "depth", "turned", "fp")])
            if sum(len(x[0]) for x in held) >= 4 * GROUP_ROWS:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                whole = cols[0] != cols[0][-1]  # the last key may go on
                held = [[c[~whole] for c in cols]]
                if whole.any():
                    yield spanning(*(c[whole] for c in cols))
        if held:
            yield spanning(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return links


def near_links(fps: DataFrame, errors: int = ERRORS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between the different values of column fp that span its linked sets."""
    spark = fps.sparkSession
    start = fps.select(F.lit(0).cast("bigint").alias("key"), F.col("fp").alias("turned"), "fp")
    groups = _dealt(start, 0, errors)
    large = checkpointed(groups.groupBy("key").count().where(F.col("count") > group_rows).select("key", F.lit(True).alias("large")))
    if not large.isEmpty():
        marked = groups.join(large, "key", "left")
        parts = [marked.where("large is null").select(groups.columns)]
        for width in sorted({w for _, w in _blocks(BITS, errors + 1)}):
            parts.append(_dealt(marked.where(F.col("large") & (F.col("depth") == width)), width, errors))
        groups = parts[0]
        for p in parts[1:]:
            groups = groups.unionByName(p)
    dealt = groups.repartition(partitions(spark), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_group_links(errors), "a bigint, b bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node it reaches.

    Rounds of large-star and small-star contraction; each keeps the components and shrinks the paths.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = near.join(low, "a")
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    now = state(edges)
    while now[0]:
        edges = checkpointed(star(star(edges, True), False))
        was, now = now, state(edges)
        if now == was:
            break
    stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), links (different fingerprints joined to its component).

    An empty table gives no rows. Other columns are left out, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    prints = written(rows.select("doc_id", fingerprint_column(F.col("text")).alias("fp")), "fingerprints")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    roots = connected_components(near_links(fps.select("fp"), errors))
    classes = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    by_fp = written(classes.join(least, "root").select("fp", "component_id", (F.col("members") - 1).alias("links")), "components")
    return prints.join(by_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest id (null last), then the least text hash; of rows that share both, any one."""
    small_batches(docs.sparkSession)
    fp, tie, row = (free_name(docs, c) for c in ("fp", "tie", "row"))
    marked = docs.withColumn(fp, fingerprint_column(docs[text_col])).withColumn(tie, F.xxhash64(docs[text_col]))
    # the table as written fixes the row numbers, so which rows go is decided on narrow rows
    rows = written(marked.withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    narrow = rows.select(rows[fp].alias("fp"), rows[row].alias("row"), F.struct(rows[id_col].isNull(), rows[id_col], rows[tie], rows[row]).alias("place"))
    by_fp = written(narrow.groupBy("fp").agg(F.min(F.struct("place", "row")).alias("first"), F.count("*").alias("n")), "distinct_fingerprints")
    roots = connected_components(near_links(by_fp.select("fp"), errors))
    classes = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    winners = classes.groupBy("root").agg(F.min("first")["row"].alias("won"), F.sum("n").alias("n")).where("n > 1").drop("n")
    groups = written(classes.select("fp", "root").join(winners, "root").select("fp", "won"), "groups")
    dropped = written(narrow.select("fp", "row").join(groups, "fp").where("row <> won").select(F.col("row").alias(row)), "dropped_rows")
    return rows.join(dropped, row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
