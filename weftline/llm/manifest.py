"""Merkle manifest of a dataset: one tree a source, one tree over the sources, built and checked in supersteps over RDDs.

A leaf is the SHA-256 of a row's fields. Leaves of a source stand in order of doc_id (null first; equal ids by leaf);
every FAN consecutive nodes have one parent, the hash of their digests. The last node of a source's last level is its
subroot. Subroots, in order of their sources' UTF-8 bytes (null first), are the leaves of one more tree, with the root.

Up: in each superstep every node sends its digest to its parent; a parent that has heard from all its children (the
step ends when all messages have come, and the last child says that it is the last) hashes and sends on in the next. A
node that is both first and last of its level is a root and stops. Down: from the roots on, each parent sends each child
what it has heard from above, and the siblings of the child. At the leaves that is the proof: the path from the row
to the root.

What a parent heard is a table in the shared folder, by level, so a lost executor loses no step. A key is one parent, with
FAN children at most, so no source meets in one task. Of the whole tree the driver sees two sources and three counts a
partition of the sorted leaves.

An empty table has no rows. Null fields count as `-`. Rows that repeat are leaves each, next to each other. Texts of any
length are hashed whole by Spark. Other columns are left out, so their names can't clash. tampered is what a row's leaf
is checked against the manifest with: the leaf of the changed row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import partitions, scratch, written

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a row's fields, some of them changed."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and tampered: the leaf with A-Z of the text in lower case, where 5 divides the crc32 of doc_id, else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", "source", leaf().alias("leaf"), F.when(hit, leaf(text=F.translate("text", UPPER, LOWER))).alias("tampered"))


# Nodes are ((tree, place), (digest, is_last, load)); load is what a leaf carries along, null above.


def numbered(spark: SparkSession, ordered: RDD) -> tuple[RDD, int]:
    """(tree, digest, load) sorted by tree to nodes, with the place within the tree and whether it is the tree's last; and the size of the largest tree."""

    def ends(at: int, rows: Iterator) -> Iterator:
        first, last, n, run, longest = None, None, 0, 0, 0
        for tree, _, _ in rows:
            if not n:
                first = tree
            run = run + 1 if n and tree == last else 1
            longest, last, n = max(longest, run), tree, n + 1
        if n:
            yield at, first, last, n, run, longest

    begins, follows, before, largest = {}, {}, None, 0
    for at, first, last, n, run, longest in sorted(ordered.mapPartitionsWithIndex(ends).collect()):  # one row a partition
        start = before[1] if before is not None and before[0] == first else 0
        begins[at] = start
        if before is not None:
            follows[before[2]] = (first,)
        before = (last, start + run if run == n else run, at)
        largest = max(largest, start + longest, before[1])

    def place(at: int, rows: Iterator) -> Iterator:
        held, next_ = None, begins.get(at, 0)
        for tree, own, load in rows:
            if held is not None:
                same = held[0] == tree
                yield (held[0], held[1]), (held[2], not same, held[3])
                next_ = held[1] + 1 if same else 0
            held = (tree, next_, own, load)
        if held is not None:
            yield (held[0], held[1]), (held[2], follows.get(at) != (held[0],), held[3])

    return _kept(spark, ordered.mapPartitionsWithIndex(place), "manifest_nodes"), largest


def _kept(spark: SparkSession, rdd: RDD, name: str) -> RDD:
    """The RDD as files in the shared folder, read back."""
    path = scratch(spark, name)
    rdd.saveAsPickleFile(path)
    return rdd.context.pickleFile(path, 1)


def _is_root(node) -> bool:
    return node[0][1] == 0 and node[1][1]


def _message(node):
    """To the parent: which of its children speaks, and what it says."""
    (tree, place), (own, is_last, load) = node
    return (tree, place // FAN), (place % FAN, own, is_last, load)


def _parent(heard):
    """A parent that has heard from all its children."""
    key, children = heard
    return key, (digest(*[c[1] for c in children]), children[-1][2], None)


def _spread(parts: int, height: int) -> int:
    """Tasks for the nodes of a level."""
    return max(1, parts // FAN**height)


def climb(spark: SparkSession, nodes: RDD, largest: int, parts: int) -> tuple[list[RDD], RDD]:
    """Supersteps up: what the parents of each level heard, from the leaves on, as ((tree, place of the parent), [(slot, digest, is_last, load)]), and the roots as (tree, (height, digest, load if it is a leaf)). largest: a bound of the number of leaves of a tree."""
    heard, roots = [], spark.sparkContext.emptyRDD()
    while True:
        height = len(heard)
        roots = roots.union(nodes.filter(_is_root).map(lambda n, h=height: (n[0][0], (h, n[1][0], n[1][2]))))
        if FAN**height >= largest:  # nothing is left to climb
            return heard, _kept(spark, roots.coalesce(_spread(parts, 1)), "manifest_roots")
        messages = nodes.filter(lambda n: not _is_root(n)).map(_message).groupByKey(_spread(parts, height))
        parents = messages.mapValues(lambda children: sorted(children, key=lambda c: c[0])).coalesce(_spread(parts, height))
        heard.append(_kept(spark, parents, f"manifest_level{height}"))
        nodes = heard[-1].map(_parent)


def _sent_down(parent) -> Iterator:
    """From a parent to its children: ((tree, place), (digest, load, word, path)), the child's siblings added to the path."""
    (tree, place), (children, (word, path)) = parent
    for k, (slot, own, _, load) in enumerate(children):
        left, right = ("".join(c[1] for c in some) for some in (children[:k], children[k + 1 :]))
        yield (tree, place * FAN + slot), (own, load, word, ((left, right), *path))


def descend(heard: list[RDD], roots: RDD, parts: int) -> RDD:
    """Supersteps down from roots (tree, (height, digest, load, word, path)): (digest, load, word, path) of each leaf, the path from the leaf's siblings up; word is told to all below a root."""
    found = roots.filter(lambda r: r[1][0] == 0).map(lambda r: r[1][1:])
    above = None
    for height in range(len(heard), 0, -1):
        begun = roots.filter(lambda r, h=height: r[1][0] == h).map(lambda r: ((r[0], 0), r[1][3:]))
        tasks = _spread(parts, height - 1)
        sent = heard[height - 1].join(begun if above is None else above.union(begun), tasks).coalesce(tasks).flatMap(_sent_down)
        above = sent.mapValues(lambda m: m[2:])
    return found if above is None else found.union(sent.values())


def folded(own: str, path: tuple) -> str:
    """The root that a leaf and its path give."""
    for left, right in path:
        own = digest(left, own, right)
    return own


def build(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    found = written(leaves(docs), "manifest_leaves").withColumn("row", F.monotonically_increasing_id())
    order = ["source", "doc_id", "leaf", "row"]  # the last parts rows that are equal
    ordered = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).rdd.map(lambda r: (r["source"], r["leaf"], (r["doc_id"], r["tampered"])))
    heard, subroots = climb(spark, *numbered(spark, ordered), parts)
    # the tree over the sources: its leaves carry what is needed to go down each source's tree
    by_source = subroots.sortBy(lambda r: (r[0] is not None, r[0] or ""), numPartitions=_spread(parts, 1)).map(lambda r: (0, r[1][1], (r[0], r[1][0], r[1][2])))
    upper, top = climb(spark, *numbered(spark, by_source), _spread(parts, 1))
    root = top.map(lambda r: r[1][1]).collect()  # one, or none for an empty table

    def begin(leaf_of_top):
        own, (source, height, load), _, path = leaf_of_top
        return source, (height, own, load, own, path)

    told = descend(upper, top.map(lambda r: (r[0], (*r[1], None, ()))), _spread(parts, 1)).map(begin)

    def result(leaf_):
        own, (doc_id, tampered), subroot, path = leaf_
        end = folded(tampered or own, path)
        return doc_id, own, subroot, root[0], digest(*[left + right for left, right in path]), end, end == root[0]

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return spark.createDataFrame(descend(heard, told, parts).map(result), schema, verifySchema=False)
