"""Document fingerprints: a Merkle tree over sections and paragraphs, in native expressions.

A text's paragraphs are its lines, cut further behind sentence ends of several scripts, so that each edit touches
few leaves. One that is still longer than LONG characters is cut where the hash of WINDOW characters is 0 modulo
LONG_STEP: at places that depend on content alone, so text in front of an edit keeps its leaves whatever its script.
A section is a run of paragraphs that ends at a boundary paragraph: one whose hash is 0 modulo
`section_paragraphs`. So text moved by an edit keeps its sections, too.
A leaf is the SHA-256 of its paragraph; a section is the SHA-256 of its leaves, the root that of its
sections. The fingerprint is the root: equal texts have equal fingerprints, and texts that differ have
different ones. Where roots differ, `edited_paragraphs` goes down: of the sections that the other tree lacks, it
gives the leaves that the other tree lacks. The likeness of two trees is the share of different leaves and roots
that both hold, so it is 1 only if the roots are equal.

A null text is empty: a tree with one empty leaf. Whole texts are hashed. A run of characters without any cut
(one character repeated) is one leaf. Repeated rows stay.

Each document is also compared with its neighbour, the next in descending doc_id (after the last the
first; null ids last, equal ids by text hash). Documents are dealt out by ranges of doc_id, RANGE_DOCS documents
each, in which a window looks ahead; a copy of each range's first document closes the range before it.

An empty table gives no rows. Extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import partitions

SECTION_PARAGRAPHS = 8
#: A paragraph ends behind a line feed, behind white space that follows a sentence end, or behind a full-width one.
_CUT = r"(?<=\n)|(?<=[.!?\u061F\u06D4\u0964\u0965\u1362]\s)|(?<=[\u3002\uFF01\uFF0E\uFF1F\uFF61])"
#: Paragraphs longer than LONG characters are cut where WINDOW characters hash to 0 modulo LONG_STEP.
LONG, LONG_STEP, WINDOW = 512, 128, 4
RANGE_DOCS = 16_384


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _slices(parts: Column, is_end, join) -> Column:
    """array: the runs of an array's elements, each joined; a run ends where is_end(i) holds for its last place i (from 1), and at the end."""
    n = F.size(parts)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | is_end(i))

    def cut(e: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1))
        return F.transform(F.arrays_zip(starts.alias("s"), e.alias("e")), lambda x: join(F.slice(parts, x["s"] + 1, x["e"] - x["s"])))

    return _let(ends, cut)


def _pieces(paragraph: Column) -> Column:
    """The pieces of a long paragraph."""

    def cut(chars: Column) -> Column:
        def is_end(i: Column) -> Column:
            return (i >= WINDOW) & (F.pmod(F.xxhash64(*[F.element_at(chars, F.greatest(i - k, F.lit(1))) for k in range(WINDOW)]), F.lit(LONG_STEP)) == 0)

        return _slices(chars, is_end, lambda run: F.array_join(run, ""))

    return _let(F.split(paragraph, ""), cut)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; together they are the text."""
    return F.flatten(F.transform(F.split(text, _CUT, -1), lambda p: F.when(F.char_length(p) > LONG, _pieces(p)).otherwise(F.array(p))))


def leaves(text: Column) -> Column:
    """array<string>: SHA-256 of each paragraph."""
    return F.transform(paragraphs(text), lambda p: F.sha2(p, 256))


def _section_end(leaf: Column, section_paragraphs: int):
    return lambda i: F.conv(F.substring(F.element_at(leaf, i), 1, 8), 16, 10).cast("long") % section_paragraphs == 0


def sections(leaf: Column, section_paragraphs: int = SECTION_PARAGRAPHS) -> Column:
    """array<string>: the section hashes of a column of leaves."""
    return _slices(leaf, _section_end(leaf, section_paragraphs), lambda run: F.sha2(F.array_join(run, ""), 256))


def edited_paragraphs(leaf: Column, section: Column, other_leaf: Column, other_section: Column, section_paragraphs: int = SECTION_PARAGRAPHS) -> Column:
    """array<int>: places (from 1) of the paragraphs that the other tree lacks, from the leaves and sections of both.

    Sections that both trees hold are passed by; only below the rest are leaves looked at. A paragraph that was moved
    between sections or repeated is no edit of its own.
    """
    n = F.size(leaf)
    is_end = _section_end(leaf, section_paragraphs)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | is_end(i))

    def ranges(s: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(s["ends"], 1, F.size(s["ends"]) - 1))
        each = F.arrays_zip(starts.alias("a"), s["ends"].alias("b"), section.alias("h"))
        return F.transform(F.filter(each, lambda x: F.array_contains(s["gone"], x["h"])), lambda x: F.struct((x["a"] + 1).alias("first"), x["b"].alias("last")))

    branches = _let(F.struct(ends.alias("ends"), F.array_except(section, other_section).alias("gone")), ranges)
    lacked = F.struct(branches.alias("ranges"), F.array_except(leaf, other_leaf).alias("gone"))
    return _let(lacked, lambda m: F.flatten(F.transform(m["ranges"], lambda r: F.filter(F.sequence(r["first"], r["last"]), lambda i: F.array_contains(m["gone"], F.element_at(leaf, i))))))


def root(section: Column) -> Column:
    return F.sha2(F.array_join(section, ""), 256)


def likeness(a: Column, b: Column, same_root: Column) -> Column:
    """Twice the different leaves that two trees share over the different leaves and the root of each; 1 for equal roots."""
    return F.when(same_root, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) + 2))


def edited_text(text: Column, other: Column) -> Column:
    """text with its last third of code points replaced by the first as many, or all, of other."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(other, F.lit(1), third))


def _place(cuts: list[int], value: Column) -> Column:
    """How many of the ascending cuts are below the value: first by every so manieth cut, then by those between two of them."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = F.array(*[F.array(*map(F.lit, cuts[k : k + step])).cast("array<bigint>") for k in range(0, len(cuts), step)])
    coarse = F.size(F.filter(F.array(*map(F.lit, cuts[::step])).cast("array<bigint>"), lambda c: c < value))
    fine = F.size(F.filter(F.element_at(blocks, F.greatest(coarse, F.lit(1))), lambda c: c < value))
    return F.when(value.isNotNull(), F.greatest(coarse - 1, F.lit(0)) * step + fine)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows (doc_id, text) with next_text, the text of the next document in descending doc_id; after the last the first."""
    n = ranges or max(partitions(docs.sparkSession), -(-docs.count() // RANGE_DOCS))
    steps = [k / n for k in range(1, n)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 10 * n))).first()[0] or [])) if steps else []
    # range k holds ids above cuts[k - 1] up to cuts[k]; null ids come last and join range 0
    place = F.coalesce(_place(cuts, F.col("doc_id")), F.lit(0))
    rows = docs.select("doc_id", "text", place.alias("range"), F.xxhash64("text").alias("tie"))
    # the first rows of each range, in descending order, close the range above; those of the highest close the lowest
    first = dict(sorted(rows.select("doc_id", "range").groupBy("range").agg(F.max("doc_id")).collect())) or {0: None}
    ordered = list(first)
    goes = F.create_map(*[F.lit(x) for k, r in enumerate(ordered) for x in (r, ordered[(k + 1) % len(ordered)])])
    firsts = F.create_map(*[F.lit(x).cast("bigint") for r in ordered for x in (r, first[r])])
    is_first = F.col("doc_id").eqNullSafe(firsts[F.col("range").cast("bigint")])
    # a guard comes last in its range; of equal ids only the one that is first by tie is looked at
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guard"))
    guard = F.struct(goes[F.col("range")].alias("range"), F.lit(True).alias("guard"))
    both = rows.select(F.explode(F.when(is_first, F.array(own, guard)).otherwise(F.array(own))).alias("x"), "doc_id", "text", "tie")
    order = W.partitionBy("x.range").orderBy(F.col("x.guard"), F.col("doc_id").desc_nulls_last(), "tie")
    seen = both.repartition(n, "x.range").withColumn("next_text", F.lead("text").over(order))
    return seen.where(~F.col("x.guard")).select("doc_id", "text", "next_text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", section_paragraphs: int = SECTION_PARAGRAPHS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, sections, near_edited, near_next, edited_at (places of the edited text's paragraphs that the text lacks)."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    pairs = with_next(rows).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    pairs = pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        leaves(F.col("text")).alias("own"),
        leaves(F.col("edited")).alias("changed"),
        leaves(F.col("next_text")).alias("next"),
    )
    own = pairs.select(
        "*",
        sections(F.col("own"), section_paragraphs).alias("sections"),
        sections(F.col("changed"), section_paragraphs).alias("edited_sections"),
        sections(F.col("next"), section_paragraphs).alias("next_sections"),
    )
    return own.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        root(F.col("sections")).alias("fingerprint"),
        root(F.col("edited_sections")).alias("edited_fingerprint"),
        "sections",
        likeness(F.col("own"), F.col("changed"), F.col("sections") == F.col("edited_sections")).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), F.col("sections") == F.col("next_sections")).alias("near_next"),
        edited_paragraphs(F.col("changed"), F.col("edited_sections"), F.col("own"), F.col("sections"), section_paragraphs).alias("edited_at"),
    )
