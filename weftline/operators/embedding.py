"""Embeddings of items: feature hashing, and encoders of others run in batches with checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Dimensions of a hashed vector. Fixed value.
DIMS = 128


def item_text(item_id: Column, category: Column, title: Column, description: Column, colors: Column) -> Column:
    """What an item is encoded by."""
    none = F.lit("")
    return F.concat_ws("|", item_id, F.coalesce(category, none), F.coalesce(title, none), F.coalesce(description, none), F.coalesce(F.array_join(colors, ","), none))


def hashed_vectors(rows: DataFrame, key: str, text: Column, dims: int = DIMS) -> DataFrame:
    """(key, vector): the words of a text (lower case, by white space) hashed to signed dimensions, with length 1; the zero vector for a text without words.

    A word's MD5 gives its dimension (first four bytes) and its sign (fifth byte even: plus). Words are counted by key and
    dimension before vectors are built, so a long text is no long expression. Keys are unique.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    each = rows.select(F.col(key).alias("key"), F.explode(words).alias("w")).select("key", F.md5("w").alias("h"))
    number = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("bigint")
    sign = F.when(number(9, 2) % 2 == 0, 1.0).otherwise(-1.0)
    by = each.groupBy("key", (number(1, 8) % dims).cast("int").alias("dim")).agg(F.sum(sign).alias("x"))
    vectors = by.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    norm = F.when(F.coalesce("norm", F.lit(0.0)) > 0, F.col("norm")).otherwise(1.0)
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / norm)
    return rows.select(F.col(key).alias("key")).join(vectors, "key", "left").select(F.col("key").alias(key), dense.alias("vector"))


class HashEncoder:
    """The same by BLAKE2b of eight bytes, one text at a time: the baseline encoder."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t or "") for t in texts]

    def _one(self, text: str) -> list[float]:
        vector = [0.0] * self.dims
        for word in text.lower().split():
            h = hashlib.blake2b(word.encode(), digest_size=8).digest()
            vector[int.from_bytes(h[:4], "big") % self.dims] += 1.0 if h[4] % 2 == 0 else -1.0
        norm = math.sqrt(sum(x * x for x in vector)) or 1.0
        return [x / norm for x in vector]


def encoded(rows: DataFrame, text: Column, make_encoder: Callable[[], object], batch: int = 32, dims: int | None = None, name: str = "vector") -> DataFrame:
    """rows with a column of vectors from an encoder: an object with encode(list of texts) -> list of vectors.

    make_encoder runs once a task, so a model is loaded there, not on the driver. A batch whose number of vectors differs
    from that of its texts, an empty vector, or one of other dimensions than the first (or than dims) is an error. A column of that name is
    replaced.
    """
    rows = rows.withColumn(name, text).select(*[c for c in rows.columns if c != name], name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = None, dims
        for b in batches:
            if encoder is None:
                encoder = make_encoder()
            texts, vectors = b.column(b.num_columns - 1).to_pylist(), []
            for at in range(0, len(texts), batch):
                got = encoder.encode(texts[at : at + batch])
                if len(got) != len(texts[at : at + batch]):
                    raise ValueError(f"encoder returned {len(got)} embeddings for {len(texts[at : at + batch])} items")
                vectors += [[float(x) for x in v] for v in got]
            for v in vectors:
                width = len(v) if width is None else width
                if not v or len(v) != width:
                    raise ValueError(f"encoder returned an embedding of {len(v)} dimensions, not {width}")
            columns = [b.column(k) for k in range(b.num_columns - 1)] + [pa.array(vectors, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], name])

    schema = StructType([*rows.schema.fields[:-1], StructField(name, ArrayType(DoubleType()))])
    return rows.mapInArrow(run, schema)
