"""Token files: ids of whole texts in compressed files with an index, one zstandard frame per document.

All frames use one dictionary, trained on the serialized ids of a bounded sample: SAMPLE documents at most, the
first by a hash of their id, and SAMPLE_BYTES of ids together (a longer document is left out of the sample,
never of the files). The dictionary lies beside the data and every file names its SHA-256. The coded documents
are written as a table once, then dealt out by ranges of doc_id and row, their number by the bytes of all ids,
and sorted; every range is one file:

  magic "WTOK1\\n", dictionary hash (32 bytes), then the frames, one after the other; then the index, three
  little-endian 64-bit numbers per document (doc_id, frame start, number of ids); then the number of
  documents and the start of the index, 64-bit each.

A frame holds 16-bit ids, or 32-bit ones if one of its ids needs more; the frame's content size over the
number of ids tells which. The index gives access to one document without reading others.

White space separates words in the tokenizer used, so a text's ids are those of its pieces between white
space, in order; a worker keeps the ids of pieces that it has seen and gives the rest to the tokenizers
library. Whole texts are encoded. A null text is empty (the end id only). Null doc_ids come first; rows with
one id, or none, follow each other in the order of the coded table. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import files
from weftline.llm.common import small_batches, written

END_ID = 2
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 512, 8 << 20, 64 << 10, 3
#: Bytes of ids that a file holds, about.
SHARD_BYTES = 16 << 20
MAGIC = b"WTOK1\n"
#: Entries of a worker's cache of pieces; it only saves time, and is emptied when full.
CACHE_ENTRIES = 600_000
#: Pieces that one call of the library takes.
CALL_PIECES = 1000
_NULL_ID = -(1 << 63)
_tokenizers: dict = {}


class PieceTokenizer:
    """Ids of whole texts by the tokenizers library, through a cache of the pieces between white space."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        #: An added token between two pieces parts them, so many pieces go through the library in one call.
        self.mark, self.mark_text = next(((i, t.content) for i, t in sorted(added.items())), (None, None))
        self.lower = self.library.normalizer is not None and self.library.normalizer.normalize_str("AZ") == "az"
        #: Whether an id ends a word, for a vocabulary that marks the ends of words.
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith(suffix) for i in range(self.library.get_vocab_size())]) if suffix else None
        #: Bytes of an id: two if all ids of the vocabulary fit.
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 and max(added, default=0) < 1 << 16 else 4
        self.cache: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Puts the ids of pieces into the cache. A full stop or comma behind letters is a word of its own, so such a piece is learned as two."""
        words, others, cut = set(), set(), []
        for p in pieces:
            t = p.decode()
            if not t:
                self.cache[p] = b""
            elif t.isalpha():
                words.add(t)
            elif t[-1] in ".," and t[:-1].isalpha():
                cut.append(p)
                if p[:-1] not in self.cache:
                    words.add(t[:-1])
            else:
                others.add(t)
        others |= {t for t in (".", ",") if cut and t.encode() not in self.cache}
        self._learn_words(list(words), others)
        self._learn_others(list(others))
        for p in cut:
            self.cache[p] = self.cache[p[:-1]] + self.cache[p[-1:]]

    def _learn_words(self, words: list[str], others: set[str]) -> None:
        """Pieces of letters alone, many in one call with blanks between: each is one word, which its last id shows. Where the number of words differs, all of them are added to the others."""
        if self.ends is None:
            others.update(words)
            return
        chunks = [words[at : at + CALL_PIECES] for at in range(0, len(words), CALL_PIECES)]
        for some, ids in zip(chunks, self._encoded([" ".join(c) for c in chunks]), strict=True):
            stops = self.width * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) != len(some):
                others.update(some)
                continue
            data, start = ids.tobytes(), 0
            for t, stop in zip(some, stops.tolist(), strict=True):
                self.cache[t.encode()] = data[start:stop]
                start = stop

    def _learn_others(self, texts: list[str]) -> None:
        plain = [t for t in texts if self.mark is not None and "<" not in t and self.mark_text not in t]
        chunks = [plain[at : at + CALL_PIECES] for at in range(0, len(plain), CALL_PIECES)]
        for some, ids in zip(chunks, self._encoded([self.mark_text.join(c) for c in chunks]), strict=True):
            data, start = ids.tobytes(), 0
            for t, stop in zip(some, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], strict=True):
                self.cache[t.encode()] = data[self.width * start : self.width * stop]
                start = stop + 1
        rest = list(set(texts).difference(plain))
        for t, ids in zip(rest, self._encoded(rest), strict=True):
            self.cache[t.encode()] = ids.tobytes()

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        """Pieces between ASCII white space. If the tokenizer ignores case, ASCII letters lose theirs, but not where an added token might be written in capitals."""
        texts = pc.fill_null(texts, "")
        if self.lower:
            texts = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        return pc.ascii_split_whitespace(texts)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, of self.width bytes each."""
        split = self._pieces(texts)
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        found = list(map(self.cache.get, pieces))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            self._learn([pieces[k] for k in missing])
            for k in missing:
                found[k] = self.cache[pieces[k]]
        # the ids of a batch, taken from those of its different pieces
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        which = coded.indices.to_numpy(zero_copy_only=False)
        stops = np.cumsum(size[which])
        at = np.repeat((np.cumsum(size) - size)[which] - stops + size[which], size[which])
        ids = np.frombuffer(b"".join(found), f"<u{self.width}")[at + np.arange(len(at))]
        data = ids.tobytes()
        ends = self.width * np.r_[0, stops][split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [data[a:b] for a, b in itertools.pairwise(ends.tolist())]


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def serialized(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def _coded(rows: DataFrame, path: str, end_id: int) -> DataFrame:
    """The column text of rows replaced by ids (serialized, with the end id) and n, their number."""

    @F.arrow_udf("struct<ids:binary,n:bigint>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = tokenizer(path)
        narrow = enc.width == 2 and end_id < 1 << 16
        end = np.array([end_id], "<u2" if narrow else "<u4")
        for batch in batches:
            found = enc.encode(batch)
            counts = [len(b) // enc.width + 1 for b in found]
            if narrow:
                found = [b + end.tobytes() for b in found]
            else:
                found = [serialized(np.r_[np.frombuffer(b, f"<u{enc.width}").astype("<u4"), end]) for b in found]
            yield pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(counts, pa.int64())], ["ids", "n"])

    made = rows.withColumn("coded", coded.asNondeterministic()(F.col("text")))
    return made.select("doc_id", "coded.ids", "coded.n")


def train_dictionary(coded: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from the ids of at most `sample` documents, the first by a hash of their id, and of at most `sample_bytes` bytes together; empty if they are too few to train on."""
    import zstandard

    some = coded.select("row", "n_bytes", F.xxhash64("doc_id", "row").alias("h")).where(F.col("n_bytes") <= sample_bytes).orderBy("h", "row").limit(sample)
    some = some.withColumn("upto", F.sum("n_bytes").over(W.orderBy("h", "row"))).where(F.col("upto") <= sample_bytes).select("row")
    data = [bytes(r["ids"]) for r in coded.join(F.broadcast(some), "row", "left_semi").select("ids").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(data)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, parent: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the files below parent; returns the manifest (shard, path, docs, ids, dictionary), one row per file in ascending order of doc_id."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    coded = _coded(rows, tokenizer_path, end_id).withColumn("row", F.monotonically_increasing_id()).withColumn("n_bytes", F.octet_length("ids").cast("long"))
    coded = written(coded, "coded")
    total = coded.agg(F.sum("n_bytes")).first()[0] or 0
    trained = train_dictionary(coded)
    digest = hashlib.sha256(trained).digest()
    dictionary_path, out = files.create(parent, ".dict")
    with out:
        out.write(trained)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(trained))
        out, index, at = None, [], len(MAGIC) + len(digest)
        for batch in batches:
            for doc_id, ids, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n")), strict=True):
                if out is None:
                    path, out = files.create(parent, ".tok")
                    out.write(MAGIC + digest)
                frame = z.compress(ids)
                index.append((_NULL_ID if doc_id is None else doc_id, at, n))
                out.write(frame)
                at += len(frame)
        if out is not None:
            out.write(np.array(index, "<i8").tobytes() + struct.pack("<qq", len(index), at))
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [path], "docs": [len(index)], "ids": [sum(x[2] for x in index)], "dictionary": [dictionary_path]})

    # ranges of id and row: rows that share an id, or have none, can be parted too
    n = shards or max(1, -(-total // SHARD_BYTES))
    dealt = coded.select("doc_id", "row", "ids", "n").repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    return written(dealt.mapInArrow(write, "shard bigint, path string, docs bigint, ids bigint, dictionary string"), "token_manifest")


def read_index(f) -> np.ndarray:
    """The index of an open file: rows (doc_id, frame start, ids) and, as the last start, where the index begins."""
    size = f.size()
    f.seek(size - 16)
    n, start = struct.unpack("<qq", f.read(16))
    f.seek(start)
    return np.vstack([np.frombuffer(f.read(24 * n), "<i8").reshape(-1, 3), [[0, start, 0]]])


def read_document(f, index: np.ndarray, k: int, z) -> np.ndarray:
    """Ids of the k-th document of an open file, without reading others."""
    start, end, n = int(index[k, 1]), int(index[k + 1, 1]), int(index[k, 2])
    f.seek(start)
    data = z.decompress(f.read(end - start))
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def decompressor(f, dictionary: bytes):
    """For an open file's frames; raises ValueError if it was written with another dictionary."""
    import zstandard

    f.seek(0)
    head = f.read(len(MAGIC) + 32)
    if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token file of this dictionary")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (null if not asked for), ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
        names = ["doc_id", "start", "n_tokens", "ids", "ids_crc32"]
        for batch in batches:
            for path, dictionary, before in zip(*(batch.column(c).to_pylist() for c in ("path", "dictionary", "before")), strict=True):
                with files.open_file(dictionary) as f:
                    trained = f.read()
                with files.open_file(path) as f:
                    z, index = decompressor(f, trained), read_index(f)
                    rows = []
                    for k in range(len(index) - 1):
                        ids = read_document(f, index, k, z)
                        doc_id = int(index[k, 0])
                        rows.append((None if doc_id == _NULL_ID else doc_id, before, len(ids), ids.astype(np.int32) if with_ids else None, zlib.crc32(ids.tobytes())))
                        before += len(ids)
                        if len(rows) == 256 or k == len(index) - 2:
                            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []

    placed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, manifest.count())
    return placed.repartition(n).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files of the documents."""
    manifest = write_token_files(docs, files.folder(docs.sparkSession, "tokens"), tokenizer_path)
    return read_token_files(manifest, with_ids=False).drop("ids")
