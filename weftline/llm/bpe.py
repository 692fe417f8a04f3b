"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a pre-token has exactly one last token in its BPE encoding. So for each prefix the
vocabulary words that end there (found by an automaton with suffix links) are tried from the longest
down; a word is the last token if it is compatible with the last token of the prefix before it. The
back-pointers then give the ids. The work is linear in the text, also for a text without any space.

Two adjacent tokens are compatible if no merge crosses their border. While a token is built, its symbol
next to the border walks up one edge of the token's merge tree; a merge of two such symbols crosses the
border if it comes before each of them is taken up by its own parent.

Null texts count as empty: they have no ids. Equal texts have equal ids. Text is never cut.

An empty table gives no rows. Extra columns may have any name, repeated rows stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_batches

#: The pre-token pattern of byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's caches; they only save time, and are emptied when full.
CACHE_ENTRIES = 250_000
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Cache(dict):
    """A dict that computes what it lacks, emptied when full."""

    def __init__(self, make, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        raw = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (max([*raw, *self.special.values()]) + 1)
        for i, b in raw.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank.setdefault(pair, r)
            parts.setdefault(whole, (*pair, r))
        self._right = Cache(lambda t: self._edge(parts, t, 1), len(raw) + 1)
        self._left = Cache(lambda t: self._edge(parts, t, 0), len(raw) + 1)
        ok: dict[int, bool] = {}
        for t in sorted(raw, key=lambda t: len(raw[t])):
            a = parts.get(t)
            ok[t] = len(raw[t]) == 1 if a is None else ok[a[0]] and ok[a[1]] and self._apart(a[0], a[1], a[2])
        self._build({b: t for t, b in raw.items() if ok[t]})
        #: For each token, whether tokens seen behind it are compatible.
        self._behind: list[dict[int, bool]] = [{} for _ in self.bytes_of]
        self._id4 = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self._pre = regex.compile(PATTERN)
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: A space that continues a run of white space: there, pieces between spaces can't be taken one by one.
        self._run = regex.compile(r"\s (?:\s|$)")
        #: Ids of pieces: pre-tokens, and runs of them from one space to the next.
        self._pieces = Cache(self._learn)

    def _build(self, words: dict[bytes, int]) -> None:
        """The automaton: from state and byte to the state of the longest suffix read that starts a word, and for each state the words that end there, longest first."""
        edges: list[dict[int, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for word, t in words.items():
            at = 0
            for byte in word:
                if byte not in edges[at]:
                    edges[at][byte] = len(edges)
                    edges.append({})
                    own.append(None)
                at = edges[at][byte]
            own[at] = (len(word), t)
        link, order = [0] * len(edges), [0]
        self._ends: list[tuple[tuple[int, int], ...]] = [()] * len(edges)

        def step(key: int) -> int:
            state, byte = key >> 8, key & 255
            while state and byte not in edges[state]:
                state = link[state]
            return edges[state].get(byte, 0)

        for state in order:
            for byte, to in edges[state].items():
                link[to] = step(link[state] << 8 | byte) if state else 0
                order.append(to)
            self._ends[state] = (*([own[state]] if own[state] else []), *self._ends[link[state]])
        self._edges, self._step = edges, Cache(step, 256 * len(edges))

    @staticmethod
    def _edge(parts: dict, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols along one edge of a token's merge tree, each with the rank of the merge that takes it up."""
        out, until = [(token, _NEVER)], _NEVER
        while token in parts:
            until, token = parts[token][2], parts[token][side]
            out.append((token, until))
        return out

    def _apart(self, a: int, b: int, own: int) -> bool:
        """Whether no merge but the one of rank own crosses the border of a and b. Of equal ranks the left pair merges first."""
        rank = self.rank
        for x, x_until in self._right[a]:
            for y, y_until in self._left[b]:
                r = rank.get((x, y))
                if r is not None and r != own and r < x_until and r <= y_until:
                    return False
        return True

    def encode_pretoken(self, token: str) -> bytes:
        """Little-endian 32-bit ids of one pre-token."""
        data, state = token.encode(), 0
        last, size = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        edges, ends, behind = self._edges, self._ends, self._behind
        for end, byte in enumerate(data, 1):
            to = edges[state].get(byte)
            state = self._step[state << 8 | byte] if to is None else to
            for length, t in ends[state]:
                if length == end:
                    break
                known = behind[last[end - length]]
                fits = known.get(t)
                if fits is None:
                    fits = known[t] = self._apart(last[end - length], t, -1)
                if fits:
                    break
            last[end], size[end] = t, length
        ids, end = [], len(data)
        while end:
            ids.append(self._id4[last[end]])
            end -= size[end]
        ids.reverse()
        return b"".join(ids)

    def _learn(self, piece: str) -> bytes:
        """Ids of a piece that is not in the cache."""
        if piece.isascii():
            bare = piece[1:] if piece[0] == " " else piece
            if bare.isalpha():
                return self.encode_pretoken(piece)
            if bare[:-1].isalpha() and bare[-1] in ".,":  # a stop or comma is a pre-token of its own
                return self._pieces[piece[:-1]] + self._pieces[piece[-1]]
        if self._cut is not None and self._cut.search(piece):
            return self._ids(piece)
        tokens = self._pre.findall(piece)
        return self.encode_pretoken(piece) if len(tokens) == 1 else b"".join(map(self._pieces.__getitem__, tokens))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._pre.findall(text)))

    def _ids(self, text: str) -> bytes:
        if self._cut is None or "<" not in text and not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += self._plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<i4").tobytes()
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not text:
            return b""
        if "\0" in text or self._run.search(text) or any(" " in s and s in text for s in self.special):
            return self._ids(text)
        pieces = text.replace(" ", "\0 ").split("\0")
        return b"".join(map(self._pieces.__getitem__, pieces if pieces[0] else pieces[1:]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_lists(self, lists: pa.ListArray) -> list[str | None]:
        """The texts of an Arrow array of id lists."""
        ids, ends = lists.values.to_numpy(), lists.offsets.to_pylist()
        return [self.decode(ids[a:b].tolist()) if own else None for a, b, own in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_lists(buffers: list[bytes]) -> pa.ListArray:
    """An Arrow array of id lists from 32-bit buffers."""
    ends = np.cumsum([0, *(len(b) // 4 for b in buffers)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(buffers), dtype="<i4")))


def encode_column(text: Column, tokenizer: str) -> Column:
    """Ids (array<int>) of whole texts; null texts give an empty array."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer)
        for batch in batches:
            yield id_lists([enc.encode(t) for t in batch.to_pylist()])

    return ids.asNondeterministic()(text)


def decode_column(ids: Column, tokenizer: str) -> Column:
    """The text of id lists; null gives null. Bytes that are not UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer)
        for batch in batches:
            yield pa.array(enc.decode_lists(batch), pa.string())

    return texts.asNondeterministic()(ids)


def round_trip_column(text: Column, tokenizer: str) -> Column:
    """struct<ids, decoded> of whole texts in one pass of one worker: the ids, and the text decoded from them."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids = id_lists([enc.encode(t) for t in batch.to_pylist()])
            yield pa.StructArray.from_arrays([ids, pa.array(enc.decode_lists(ids), pa.string())], ["ids", "decoded"])

    return both.asNondeterministic()(text)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ids array<int>, decoded string.

    A null text is empty (no ids, decoded to the empty string); repeated rows stay; other columns are left out, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.select("doc_id", round_trip_column(F.col("text"), tokenizer).alias("r")).select("doc_id", "r.ids", "r.decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents' rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
