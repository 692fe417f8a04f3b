"""WARC archives: one gzip member per record, written by tasks and read back in sequence.

Writing: each task writes one archive. Among records with equal payloads of at least `min_payload` bytes,
those with the largest page_id are responses and the others revisits, which keep the HTTP head but not the
payload and name the response they refer to. Payloads are told apart by length and SHA-1; only groups of two
or more take part in the join, as narrow rows.

Reading: a stream of bounded chunks goes through one zlib decompressor after the other, one for each gzip
member. The head ends at the first empty line, Content-Length frames the block, and those of the block's and
the payload's digests that are SHA-1 are verified; a digest or a length that is wrong, or a file that ends
early, is an error. Archives of others are read too: field names in any case, folded fields, records without
digests, and of any type. The payload of a response or revisit is what follows its HTTP head, that of a resource
or conversion its block; other types (warcinfo, request, metadata) have none.

A null html is an empty payload. A null page_id is less than any other. Rows that share the largest page_id
and the payload of their group are all responses; whether a row is a revisit depends on its id and payload
together, so an id may come with several payloads. Repeated rows stay. A null url gives no WARC-Target-URI.
An empty table gives no records.

Extra columns may have any name. Payloads of any length are written whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import files
from weftline.llm.common import small_batches, written

CHUNK = 1 << 16
LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
_EOL = b"\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    """The page_id of a record id of ours; null for any other."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record, not compressed."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + _EOL + block + _EOL + _EOL


def compressed(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, read in bounded chunks."""
    data = stream.read(CHUNK)
    while data:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                raise EOFError("the archive ends within a record")
            parts.append(z.decompress(data))
            data = z.unused_data if z.eof else stream.read(CHUNK)
        yield b"".join(parts)
        data = data or stream.read(CHUNK)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record; raises ValueError if its framing or its block digest is wrong."""
    end = member.find(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", member[: max(end, 0)]).decode(errors="replace").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    name = fields.get("warc-record-id")
    if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
        raise ValueError(f"{name} has no Content-Length")
    n = int(fields["content-length"])
    block = member[end + 4 : end + 4 + n]
    if len(block) != n or member[end + 4 + n :] != _EOL + _EOL:
        raise ValueError(f"Content-Length of {name} does not fit its block")
    if not _agrees(fields.get("warc-block-digest"), block):
        raise ValueError(f"block digest of {name} differs")
    return fields, block


def _agrees(digest: str | None, data: bytes) -> bool:
    """Whether a digest field is absent, of another kind, or the SHA-1 of the data in base32 or hexadecimal digits."""
    kind, _, value = (digest or "").partition(":")
    return kind.lower() != "sha1" or value.upper() in (sha1_base32(data), hashlib.sha1(data).hexdigest().upper())


def payload_of(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int | None, str | None]:
    """Payload of a record (null if it holds none), its full length and its SHA-1 in base32; raises ValueError if they differ from what the record says."""
    kind, name = fields.get("warc-type", "").lower(), fields.get("warc-record-id")
    if kind in ("resource", "conversion"):
        payload, size = block, len(block)
    elif kind in ("response", "revisit") and block[:5] == b"HTTP/":
        head, _, payload = block.partition(b"\r\n\r\n")
        found = re.search(rb"(?im)^Content-Length:[ \t]*([0-9]+)", head)
        size = int(found[1]) if found else (None if kind == "revisit" else len(payload))
    elif kind == "response":
        payload, size = block, len(block)
    else:
        payload, size = None, None
    told = fields.get("warc-payload-digest")
    if kind == "revisit":
        return None, size, told.partition(":")[2] if told else None
    if payload is not None and (len(payload) != size or not _agrees(told, payload)):
        raise ValueError(f"payload of {name} differs from its digest or length")
    return payload, size, None if payload is None else sha1_base32(payload)


def _payload_key() -> list[Column]:
    data = F.coalesce("html", F.lit(""))
    return [F.sha1(data.cast("binary")).alias("digest"), F.octet_length(data).alias("n")]


def revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(revisit_id, digest, n, refers_to), once each, of the pages, from rows (page_id, html), whose payload another page with a larger id holds."""
    keys = written(pages.select("page_id", *_payload_key()).where(F.col("n") >= min_payload), "payload_keys")
    groups = keys.groupBy("digest", "n").agg(F.count("*").alias("copies"), F.max("page_id").alias("refers_to")).where("copies > 1").drop("copies")
    found = keys.join(groups, ["digest", "n"]).where("page_id < refers_to or (page_id is null and refers_to is not null)")
    return written(found.select(F.col("page_id").alias("revisit_id"), "digest", "n", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, parent: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Writes archives below parent; returns the manifest (path, records, bytes)."""
    small_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    again = revisits(rows, min_payload)
    keyed = rows.select("*", *_payload_key())
    same = keyed["page_id"].eqNullSafe(again["revisit_id"]) & (keyed["digest"] == again["digest"]) & (keyed["n"] == again["n"])
    marked = keyed.join(again, same, "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = out = None
        n = size = 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, out = files.create(parent, ".warc.gz")
                data = compressed(record(page_id, url, (html or "").encode(), refers_to, refers_to is not None))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return written(marked.mapInArrow(write, "path string, records bigint, bytes bigint"), "warc_manifest")


READ = "record_id string, page_id bigint, url string, record_type string, payload string, payload_bytes bigint, payload_digest string, refers_to bigint"
_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in a manifest (path, records; null for an unknown number): READ's columns.

    page_id and refers_to are null for records that we did not write; payload is null for revisits, for types without
    one, or if not asked for, and other text than UTF-8 is decoded with replacement characters; payload_bytes and
    payload_digest are those of the full payload.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [c.split()[0] for c in READ.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                with files.open_stream(path) as stream:
                    for member in members(stream):
                        fields, block = parse(member)
                        payload, size, digest = payload_of(fields, block)
                        kind = fields.get("warc-type", "").lower()
                        text = payload.decode(errors="replace") if with_payload and payload is not None else None
                        name = fields.get("warc-record-id")
                        rows.append((name, page_of(name), fields.get("warc-target-uri"), kind, text, size, digest, page_of(fields.get("warc-refers-to")) if kind == "revisit" else None))
                        n += 1
                        if len(rows) == 256:
                            yield batch_of(rows)
                            rows = []
                if records is not None and n != records:
                    raise ValueError(f"{path} holds {n} records, its manifest says {records}")
                if rows:
                    yield batch_of(rows)

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives of the pages."""
    manifest = write_archives(pages, files.folder(pages.sparkSession, "warc"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
