"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues.
From each anchor a local parser expands the span to both sides by fixed character classes and validates it.

Base kinds, leftmost and non-overlapping within each kind; a match that fails its test is dropped and not
tried again from inside:
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
  card   [0-9]([\\x20-]?[0-9])+, 16 to 19 digits that pass the Luhn test
  phone  \\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits
Added kinds:
  account  two letters, two check digits and 11 to 30 further letters or digits whose remainder modulo 97 is 1;
           as long as its country's accounts are, or for an unlisted country up to the last blank or other end
           that passes the test
  secret   the value behind a cue in any case (password=, token = "...", API_Key: ...), at least 8 characters with a
           digit, or an access key id (AKIA and 16 capitals or digits)
  url_user the user part of scheme://user:password@host

Offsets count code points; end is exclusive. A null or empty text has no spans. Whole texts are scanned, and
each kind reads a long run of its class once, so a scan takes time in proportion to the text. A redaction scans
again until it finds nothing, as replacing one span can lay bare another. Repeated rows stay; other columns are
left out.

An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import free_name, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "secret", "url_user")
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Schemes of addresses and cues of identifiers.
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("password", "passwd", "token", "api_key", "apikey", "secret", "access_key")
KEY_IDS = ("AKIA", "ASIA")
#: Characters of an account number by country (ISO 13616).
ACCOUNT_LENGTHS = {
    country: length
    for length, countries in {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items()
    for country in countries.split()
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+((?:\.[0-9]+){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
_ASSIGNED = re.compile(r"""["']?\s*[=:]\s*["']?""")
_VALUE = re.compile(r"[A-Za-z0-9_+/.=-]*")
_LAST_DIGIT = re.compile(r".*[0-9]", re.S)
_KEY_ID = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_USER = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")

_automaton = None


def anchors():
    """The automaton of all anchors in lower case, once for each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in [("@", "@"), ("+", "+"), *((d, "0") for d in "0123456789"), *((s, "://") for s in SCHEMES), *((c, "cue") for c in CUES), *((k.lower(), "key") for k in KEY_IDS)]:
            _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    return len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _account_end(text: str, at: int) -> int:
    """Where the account number that starts here ends, or 0."""
    m = _IBAN.match(text, at)
    if not m:
        return 0
    size = sum(c != " " for c in m[0])
    only = ACCOUNT_LENGTHS.get(text[at : at + 2])
    for end in range(m.end(), at, -1):
        if text[end - 1] == " ":
            continue
        if size < 15:
            break
        if (only is None or size == only) and not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()) and _iban(text[at:end]):
            return end
        size -= 1
    return 0


def _lower(text: str) -> str:
    """text in lower case, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind as listed, then start."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    # where each base kind may match next; where the run of digits last seen by a kind ends
    email_at = ip_at = card_at = phone_at = account_at = 0
    # the run of value characters last seen behind a cue: its end, and where its last digit ends
    value_end = digit_end = 0
    n = len(text)
    for end, (kind, length) in anchors().iter(_lower(text)):
        at = end - length + 1
        if kind == "0":
            if at >= ip_at:
                m = _IP.match(text, at)
                ip_at = m.end()
                if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
                    found.append(("ip", at, ip_at))
            if at >= card_at:
                m = _CARD.match(text, at)
                card_at = m.end()
                if card_at - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", at, card_at))
            if at >= account_at and at >= 2 and text[at - 1].isupper() and text[at - 2].isupper() and (at < 3 or not text[at - 3].isalnum()):
                if stop := _account_end(text, at - 2):
                    account_at = stop
                    found.append(("account", at - 2, account_at))
        elif kind == "@":
            start = at
            while start > email_at and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_at = m.end()
                found.append(("email", start, email_at))
            else:
                email_at = max(email_at, at)  # nothing before this sign can match any more
        elif kind == "+":
            if at >= phone_at and (m := _PHONE.match(text, at)):
                stop = m.end()
                while not ("0" <= text[stop - 1] <= "9"):
                    stop -= 1
                if stop >= at + 4:
                    phone_at = stop
                    if 8 <= sum("0" <= c <= "9" for c in text[at:stop]) <= 15:
                        found.append(("phone", at, stop))
        elif kind == "cue":
            if m := _ASSIGNED.match(text, end + 1):
                start = m.end()
                if start >= value_end:
                    value_end = _VALUE.match(text, start).end()
                    m = _LAST_DIGIT.match(text, start, value_end)
                    digit_end = m.end() if m else 0
                if value_end - start >= 8 and digit_end > start:
                    found.append(("secret", start, value_end))
        elif kind == "key":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _KEY_ID.match(text, at)):
                found.append(("secret", at, m.end()))
        elif end + 1 < n and (m := _USER.match(text, end + 1)):
            found.append(("url_user", m.start(), m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (order[s[0]], s[1], s[2]))


def redacted(text: str | None) -> str | None:
    """text with each span replaced by its kind in brackets; spans that overlap are replaced together under the kind listed first.

    A replacement can part a run of digits and so leave a valid one: what is left is searched until nothing is found.
    """
    while found := sorted(spans(text), key=lambda s: s[1]):
        out, at, k = [], 0, 0
        while k < len(found):
            kind, start, end = found[k]
            k += 1
            while k < len(found) and found[k][1] < end:
                kind, end = min(kind, found[k][0], key=KINDS.index), max(end, found[k][2])
                k += 1
            out += text[at:start], f"[{kind.upper()}]"
            at = end
        text = "".join([*out, text[at:]])
    return text


def spans_column(text: Column) -> Column:
    """array<struct<kind, start, end>> of whole texts; null for none."""

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch.to_pylist()], kind)

    return find.asNondeterministic()(text)


def redacted_column(text: Column) -> Column:
    """Whole texts with all spans replaced; null stays null."""

    @F.arrow_udf("string")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([redacted(t) for t in batch.to_pylist()], pa.string())

    return redact.asNondeterministic()(text)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end>> by kind as listed, then start."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).select("doc_id", spans_column(F.col("text")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with all their columns, personal data in the text replaced."""
    small_batches(docs.sparkSession)
    new = free_name(docs, "redacted")
    return docs.withColumn(new, redacted_column(docs[text_col])).select(*[F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all, joined) of find_personal_data's rows."""

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
