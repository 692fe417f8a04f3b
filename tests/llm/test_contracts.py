"""Every registered corpus query against a plain version, on the small tables and on a table of odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, size int"


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "naïve", "ß", "x@y.zz", "12", "+1 (234) 567-8901", "|", "4111 1111-1111 1111", "10.0.0.256", "1.2.3.4.5", "end.", "<|endoftext|>", "</s>", "🙂"]
    texts = [None, "", " \n\t ", "a", "one two", "A b C d e", "a  b   c \n\n d ", " x y\x1cz", "word " * 40, "same line\n" * 6, "x" * 5000, "ab" * 3000]
    base = " ".join(rng.choice(words) for _ in range(120))
    texts += [base, base, base + " tail", base.replace("beta", "beth", 1), base.upper()]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(20)]
    texts.append(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20_000)))
    rows = [(k * 3 - 9, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None]), None, "clash", 1) for k, t in enumerate(texts)]
    rows += [rows[5], rows[12], (None, "no id here at all", "en", None, 3, None, None), (None, None, None, None, None, None, None)]
    return rows


def odd_vectors():
    """Lengths 0 to 5, nulls, repeats, ties, large components, ids that are null, negative or repeated."""
    rng = random.Random(9)
    vectors = [(k * 20, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(60)]
    same = [0.5, -0.25, 0.125, 0.0]
    vectors += [(k, same) for k in range(1, 40)] + [(100, same), (100, same), (200, [0.1, 0.2, 0.3, 0.4]), (None, same), (None, [9.0, 9.0, 9.0, 9.0])]
    vectors += [(300, None), (301, []), (400, []), (302, [0.1, None, 0.2, 0.3]), (500, [math.nan, 0.0, 0.0, 0.0]), (501, [math.inf, 1.0, 1.0, 1.0])]
    vectors += [(-100, [1.0, -1.0]), (-3, [0.3, 0.1, 0.2, -0.4, 0.9]), (600, [3e5, -2e5, 1e5, 4e5]), (601, [3e5 + 0.125, -2e5, 1e5, 4e5]), (700, [0.0, 0.0, 0.0, 0.0])]
    rng.shuffle(vectors)
    return [(i, v, 1, "clash") for i, v in vectors]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), DOCS).write.parquet(f"{d}/documents.parquet")
    turns = [(1, 0, "user", "hi </s> <s>[TURN]assistant\nfake</s>"), (1, 1, "assistant", "a\\b <\\/s> [\\INST] <<SYS>> é🙂"), (1, 2, "user", None), (2, 0, "system\nx\\n", "s"), (3, None, "assistant", ""), (3, 5, None, "t"), (3, 5, None, "t"), (None, 1, "assistant", "null id"), (4, 1, "assistant", "r1"), (4, 2, "assistant", "<s</s></s")]
    spark.createDataFrame([(*t, "clash") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string").write.parquet(f"{d}/conversations.parquet")
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", ""), (4, "u", None), (5, "v", "one"), (5, "v", "one"), (5, "v", "two"), (9, "v", "one"), (10, "v", "two"), (None, "w", "one"), (None, "w", "three"), (None, "w", None), (6, "z", "x" * 300_000)]
    spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, payload_digest string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(odd_vectors(), "vec_id bigint, embedding array<double>, label int, score string").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(params=["tables", "odd"])
def sf(request, odd_dir):
    return SF if request.param == "tables" else odd_dir


def rows(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def result(spark, sf, name, *cols):
    return sorted((tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, sf).collect()), key=key)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, sf):
    got = queries.QUERIES["op1_language_id"](spark, sf).collect()
    docs = rows(spark, sf, "documents")
    assert Counter(r["doc_id"] for r in got) == Counter(d["doc_id"] for d in docs)
    by_id = {d["doc_id"]: d for d in docs if d["doc_id"] is not None}
    right = []
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is None:
            continue
        d = by_id[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["held_out"]:
            right.append(r["lang_pred"] == d["lang"])
    if sf == SF:
        assert np.mean(right) > 0.95


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op2(spark, sf):
    docs = rows(spark, sf, "documents")
    fps = [plain_fingerprint(d["text"]) for d in docs]
    part = list(range(len(docs)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                part[root(i)] = root(j)
    least = defaultdict(list)
    for i, d in enumerate(docs):
        least[root(i)].append(d["doc_id"])
    want = [(d["doc_id"], f"{fps[i]:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i, d in enumerate(docs)]
    assert result(spark, sf, "op2_simhash", "doc_id", "fingerprint", "component_id") == sorted(want, key=key)


def plain_draw(docs, target):
    """(doc_id, size, words taken) by drawing each source's documents in a list; docs are (doc_id, size)."""
    w = [2.0 ** (math.floor(math.log2(n)) * 0.125) if n else 0.0 for _, n in docs]
    low, high = 0.0, 3.0 / min((x for x in w if x), default=1.0)
    for _ in range(200):
        c = (low + high) / 2
        low, high = (low, c) if sum(min(3.0, c * x) * n for x, (_, n) in zip(w, docs, strict=True)) > target else (c, high)
    drawn = []
    for x, (k, n) in zip(w, docs, strict=True):
        copies = min(3.0, high * x)
        whole = math.floor(copies + 1e-9)
        p = max(copies - whole, 0.0) if copies - whole > 1e-9 else 0.0
        u = (int(hashlib.md5(f"17:{'null' if k is None else k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        odds = u / (1 - u) / (p / (1 - p)) if p else math.inf
        drawn.append((odds, k or 0, n, k, whole, p))
    need, reach, out = target - sum(d[2] * d[4] for d in drawn), 0, []
    for _, _, n, k, whole, p in sorted(drawn, key=lambda d: d[:3]):
        reach += n if p else 0
        out.append((k, n, n * (whole + bool(p and reach - n / 2 <= need))))
    return out


def test_op3(spark, sf):
    docs = rows(spark, sf, "documents")
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 3.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    got = queries.QUERIES["op3_mixing"](spark, sf).collect()
    by_id = defaultdict(list)
    for d in docs:
        by_id[d["doc_id"], len(WORD.findall(d["text"] or ""))].append(d["source"])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter({k: len(v) for k, v in by_id.items()})
    taken = Counter()
    for r in got:
        copies = r["taken"] / r["size"] if r["size"] else 0
        assert copies == int(copies) and 0 <= copies <= 3 and (r["size"] or r["taken"] == 0)
        s = [s for s in by_id[r["doc_id"], r["size"]] if math.isclose(target[s], r["target"], rel_tol=1e-9, abs_tol=1e-9) and sizes[s] == r["source_size"]]
        assert s
        taken[s[0]] += r["taken"]
    biggest = Counter()
    for d in docs:
        biggest[d["source"]] = max(biggest[d["source"]], len(WORD.findall(d["text"] or "")))
    for s in order:
        assert abs(taken[s] - target[s]) <= biggest[s], s
    want = []
    for s in order:
        want += plain_draw([(d["doc_id"], len(WORD.findall(d["text"] or ""))) for d in docs if d["source"] == s], target[s])
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=key) == sorted(want, key=key)
    again = queries.QUERIES["op3_mixing"](spark, sf).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def plain_tree(text):
    """Leaves, sections and root of a text."""
    from weftline.llm import merkle

    paragraphs = []
    for p in re.split(r"(?<=\n)|(?<=[.!?\u061F\u06D4\u0964\u0965\u1362][ \t\n\x0b\f\r])|(?<=[\u3002\uFF01\uFF0E\uFF1F\uFF61])", text):
        start = 0
        for i in range(4, len(p)) if len(p) > merkle.LONG else ():
            h = 42
            for c in reversed(p[i - 4 : i]):
                h = xxhash.xxh64_intdigest(c.encode(), h)
            if h % merkle.LONG_STEP == 0:  # 2**64 is a multiple of it, so the sign does not matter
                paragraphs.append(p[start:i])
                start = i
        paragraphs.append(p[start:])
    leaves = [sha(p) for p in paragraphs]
    sections, run = [], []
    for k, leaf in enumerate(leaves, 1):
        run.append((k, leaf))
        if k == len(leaves) or int(leaf[:8], 16) % merkle.SECTION_PARAGRAPHS == 0:
            sections.append((sha("".join(x for _, x in run)), run))
            run = []
    return leaves, sections, sha("".join(h for h, _ in sections))


def plain_likeness(a, b):
    (la, _, ra), (lb, _, rb) = a, b
    return 1.0 if ra == rb else 2 * len({*la} & {*lb}) / (len({*la}) + len({*lb}) + 2)


def plain_edits(a, b):
    known, leaves = {h for h, _ in b[1]}, {*b[0]}
    return [k for h, run in a[1] if h not in known for k, leaf in run if leaf not in leaves]


def test_op4(spark, sf):
    from functools import cache

    tree = cache(plain_tree)
    docs = sorted(rows(spark, sf, "documents"), key=lambda d: (d["doc_id"] is None, -(d["doc_id"] or 0)))
    ids = [d["doc_id"] for d in docs]
    got = queries.QUERIES["op4_merkle"](spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(ids)
    texts = defaultdict(list)
    for d in docs:
        texts[d["doc_id"]].append(d["text"] or "")
    for r in got:  # a repeated id, or none, may be followed by any row of its own id
        last = len(ids) - 1 - ids[::-1].index(r["doc_id"])
        after = texts[ids[(last + 1) % len(ids)]] + (texts[r["doc_id"]] if len(texts[r["doc_id"]]) > 1 else [])
        fits = []
        for t in texts[r["doc_id"]]:
            for n in after:
                edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
                own, changed = tree(t), tree(edited)
                fits.append((r["doc_id"], len(t), sha(edited), own[2], changed[2], plain_likeness(own, changed), plain_likeness(own, tree(n)), len(plain_edits(changed, own))))
        assert any(r[k] == f[k] for f in fits for k in (3,)) and tuple(r) in fits
    if sf == SF:
        assert np.mean([r["near_edited"] for r in got]) > 0.5 > np.mean([r["near_next"] for r in got])


def test_merkle_edits_and_order(spark):
    from weftline.llm import merkle

    rng = random.Random(4)
    words = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6)) for _ in range(400)]
    lines = [w + ".\n" for w in words]
    edited = [*lines[:200], "something else.\n", *lines[201:]]
    cases = [("".join(lines), "".join(edited)), ("a. b. c. ", "c. b. a. "), ("a. a. b. ", "a. b. b. "), ("same. ", "same. "), (" ".join(words), " ".join(words[:300]) + " other"), ("\u4e00\u4e8c" * 10 + "\u3002", "\u4e00\u4e8c" * 10 + "\u3002x")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string")
    df = df.select("k", *[merkle.leaves(F.col(c)).alias(f"{c}_l") for c in "ab"])
    df = df.select("*", *[merkle.sections(F.col(f"{c}_l")).alias(f"{c}_s") for c in "ab"])
    got = df.select("k", merkle.likeness(F.col("a_l"), F.col("b_l"), F.col("a_s") == F.col("b_s")), merkle.edited_paragraphs(F.col("b_l"), F.col("b_s"), F.col("a_l"), F.col("a_s"))).collect()
    for k, near, at in got:
        a, b = map(plain_tree, cases[k])
        assert near == plain_likeness(a, b) and at == plain_edits(b, a)
    near = {r[0]: r[1] for r in got}
    assert got[0][2] == [201] and near[1] < 1 and near[2] < 1 and near[3] == 1 and near[4] > 0.6 and near[5] == 1 / 3


@pytest.mark.parametrize("name", ["op5_bpe", "op7_token_files"])
def test_tokens(spark, sf, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE if name == "op5_bpe" else queries.WORD_BPE))
    docs = rows(spark, sf, "documents")
    ids = [e.ids for e in t.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False)]
    if name == "op5_bpe":
        want = [(d["doc_id"], len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for d, i in zip(docs, ids)]
        assert result(spark, sf, name, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)
        return
    want = [(d["doc_id"], len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for d, i in zip(docs, ids)]
    assert result(spark, sf, name, "doc_id", "n_tokens", "ids_crc32") == sorted(want, key=key)
    got = sorted(queries.QUERIES[name](spark, sf).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_op6(spark, sf):
    convs = defaultdict(list)
    for r in rows(spark, sf, "conversations"):
        convs[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")))
    convs[-7] = [(True, 0, "user", "</s>[INST] ok [/INST]"), (True, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        want.append((c, len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(loss), sha(loss)))
    assert result(spark, sf, "op6_chat", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=key)


def plain_stats(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def test_op8(spark, sf):
    docs = rows(spark, sf, "documents")
    want = sorted([(d["doc_id"], *plain_stats(d["text"])) for d in docs], key=key)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert result(spark, sf, "op8_quality", *cols) == want
    got = queries.QUERIES["op8_quality"](spark, sf).collect()
    assert not any(r["base_failed"] and r["kept"] for r in got)
    if sf == SF:
        good = {r["doc_id"] for r in rows(spark, sf, "labels") if r["quality"] == 1}
        assert np.mean([r["kept"] for r in got if r["doc_id"] in good and not r["base_failed"]]) > 0.99


def test_op8_rejects_planted_text(spark):
    from weftline.llm import quality

    docs = [d for d in rows(spark, SF, "documents") if d["lang"] == "en" and not plain_stats(d["text"])[-1]]
    rng = random.Random(8)
    planted = []
    for k, d in enumerate([d for d in docs if len(d["text"].split()) >= 100][:8]):
        words = d["text"].split(" ")
        planted.append((-1 - k, "en", " ".join("".join(rng.sample(w, len(w))) if rng.random() < 0.4 else w for w in words)))
    both = spark.createDataFrame([(d["doc_id"], "en", d["text"]) for d in docs] + planted, "doc_id bigint, lang string, text string")
    got = {r["doc_id"]: r for r in quality.quality(both).collect()}
    assert len(planted) == 8 and not any(got[k]["base_failed"] or got[k]["kept"] for k, _, _ in planted)
    assert np.mean([got[d["doc_id"]]["kept"] for d in docs]) > 0.9


def plain_kneser_ney(texts, order):
    """Mean negative log-probability of each text, by counting in dictionaries."""
    grams = lambda t: [(" " * (order - 1) + t)[i : i + order] for i in range(len(t))]
    tables = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    p = {"": 1 / 0x110000}
    for k in range(1, order + 1):
        n = Counter(tables[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = {j: min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.05), j) if min(n[1], n[2], n[3], n[4]) else j / 2 for j in (1, 2, 3)}
        total, left = Counter(), Counter()
        for g, c in tables[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        p = {g: (c - d[min(c, 3)] + left[g[:-1]] * p[g[1:] if k > 1 else ""]) / total[g[:-1]] for g, c in tables[k].items()}
    return [-np.mean([math.log(p[g]) for g in grams(t)]) for t in texts]


def test_op8_model_grows_over_whole_code_points(spark, monkeypatch):
    from weftline.llm import quality

    rng = random.Random(9)
    vocabulary = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(2)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(200)] + ["A " * 30, "\U00010041 " * 30]
    scrambled = ["".join(rng.sample(t, len(t))) for t in texts[:5]]
    scrambled = [" ".join(t.replace(" ", "")[i : i + 2] for i in range(0, 120, 2)) for t in scrambled]
    docs = spark.createDataFrame([(k, t, "zh") for k, t in enumerate(texts + scrambled)] + [(999, "other words", None)], "id bigint, text string, lang string")
    monkeypatch.setattr(quality, "RANGE_KEYS", 1000)
    want = plain_kneser_ney(texts + scrambled, quality.ORDER)
    assert quality.train(docs).agg(F.sum("n")).first()[0] > 10_000
    for limit in (quality.MODEL_BYTES, 30_000):
        got = {r["id"]: r["q"]["nll"] for r in quality.scored(docs, "q", limit=limit).collect()}
        assert max(abs(got[k] - x) for k, x in enumerate(want)) < 1e-5


def test_op9(spark, sf):
    pages = rows(spark, sf, "pages")
    groups = defaultdict(list)
    for p in pages:
        groups[p["html"] or ""].append(p["page_id"])
    want = []
    for p in pages:
        data = (p["html"] or "").encode()
        top = max((x for x in groups[p["html"] or ""] if x is not None), default=None)
        again = p["page_id"] != top
        want.append((p["page_id"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert result(spark, sf, "op9_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=key)


def test_warc_of_others(spark, tmp_path):
    from weftline.llm import warc

    info = b"WARC/1.0\r\nwarc-type:warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\ncontent-length: 4\r\n\r\nabcd\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\ncontent-length:5\r\n\r\n"
    block = head + b"hel\xfflo"[:5]
    answer = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nX-Folded: a\r\n  b\r\nWARC-Payload-Digest: md5:00\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    again = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Refers-To: <urn:uuid:2>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    path = tmp_path / "o.warc.gz"
    path.write_bytes(b"".join(map(warc.compressed, (info, answer, other, again))))
    manifest = spark.createDataFrame([(str(path), None)], "path string, records bigint")
    got = [(r["record_id"], r["page_id"], r["record_type"], r["payload"], r["payload_bytes"], r["refers_to"]) for r in warc.read_archives(manifest).collect()]
    assert got == [("<urn:uuid:1>", None, "warcinfo", None, None, None), ("<urn:uuid:2>", None, "response", "hel\ufffdl", 5, None), (None, None, "resource", "xyz", 3, None), ("<urn:uuid:3>", None, "revisit", None, None, None)]


def test_archives_are_gzip_members_on_disk(spark, tmp_path):
    import gzip

    from weftline.llm import warc

    pages = spark.createDataFrame([(k, "u", f"text {k}") for k in range(5)], "page_id bigint, url string, html string").coalesce(1)
    path = warc.write_archives(pages, str(tmp_path)).first()["path"]
    with gzip.open(path) as f:
        assert f.read().count(b"WARC/1.1\r\n") == 5


def test_warc_payloads_by_size(spark, tmp_path):
    from weftline.llm import warc

    pages = spark.createDataFrame([(1, "u", "long one"), (2, "u", "long one"), (1, "u", "s"), (2, "u", "s")], "page_id bigint, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, str(tmp_path), min_payload=5)).collect()
    assert sorted((r["page_id"], r["record_type"], r["payload"] or "", r["refers_to"] or 0) for r in got) == [(1, "response", "s", 0), (1, "revisit", "", 2), (2, "response", "long one", 0), (2, "response", "s", 0)]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn(d) or k == "phone" and 8 <= len(d) <= 15:
                out.append((k, m.start(), m.end()))
    return out


def test_op10(spark, sf):
    docs = rows(spark, sf, "documents")
    want = []
    for d in docs:
        s = plain_spans(d["text"])
        n = Counter(k for k, _, _ in s)
        want.append((d["doc_id"], n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))))
    assert result(spark, sf, "op10_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=key)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty(spark, empty_dir, name):
    got = queries.QUERIES[name](spark, empty_dir).collect()
    assert len(got) == (1 if name == "op6_chat" else 0)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, sf)
        after = [r.asDict() for r in out.collect()]
        if k < 4:
            assert out.columns == names
        if k == 0:
            assert after and not any(plain_stats(d["text"])[-1] for d in after)
        if k == 1:
            fps = [plain_fingerprint(d["text"]) for d in after]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
            classes = []  # of linked fingerprints: one document of each must stay
            for x in {plain_fingerprint(d["text"]) for d in before}:
                near = [c for c in classes if any((x ^ y).bit_count() <= 4 for y in c)]
                classes = [c for c in classes if c not in near] + [{x}.union(*near)]
            assert len(after) == len(classes) and all(sum(x in c for x in fps) == 1 for c in classes)
        if k == 2:
            assert len(after) == len(before) and not any(plain_spans(d["text"]) for d in after)
        if k == 3:
            assert max(Counter(d["doc_id"] for d in after if d["doc_id"] is not None).values()) <= 3 * max(Counter(d["doc_id"] for d in before).values())
            size = lambda x: sum(len(WORD.findall(d["text"] or "")) for d in x)
            assert abs(size(after) - size(before)) <= 0.1 * size(before) + 200
        if k == 4:
            assert len(after) == len(before)
        docs = out


def test_hot_groups_are_dealt_again(spark):
    from weftline.llm import simhash

    rng = random.Random(2)
    base = rng.getrandbits(63)
    fps = {base}
    for _ in range(300):
        x = base
        for b in rng.sample(range(63), rng.randint(0, 7)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(63) for _ in range(300)}
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    label = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[a] > label[b]:
                    label[a], changed = label[b], True
    found = []
    for limit in (20, 50_000):
        edges = simhash.near_links(df, group_rows=limit)
        for r in edges.collect():  # every link stays within a component of the brute-force labels
            assert label[r["a"]] == label[r["b"]]
        roots = {r["node"]: r["root"] for r in simhash.connected_components(edges).collect()}
        found.append({x: roots.get(x, x) for x in fps})
    assert found[0] == found[1] == label


def test_chat_examples(spark):
    from weftline.llm import chat

    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "end")], "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_conversations(turns).orderBy("example").collect()
    assert [None if r["reply_start"] is None else r["formatted"][r["reply_start"] : r["reply_end"]] for r in got] == ["a1", "a2", None]
    assert got[0]["formatted"] == "<s>[TURN]user\nq</s><s>[TURN]assistant\na1</s>" and got[2]["formatted"].startswith(got[1]["formatted"])


def test_warc_errors(spark, tmp_path):
    from weftline.llm import warc

    data = warc.compressed(warc.record(1, "u", b"payload"))
    bad = tmp_path / "bad.gz"
    bad.write_bytes(data[:-9])
    with open(bad, "rb") as f, pytest.raises(EOFError):
        list(warc.members(f))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"payload").replace(b"payload\r", b"paxload\r"))


def test_token_files_sample_and_wide_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from weftline.llm import token_files

    library = Tokenizer.from_file(queries.tokenizer_path(queries.WORD_BPE))
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["word", "don't", "\u0130x", "a.b,", "x,", "naive\u0301", "\u2167", "12a", "<|ENDOFTEXT|>", "<|endoftext|>", "\u00a0q", "\u4e2d\u6587", "Stra\u00dfe.", "\u03a3\u03a3"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(k if k % 3 else None, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    for end in (2, 0, 70_000):
        manifest = token_files.write_token_files(docs, str(tmp_path), library_path := queries.tokenizer_path(queries.WORD_BPE), end_id=end, shards=5)
        assert library_path and manifest.count() > 2
        got = [r["ids"] for r in token_files.read_token_files(manifest).collect()]
        want = [[*e.ids, end] for e in library.encode_batch(texts, add_special_tokens=False)]
        assert sorted(got) == sorted(want)
    coded = spark.read.schema("doc_id bigint, ids binary, n bigint, row bigint, n_bytes bigint").parquet(_coded_path(spark, docs, library_path))
    assert len(token_files.train_dictionary(coded)) > 1000 and token_files.train_dictionary(coded, sample_bytes=10) == b""


def _coded_path(spark, docs, path):
    from weftline.llm import token_files
    from weftline.llm.common import scratch

    out = scratch(spark, "coded_test")
    coded = token_files._coded(docs, path, 2).withColumn("row", F.monotonically_increasing_id()).withColumn("n_bytes", F.octet_length("ids").cast("long"))
    coded.write.parquet(out)
    return out


def test_token_file_access(spark, tmp_path):
    from weftline.llm import files, token_files

    docs = spark.createDataFrame([(k, f"word {k} and some more text " * (k % 7)) for k in range(60)], "doc_id bigint, text string")
    manifest = token_files.write_token_files(docs, str(tmp_path), queries.tokenizer_path(queries.WORD_BPE), shards=3).orderBy("shard").collect()
    whole = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark.createDataFrame(manifest)).collect()}
    with files.open_file(manifest[0]["dictionary"]) as f:
        trained = f.read()
    with files.open_file(manifest[-1]["path"]) as f:
        z, index = token_files.decompressor(f, trained), token_files.read_index(f)
        assert token_files.read_document(f, index, 3, z).tolist() == whole[int(index[3, 0])]
        with pytest.raises(ValueError):
            token_files.decompressor(f, b"other")


def test_op1_repeated_ids(spark):
    """Rows that share an id: one of them is learned from, so the sample stays bounded."""
    from weftline.llm import language_id

    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    same = [(1, f"the same id {k % 500} and some more words", "en") for k in range(1000)] + [(2, "noch ein Text", "de")] * 300
    docs = known.where("doc_id > 2").unionByName(spark.createDataFrame(same, "doc_id bigint, text string, lang string"))
    model = language_id.fit(docs)
    assert model.marks.shape[1] <= language_id.LANDMARKS * len(model.languages)
    got = language_id.identify(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got}[1] == 1000


def usable_vectors(spark, sf):
    out = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in rows(spark, sf, "embeddings") if r["embedding"] is not None and None not in r["embedding"]]
    out = [(i, v) for i, v in out if all(map(math.isfinite, v))]
    most = max(len(v) for _, v in out)
    return [(i, v + [0.0] * (most - len(v))) for i, v in out]


def plain_topk(vectors, k=10):
    whole = [[math.floor(1024 * c) for c in v] for _, v in vectors]
    out = []
    for r, (q, _) in enumerate(vectors):
        if q is not None and q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[r], w, strict=True)), i is None, i or 0) for c, ((i, _), w) in enumerate(zip(vectors, whole, strict=True)) if c != r)
            out += [(q, n + 1, None if no_id else i, -s) for n, (s, no_id, i) in enumerate(scored[:k])]
    return out


def test_op11(spark, sf):
    got = result(spark, sf, "op11_exact_topk", "query_id", "rank", "vec_id", "score")
    assert got == sorted(plain_topk(usable_vectors(spark, sf)), key=key)


def test_topk_stops_before_the_end_of_the_lists(spark):
    """Small blocks and groups, few rows, k above the number of candidates, scores beyond 2^53; a clear winner ends a race early."""
    from weftline.llm import topk

    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(400, 3))) ** 4 * rng.choice([1, 1, -1], size=(400, 3))
    vectors = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 100 = 0"), k=3, cells=60).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(plain_topk(vectors, 3))
    large = [(k * 100, [float(rng.integers(-(2**20), 2**20)) for _ in range(3)]) for k in range(5)]
    df = spark.createDataFrame(large, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(df, df, k=50).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(plain_topk(large, 50)) and max(abs(g[3]) for g in got) > 2**53

    depths = []
    race = topk._Race(2)
    race.add_queries(2, np.array([7], np.int64).tobytes(), np.array([[1.0, -1.0]]).tobytes())
    race.begin()
    n = 1000
    block = np.zeros((n, 2))
    block[:, 0] = np.arange(n)
    block[:, 1] = -block[:, 0]
    settle = race._settle
    race._settle = lambda some, of, score, no_id, ids: (depths.append(len(score)), settle(some, of, score, no_id, ids))
    places = np.argsort(block, axis=0).T
    race.meet(2, np.arange(n).tobytes(), np.zeros(n, bool).tobytes(), np.take_along_axis(block.T, places, 1).astype("<f8").tobytes(), places.astype("<u4").tobytes())
    assert race.id.tolist() == [[n - 1, n - 2]] and 0 < sum(depths) < 20  # outsiders were never scored


def test_op12(spark, sf):
    got = queries.QUERIES["op12_whitening"](spark, sf).collect()
    vectors = usable_vectors(spark, sf)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in vectors], float)
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    centred = x - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value)[:8]
    k = len(order)
    white = centred @ vector[:, order] / np.sqrt(value[order])
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    deviation = [d if d < 2**63 else None for d in deviation]
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert {(r["component"], round(r["explained"], 12)) for r in got} == {(c + 1, round(value[order[c]] / np.trace(v), 12)) for c in range(k)}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-4
    assert sorted(((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1), key=key) == sorted(((i, d) for (i, _), d in zip(vectors, deviation, strict=True)), key=key)
    for c in range(k):
        own = np.array([w for _, w in sorted((((r["vec_id"], r["deviation"]), r["whitened"]) for r in got if r["component"] == c + 1), key=lambda p: key(p[0]))])
        want = np.array([w for _, w in sorted((((i, d), w) for (i, _), d, w in zip(vectors, deviation, white[:, c], strict=True)), key=lambda p: key(p[0]))])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < (1e-9 + 2e-15 * value.max() / value[order[c]]) * max(1, np.abs(want).max())  # rounding as the eigenvalues' ratio allows


def test_whitening_merges_and_flat_directions(spark):
    from weftline.llm import whitening

    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) + 1e6
    parts = [whitening.summary(x[a:b]) for a, b in ((0, 1), (1, 7), (7, 50))]
    s = whitening.merged(whitening.merged(parts[2], None), whitening.merged(parts[0], parts[1]))
    assert s.n == 50 and np.allclose(s.scatter, np.cov(x.T, bias=True) * 50, rtol=1e-9) and np.allclose(s.mean, x.mean(axis=0), rtol=1e-12)
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.75]), (3, [0.5, 0.5]), (4, None)], "vec_id int, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 6 and {r["whitened"] for r in got if r["component"] == 2} == {0.0} and got[0]["identity_error"] < 1e-9
    assert df.schema["vec_id"].dataType == whitening.whiten(df).schema["vec_id"].dataType
    one = whitening.whiten(df.where("vec_id = 1")).collect()
    assert len(one) == 2 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one} == {(0.0, 0.0, 0, 0.0)}
    model = whitening.Whitening(3 * 10**9, [0], np.zeros(1), np.ones((1, 1)), np.ones(1), np.ones(1, bool))
    assert model.deviations(np.array([[1.0], [2.0]])) == [9 * 10**18, None]


def plain_manifest(docs):
    def h(*parts):
        return sha("".join(parts))

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][a : a + 16]) for a in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, place):
        out = []
        for nodes in levels[:-1]:
            first = place // 16 * 16
            out.append((nodes[first:place], nodes[place + 1 : first + 16]))
            place //= 16
        return out

    by = defaultdict(list)
    for d in docs:
        leaf = h(*[field(d[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
        hit = d["doc_id"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0
        changed = d | {"text": re.sub("[A-Z]", lambda m: m[0].lower(), d["text"])} if hit else d
        by[d["source"]].append((d["doc_id"] is not None, d["doc_id"] or 0, leaf, h(*[field(changed[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([leaf for _, _, leaf, _ in sorted(by[s])]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for place, (known, doc_id, leaf, changed) in enumerate(sorted(by[s])):
            steps = path(trees[s], place) + path(top, k)
            own = changed
            for left, right in steps:
                own = h(*left, own, *right)
            out.append((doc_id if known else None, leaf, trees[s][-1][0], top[-1][0], h(*[x for left, right in steps for x in left + right]), own, own == top[-1][0]))
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_op13(spark, sf):
    got = result(spark, sf, "op13_merkle_manifest", *MANIFEST)
    assert got == sorted(plain_manifest(rows(spark, sf, "documents")), key=key)
    assert {g[-1] for g in got} == {True, False}


def test_manifest_of_many_sources_and_levels(spark, tmp_path):
    """Sources of 1, 16, 17, 256 and 300 rows, equal rows, and a tree over more than 16 sources."""
    from weftline.llm import manifest

    sizes = {None: 1, "": 2, "a": 16, "b": 17, "hot": 300, "z": 256} | {f"s{k}": 1 for k in range(40)}
    docs = [{"doc_id": k * 7 % 1000, "source": s, "lang": None, "n_chars": k, "text": f"Text {k} of {s}"} for s, n in sizes.items() for k in range(n)]
    docs += [dict(docs[50])] * 3
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = sorted((tuple(r[c] for c in MANIFEST) for r in manifest.build(df.repartition(7)).collect()), key=key)
    assert got == sorted(plain_manifest(docs), key=key)
    one = manifest.build(df.where("source = 's3'")).first()
    assert one["root"] == one["subroot"] == one["leaf"] and one["proof_sha256"] == sha("")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    assert result(spark, SF, name, *want.columns) == sorted(map(tuple, want.fetchall()), key=key)
