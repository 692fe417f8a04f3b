"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, language_id, manifest, merkle, mixing, pii, quality, simhash, token_files, topk, warc, whitening
from weftline.llm.common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("edited_at").cast("long").alias("n_edited_paragraphs"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE)))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(own)))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 100 = 0"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.build(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_simhash, op3_mixing, op4_merkle, op5_bpe, op6_chat, op7_token_files, op8_quality, op9_warc, op10_pii, op11_exact_topk, op12_whitening, op13_merkle_manifest)
}

#: CRC-32 of a short ASCII text: each byte goes into the remainder, then eight shifts.
_CRC = """(select xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)::bigint[]), lambda t, i: xor(t >> 1, 3988292384 * (t & 1)))), 4294967295))"""

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

ORACLE_SQL: dict[str, str] = {
    "op11_exact_topk": """
        with usable as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
                        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score from usable q join usable c on q.r <> c.r where q.vec_id % 100 = 0)
        select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored) where rank <= 10
    """,
    "op13_merkle_manifest": f"""
        with recursive doc as (select row_number() over () as r, doc_id, source, {_LEAF.format(text="text")} as leaf,
            case when {_CRC.format(text="doc_id::varchar")} % 5 = 0 then {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as tampered from documents),
        leaf as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 as place, count(*) over (partition by source) as n from doc),
        up as (select 0 as level, source, place, n, leaf as digest from leaf
            union all select level + 1, source, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by place)) from up where n > 1 group by level, source, place // 16, n),
        subroot as (select source, digest as subroot, max(level) over () as most, level as height, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from up where n = 1),
        top as (select 0 as level, place, n, subroot as digest from subroot
            union all select level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' order by place)) from top where n > 1 group by level, place // 16, n),
        fold as (select r, source, 0 as level, place, n, coalesce(tampered, leaf) as digest, '' as path from leaf
            union all select f.r, f.source, f.level + 1, f.place // 16, (f.n + 15) // 16, sha256(string_agg(case when u.place = f.place then f.digest else u.digest end, '' order by u.place)),
                f.path || coalesce(string_agg(case when u.place <> f.place then u.digest end, '' order by u.place), '')
            from fold f join up u on u.source is not distinct from f.source and u.level = f.level and u.place // 16 = f.place // 16 where f.n > 1 group by f.r, f.source, f.level, f.place, f.n, f.path),
        fold_top as (select f.r, 0 as level, s.place, s.n, f.digest, f.path from fold f join subroot s on s.source is not distinct from f.source where f.n = 1
            union all select f.r, f.level + 1, f.place // 16, (f.n + 15) // 16, sha256(string_agg(case when u.place = f.place then f.digest else u.digest end, '' order by u.place)),
                f.path || coalesce(string_agg(case when u.place <> f.place then u.digest end, '' order by u.place), '')
            from fold_top f join top u on u.level = f.level and u.place // 16 = f.place // 16 where f.n > 1 group by f.r, f.level, f.place, f.n, f.path)
        select l.doc_id, l.leaf, s.subroot, t.digest as root, sha256(f.path) as proof_sha256, f.digest as folded_root, f.digest = t.digest as verified
        from leaf l join subroot s on s.source is not distinct from l.source join top t on t.n = 1 join fold_top f on f.r = l.r and f.n = 1
    """,
}
