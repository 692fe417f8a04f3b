"""Item tags: cleaning what a tagging model answers, its errors, and audits of tagged catalogs.

Null texts count as empty. Elements of tag lists are trimmed; blank and null ones are dropped.
Catalog columns: item_id, category, store_id, title, body_shapes, seasons, colors (JSON lists as text), note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.expressions import once
from weftline.functions.vocab import BODY_SHAPES, SEASONS
from weftline.operators.tags import split_by_domain

# Fixed values.
FALLBACK_NOTES = {
    "accessory": "Phụ kiện tạo điểm nhấn và hoàn thiện tổng thể outfit.",
    "bag": "Phụ kiện túi giúp hoàn thiện outfit và tăng tính ứng dụng.",
    "shoes": "Giày dép trung tính, dễ phối để hoàn thiện outfit.",
}
PLAIN_NOTE = "Item cơ bản, có thể dùng linh hoạt khi phối outfit."
MAIN_CATEGORIES = ("top", "bottom", "dress", "outerwear")
LEAK_MARKERS = ("winerror", "traceback", "http", "quota", "connection refused", "could not connect", "error while tagging", "runtimeerror")
WINTER_WORDS = ("áo khoác dạ", "áo phao", "phao", "măng tô", "vải dạ", "puffer", "coat", "len cổ lọ")
SUMMER_WORDS = ("sandal", "dép", "áo ba lỗ", "tank top", "short", "shorts", "chống nắng")
OTHER_GARMENTS = {"bag": ("áo", "quần", "váy", "đầm", "giày"), "accessory": ("áo", "quần", "váy", "đầm"), "shoes": ("áo", "quần", "váy", "đầm", "túi")}
OUTAGE_MARKERS = (
    "connection refused", "actively refused", "winerror 10061", "winerror 10060", "could not connect", "failed to establish a new connection",
    "failed to respond", "timed out", "connection reset", "connection aborted", "remote end closed connection", "eof",
)
MOST_TAGS = {"body_shapes": 3, "seasons": 3, "colors": 5}
MOST_NOTE_CHARS = 140

def _none() -> Column:
    return F.array().cast("array<string>")


def _has_any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


def _trimmed(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")  # a bare F.trim would get the index as its second argument


def _is_list(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit("[")) & F.try_parse_json(text).isNotNull(), F.lit(False))


def parse_tags(raw: Column) -> Column:
    """struct<found, failed> of a JSON list as text: its strings, and whether it is something else than a list, "nan" or nothing."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    ok = _is_list(text)
    found = F.when(ok, F.coalesce(_trimmed(F.from_json(text, "array<string>")), _none())).otherwise(_none())
    return F.struct(found.alias("found"), (~ok & (text != "") & (F.lower(text) != "nan")).alias("failed"))


def _tag_list(value: Column) -> Column:
    """A list from a JSON list, a JSON string or values between commas."""

    def listed(text: Column) -> Column:
        plain = F.when(text.rlike(r'^"[^"\\]*"$'), F.array(F.regexp_replace(text, '"', ""))).otherwise(F.split(text, ","))
        return F.array_distinct(_trimmed(F.when(_is_list(text), F.from_json(text, "array<string>")).otherwise(plain)))

    return once(F.trim(F.coalesce(value, F.lit(""))), listed)


def sanitize_tags(answer: Column) -> Column:
    """struct<body_shapes, seasons, colors, note> from a model's JSON, in a code fence or not; values outside their domain are dropped.

    Each field has other names, tried if the first is missing or empty. An empty answer has no tags; malformed JSON gives null.
    """

    def field(json: Column, *names: str) -> Column:
        found = [once(F.get_json_object(json, f"$.{n}"), lambda f: F.when(~f.isin("", "[]", "{}", "0", "false"), f)) for n in names]
        return F.coalesce(*found)

    def tagged(json: Column) -> Column:
        tags = F.struct(
            split_by_domain(_tag_list(field(json, "body_shapes_fit", "body_shapes")), BODY_SHAPES)["valid"].alias("body_shapes"),
            split_by_domain(_tag_list(field(json, "season", "seasons")), SEASONS)["valid"].alias("seasons"),
            _tag_list(field(json, "colors", "color", "color_palette", "colours")).alias("colors"),
            F.trim(F.coalesce(field(json, "stylist_notes_vi", "explanation_vi"), F.lit(""))).alias("note"),
        )
        return F.when((json == "") | F.try_parse_json(json).isNotNull(), tags)

    def unfenced(text: Column) -> Column:
        fence = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
        return once(fence, lambda inside: F.when(inside != "", F.trim(inside)).otherwise(text))

    return once(once(F.trim(F.coalesce(answer, F.lit(""))), unfenced), tagged)


def fallback_note(category: Column) -> Column:
    """The note of a bag, accessory or pair of shoes that got none; null for others."""
    out = F.lit(None).cast("string")
    for c, note in FALLBACK_NOTES.items():
        out = F.when(category == c, note).otherwise(out)
    return out


def ensure_note(tags: Column, category: Column) -> Column:
    """The note, or a plain one by category where there are neither tags of shape or season nor a note."""
    silent = (F.size(tags["body_shapes"]) == 0) & (F.size(tags["seasons"]) == 0) & (F.trim(tags["note"]) == "")
    return F.when(silent, F.coalesce(fallback_note(category), F.lit(PLAIN_NOTE))).otherwise(tags["note"])


def effective_colors(tags: Column, known: Column) -> Column:
    """The answer's colors, or those already known."""
    return F.when(F.size(tags["colors"]) > 0, tags["colors"]).otherwise(F.filter(F.coalesce(known, _none()), lambda c: c != ""))


def is_complete(tags: Column, category: Column, known_colors: Column) -> Column:
    """Main garments need shapes, seasons and colors; others colors and any of the rest."""
    shapes, seasons = F.size(tags["body_shapes"]) > 0, F.size(tags["seasons"]) > 0
    main = F.coalesce(category.isin(*MAIN_CATEGORIES), F.lit(False))
    return (F.size(effective_colors(tags, known_colors)) > 0) & F.when(main, shapes & seasons).otherwise(shapes | seasons | (F.trim(tags["note"]) != ""))


def backend_error(message: Column) -> Column:
    """struct<status, limit_rpm, retry_after_s, outage, quota> of a tagging service's error text."""
    text = F.coalesce(message, F.lit(""))
    low = F.lower(text)
    quota = _has_any(low, ("429", "quota"))
    status = F.when(quota, "rate_limited").when(_has_any(low, ("api key", "permission", "unauthorized")), "auth_error").when(_has_any(low, ("not supported by provider",)), "unsupported").otherwise("error")
    number = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.struct(
        status.alias("status"),
        number(r"(?i)limit:\s*(\d+)").try_cast("bigint").alias("limit_rpm"),
        number(r"(?i)Please retry in ([0-9.]+)s").try_cast("double").alias("retry_after_s"),
        _has_any(low, OUTAGE_MARKERS).alias("outage"),
        quota.alias("quota"),
    )


def cache_key(model: Column, version: Column, *fields: Column) -> Column:
    """SHA-256 of the answer's model, the prompt's version and the fields that the prompt shows, nulls told from empty texts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("")) for c in (version, model, *fields)])), 256)


def audited(catalog: DataFrame) -> DataFrame:
    """item_id, category, store_id, title and, by field, the raw text, whether it failed, valid and invalid tags; the note, is_fallback, leak."""
    col = lambda c: F.col(f"`{c}`")
    note = F.trim(F.coalesce(col("note"), F.lit("")))
    store = F.when(F.coalesce(col("store_id"), F.lit("")) == "", "unknown").otherwise(col("store_id"))
    domains = {"body_shapes": BODY_SHAPES, "seasons": SEASONS, "colors": None}
    parsed = catalog.select("item_id", "category", store.alias("store_id"), "title", *[F.col(f).alias(f"{f}_raw") for f in domains], *[parse_tags(F.col(f)).alias(f"{f}_p") for f in domains], note.alias("note"))
    fields = []
    for f, domain in domains.items():
        found = F.col(f"{f}_p.found")
        parts = split_by_domain(found, domain) if domain else F.struct(found.alias("valid"), _none().alias("invalid"))
        fields.append(F.struct(F.col(f"{f}_raw").alias("raw"), F.col(f"{f}_p.failed").alias("failed"), parts["valid"].alias("valid"), parts["invalid"].alias("invalid")).alias(f))
    fallback = F.coalesce(F.col("note") == F.coalesce(fallback_note(F.col("category")), F.lit("")), F.lit(False))
    return parsed.select("item_id", "category", "store_id", "title", *fields, "note", fallback.alias("is_fallback"), _has_any(F.lower("note"), LEAK_MARKERS).alias("leak"))


def _findings(rows: DataFrame, keep: list[str], found: list[Column]) -> DataFrame:
    return rows.select(*keep, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(*keep, "x.*")


def invalid_tags(rows: DataFrame) -> DataFrame:
    """(item_id, field, reason, evidence) of audited rows: malformed lists, values outside their domain, empty notes and errors in notes."""
    one = lambda field, reason, evidence: F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), evidence.alias("evidence"))
    found = [F.when(F.col(f"{f}.failed"), F.array(one(f, "invalid_json_list", F.col(f"{f}.raw")))) for f in MOST_TAGS]
    outside = lambda f, reason: F.transform(f"{f}.invalid", lambda v: one(f, reason, v))
    found += [outside("body_shapes", "invalid_body_shape"), outside("seasons", "invalid_season")]
    found.append(F.when(F.col("note") == "", F.array(one("note", "empty_note", F.lit("")))).when(F.col("leak"), F.array(one("note", "backend_error_leak", F.col("note")))))
    none = F.array().cast("array<struct<field:string,reason:string,evidence:string>>")
    return rows.select("item_id", F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("x")).select("item_id", "x.*")


def outliers(rows: DataFrame) -> DataFrame:
    """(item_id, outlier_type, evidence) of audited rows: many tags and long notes."""
    one = lambda kind, evidence: F.struct(F.lit(kind).alias("outlier_type"), evidence.alias("evidence"))
    found = [F.when(F.size(f"{f}.valid") > most, one(f"many_{f}", F.array_join(f"{f}.valid", ", "))) for f, most in MOST_TAGS.items()]
    return _findings(rows, ["item_id"], [*found, F.when(F.char_length("note") > MOST_NOTE_CHARS, one("long_note", F.col("note")))])


def semantic_flags(rows: DataFrame, repeats: int = 10) -> DataFrame:
    """(item_id, category, store_id, title, rule_id, severity, evidence) of audited rows: what doesn't go together, and notes found `repeats` times or more.

    Notes are counted before they are joined back, and only those that repeat, so a frequent one costs no sort of its rows.
    """
    counts = rows.where("note <> ''").groupBy("note").agg(F.count("*").alias("n")).where(F.col("n") >= repeats)
    counts = counts.withColumnRenamed("note", "counted")
    rows = rows.join(counts, ~F.col("is_fallback") & (F.col("note") == F.col("counted")), "left")
    one = lambda rule, severity, evidence: F.struct(rule.alias("rule_id"), F.lit(severity).alias("severity"), evidence.alias("evidence"))
    category = F.coalesce("category", F.lit(""))
    shapes, seasons, title = F.col("body_shapes.valid"), F.col("seasons.valid"), F.lower(F.coalesce("title", F.lit("")))
    only = lambda s: (F.size(seasons) == 1) & (seasons[0] == s)
    main, other = category.isin(*MAIN_CATEGORIES), F.lit(False)
    for c, names in OTHER_GARMENTS.items():
        for name in names:
            other = other | ((category == c) & F.startswith(F.lower("note"), F.lit(f"{name} ")))
    return _findings(rows, ["item_id", "category", "store_id", "title"], [
        F.when(category.isin(*OTHER_GARMENTS) & (F.size(shapes) > 0), one(F.concat(category, F.lit("_has_body_shape")), "medium", F.array_join(shapes, ", "))),
        F.when(main & (F.size(shapes) == 0), one(F.lit("main_garment_missing_body_shape"), "medium", F.lit("body_shapes_fit=[]"))),
        F.when(main & (F.size("colors.valid") == 0), one(F.lit("main_garment_missing_color"), "medium", F.lit("colors=[]"))),
        F.when(_has_any(title, WINTER_WORDS) & only("summer"), one(F.lit("winter_outerwear_summer_only"), "high", F.lit("['summer']"))),
        F.when(_has_any(title, SUMMER_WORDS) & only("winter"), one(F.lit("summer_item_winter_only"), "high", F.lit("['winter']"))),
        F.when(F.col("is_fallback"), one(F.lit("fallback_note_review"), "low", F.col("note"))),
        F.when(F.col("n").isNotNull(), one(F.lit("repeated_generic_note"), "medium", F.concat(F.lit("repeat_count="), F.col("n").cast("string")))),
        F.when(other, one(F.lit("note_category_mismatch"), "high", F.col("note"))),
    ])


def review_sample(rows: DataFrame, flags: DataFrame, per_category: int = 5, seed: str = "42") -> DataFrame:
    """(item_id, category, store_id, title, flags): every item with a flag of high severity or a fallback note, and of the others per_category of each category, in the order of a hash; one row an item."""
    by = flags.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), "; ").alias("flags"), F.bool_or((F.col("severity") == "high") | (F.col("rule_id") == "fallback_note_review")).alias("sure"))
    items = rows.groupBy("item_id").agg(F.min(F.struct("category", "store_id", "title")).alias("x")).select("item_id", "x.*")
    items = items.join(by, "item_id", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
    order = W.partitionBy("category").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "item_id"), 256), "item_id")
    # Spark keeps the first rows of a window before it shuffles, so a large category meets in no task
    drawn = items.where("not sure").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_category).drop("place")
    return items.where("sure").unionByName(drawn).select("item_id", "category", "store_id", "title", F.coalesce("flags", F.lit("")).alias("flags"))
