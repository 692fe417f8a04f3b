"""Tool calls inside texts, guards against invented ids and sizes, dialogue judging, and classes and scores of training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.expressions import once, set_overlap, tokens
from weftline.functions.vocab import BODY_SHAPES, OCCASIONS, SKIN_TONES, STYLES

#: The call's frame, its arguments and their domains.
TOOL_NAME = "search_outfits"
CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
ENUMS = {"occasion": OCCASIONS, "style": STYLES, "body_shape": BODY_SHAPES, "skin_tone": SKIN_TONES}
ARGUMENTS = (*ENUMS, "price_max", "exclude_colors")
TOOL_TASKS = ("tool_calling_grounded", "multi_turn_grounded")
TALK_TASKS = ("ask_missing_info_grounded", "no_result_or_relax_constraints", "recommend_explain_grounded", "polite_decline_anti_hallucination", "body_fit_grounded")
#: Topics in the order in which they are tried, words that don't count, scripts that shouldn't occur.
TOPICS = (
    ("wardrobe_capsule", "tủ quần áo|capsule"),
    ("color_analysis", "màu|tông da|undertone|tông màu"),
    ("fabric_material", r"vải|len|cotton|linen|lụa|cashmere|da\b"),
    ("occasion_styling", "dự tiệc|công sở|đám cưới|cuối tuần|sự kiện|văn phòng|phỏng vấn"),
    ("body_fit", "vừa vặn|dáng|vai|eo|ống quần|chiều dài"),
    ("care_maintenance", "giặt|bảo quản|chăm sóc|phơi|ủi"),
    ("layering_season", "mùa đông|mùa hè|mùa xuân|mùa thu|nhiều lớp"),
    ("shoes_accessories", "giày|túi|thắt lưng|mũ|khăn|trang sức|loafer|boot"),
)
STOP_WORDS = ("và", "là", "của", "cho", "có", "một", "những", "các", "được", "trong", "với", "khi", "để", "như", "từ", "về", "hoặc", "tôi", "bạn", "thế", "nào", "gì", "sao", "vì", "ở", "trên", "dưới", "hơn", "rất", "thì", "mà", "vẫn", "đã", "đang", "sẽ", "này", "đó", "việc", "điều", "chiếc", "cái", "làm")
SCRIPTS = {"cjk": "[\\u3400-\\u9fff\\uf900-\\ufaff]", "cyrillic": "[\\u0400-\\u04FF]", "arabic": "[\\u0600-\\u06FF]", "devanagari": "[\\u0900-\\u097F]", "weird_char": "[“”‘’•\\uFFFD]"}
_MAP = "map<string,variant>"


def call_texts(text: Column) -> Column:
    """array<string>: the JSON of all tool calls of a text, in order."""
    return F.regexp_extract_all(text, F.lit(CALL), F.lit(1))


def _object(json: Column) -> Column:
    """map<string, variant> of a JSON object; null for anything else."""
    return F.try_parse_json(json).try_cast(_MAP)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def call_errors(json: Column) -> Column:
    """array<string>: what is wrong with one call's JSON, in a fixed order; empty for a valid call."""
    return once(F.try_parse_json(json), lambda parsed: F.when(parsed.isNull(), F.array(F.lit("invalid JSON"))).otherwise(once(parsed.try_cast(_MAP), _object_errors)))


def _object_errors(top: Column) -> Column:
    payload = F.array(F.lit("payload must be an object"))
    return F.when(top.isNull(), payload).otherwise(once(F.element_at(top, "arguments").try_cast(_MAP), lambda args: _field_errors(top, args)))


def _field_errors(top: Column, args: Column) -> Column:
    """What is wrong with the fields of a call that is an object, given its arguments, null if they are none."""
    name = F.try_variant_get(F.element_at(top, "name"), "$", "string")
    name_ok = F.coalesce((_kind(F.element_at(top, "name")) == "STRING") & (name == TOOL_NAME), F.lit(False))

    def listed(prefix: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(values, ", ")))

    def text(value: Column) -> Column:
        return F.try_variant_get(value, "$", "string")

    errors = [
        listed("unsupported top-level keys: ", F.array_sort(F.array_except(F.map_keys(top), F.array(F.lit("name"), F.lit("arguments"))))),
        F.when(~name_ok, "tool name must be search_outfits"),
        F.when(args.isNull(), "arguments must be an object"),
        F.when(args.isNotNull(), listed("unsupported arguments: ", F.array_sort(F.array_except(F.map_keys(args), F.array(*map(F.lit, ARGUMENTS)))))),
        F.when(args.isNotNull() & ~F.map_contains_key(args, "occasion"), "missing required arguments: occasion"),
    ]
    for key, allowed in ENUMS.items():
        value = F.element_at(args, key)
        wrong = F.when(_kind(value) != "STRING", f"{key} must be a string").when(~text(value).isin(*allowed), f"{key} must be one of: {', '.join(sorted(allowed))}")
        errors.append(F.when(F.map_contains_key(args, key), wrong))
    price = F.element_at(args, "price_max")
    errors.append(F.when(F.map_contains_key(args, "price_max"), F.when(~_kind(price).rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))$"), "price_max must be an integer").when(F.try_variant_get(price, "$", "decimal(38,0)") < 0, "price_max must be >= 0")))
    colors = F.element_at(args, "exclude_colors")
    strings = (_kind(colors) == "ARRAY<STRING>") | (F.to_json(colors) == "[]")
    whole = ~F.exists(F.coalesce(F.try_variant_get(colors, "$", "array<string>"), F.array(F.lit(None).cast("string"))), lambda x: x.isNull())
    errors.append(F.when(F.map_contains_key(args, "exclude_colors") & ~(strings & whole), "exclude_colors must be an array of strings"))
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def text_call_errors(text: Column) -> Column:
    """array<string>: the errors of all calls of a text, each with the call's number."""
    return F.flatten(F.transform(call_texts(text), lambda c, i: F.transform(call_errors(c), lambda e: F.concat(F.lit("tool_call["), i.cast("string"), F.lit("] "), e))))


def render_call(arguments: Column) -> Column:
    """The canonical text of a call from a struct of arguments; null ones are left out."""
    return F.concat(F.lit("<tool_call>"), F.to_json(F.struct(F.lit(TOOL_NAME).alias("name"), arguments.alias("arguments"))), F.lit("</tool_call>"))


def outfit_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\b(OF_[0-9A-Za-z]{5,})\b"), F.lit(1))


def size_mentions(text: Column) -> Column:
    """Sizes that a text names as "size X" or "cỡ X", in capitals."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)\b(?:size|cỡ)\s+([A-Za-z]{1,3}|[0-9]{1,3})\b"), F.lit(1)), lambda s: F.upper(s))


def unknown(found: Column, known: Column) -> Column:
    """The found ids or sizes that are not known, repeats kept."""
    return F.filter(found, lambda x: ~F.array_contains(known, x))


def text_similarity(a: Column, b: Column) -> Column:
    """F1 of the tokens that two texts share, counted with repeats: for short texts, as it takes time with the square of their words (evaluate.text_similarities does not)."""

    def counted(t: Column) -> Column:
        return F.transform(t, lambda x, i: F.struct(x.alias("t"), F.size(F.filter(F.slice(t, 1, i + 1), lambda y: y == x)).alias("k")))

    x, y = tokens(a), tokens(b)
    shared = F.size(F.array_intersect(counted(x), counted(y)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (shared == 0), 0.0).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def _value_text(value: Column) -> Column:
    """A value as text: 5 and "5" are the same."""
    kind = _kind(value)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "BOOLEAN", F.initcap(F.to_json(value))).when(kind == "VOID", "None").otherwise(F.to_json(value))


def _pairs(json: Column) -> Column:
    """array<string>: key=value of a call, its arguments as keys of their own."""

    def fields(top: Column, args: Column) -> Column:
        entries = F.transform(F.filter(F.map_entries(top), lambda e: (e["key"] != "arguments") | args.isNull()), lambda e: F.concat(e["key"], F.lit("="), _value_text(e["value"])))
        return F.array_distinct(F.concat(entries, F.coalesce(F.transform(F.map_entries(args), lambda e: F.concat(F.lit("arguments."), e["key"], F.lit("="), _value_text(e["value"]))), F.array().cast("array<string>"))))

    return once(_object(json), lambda top: once(F.element_at(top, "arguments").try_cast(_MAP), lambda args: fields(top, args)))


def _first_call(text: Column) -> Column:
    return F.get(F.filter(call_texts(text), lambda c: _object(c).isNotNull()), F.lit(0))


def call_f1(generated: Column, reference: Column) -> Column:
    """F1 of the fields of the first calls of two texts; null if the reference has none, 0 if the generated text has none."""

    def compared(a: Column, b: Column) -> Column:
        return once(F.size(F.array_intersect(a, b)), lambda shared: F.when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(a) + F.size(b))))

    def met(want: Column, got: Column) -> Column:
        both = once(_pairs(want), lambda a: once(_pairs(got), lambda b: compared(a, b)))
        return F.when(want.isNotNull(), F.when(got.isNull(), 0.0).otherwise(both))

    return once(_first_call(reference), lambda want: once(_first_call(generated), lambda got: met(want, got)))


def format_ok(generated: Column, reference: Column) -> Column:
    """1 if the reference has no call, or the generated text has one and all of its calls are valid."""
    tag = F.lit("<tool_call>")
    good = F.contains(generated, tag) & _first_call(generated).isNotNull() & (F.size(text_call_errors(generated)) == 0)
    return F.when(~F.contains(reference, tag) | good, 1).otherwise(0)


def judge(messages: Column, task: Column) -> Column:
    """array<string>: reasons to reject a dialogue (array<struct<role, content>>); empty if it is accepted."""
    said = F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit("")))
    calls = F.filter(said, lambda c: F.contains(c, F.lit("<tool_call>")))
    has_call = F.size(calls) > 0
    roles = F.array_join(F.transform(messages, lambda m: m["role"]), ",")
    details = F.flatten(F.transform(calls, lambda c: F.when(F.size(text_call_errors(c)) > 0, F.concat(F.array(F.lit("invalid_tool_call")), F.transform(text_call_errors(c), lambda e: F.concat(F.lit("invalid_tool_call_detail:"), e)))).otherwise(F.array().cast("array<string>"))))
    first = F.array(
        F.when(F.exists(said, lambda c: F.trim(c) == ""), "assistant_empty"),
        F.when(task.isin(*TOOL_TASKS) & ~has_call, "missing_required_tool_call"),
        F.when(task.isin(*TALK_TASKS) & has_call, "unexpected_tool_call"),
    )
    last = F.array(F.when((task == "multi_turn_grounded") & (roles != "system,user,assistant,user,assistant"), "invalid_multi_turn_shape"))
    reasons = F.filter(F.concat(first, details, last), lambda r: r.isNotNull())
    return F.when(messages.isNull() | (F.size(messages) < 3), F.array(F.lit("invalid_message_shape"))).when(F.size(said) == 0, F.array(F.lit("missing_assistant_message"))).otherwise(reasons)


def rejection_counts(judged: DataFrame, reasons: str = "reasons") -> DataFrame:
    """(reason, n): rejected rows by reason; details of calls are not counted, and a row's invalid calls once."""
    plain = F.filter(reasons, lambda r: ~r.startswith("invalid_tool"))
    once = F.when(F.exists(reasons, lambda r: r.startswith("invalid_tool_call")), F.array(F.lit("invalid_tool_call"))).otherwise(F.array().cast("array<string>"))
    return judged.select(F.explode(F.concat(plain, once)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def content_tokens(text: Column) -> Column:
    """Lower-case words of three letters or more that are no stop words."""
    return F.filter(tokens(text), lambda t: (F.char_length(t) >= 3) & ~t.isin(*STOP_WORDS))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(clean_text(text), " "), lambda w: w != ""))


def first_sentence(text: Column, most: int = 500) -> Column:
    first = F.get(F.split(clean_text(text), r"(?<=[.!?])\s+"), F.lit(0))
    return F.when(F.char_length(first) > most, F.concat(F.rtrim(F.substring(first, 1, most - 1)), F.lit("…"))).otherwise(first)


def script_flags(text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), name) for name, p in sorted(SCRIPTS.items())]), lambda f: f.isNotNull())


def topic(prompt: Column, answer: Column) -> Column:
    text, out = F.concat_ws(" ", prompt, answer), F.lit("general_styling")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(f"(?iU){pattern}"), name).otherwise(out)
    return out


def prompt_style(prompt: Column) -> Column:
    low = F.lower(prompt)
    starts = lambda *words: low.rlike("^(" + "|".join(words) + ")")
    return F.when(starts("làm thế nào", "cách"), "how_to").when(starts("tôi"), "first_person").when(starts("bạn có thể", "có thể"), "request").when(starts("điều gì", "gì", "những"), "definition").otherwise("other")


def answer_length(answer: Column) -> Column:
    n = word_count(answer)
    return F.when(n <= 80, "short").when(n <= 180, "medium").otherwise("long")


def family_key(prompt: Column) -> Column:
    """The first three content words of a prompt, else the prompt."""
    words = content_tokens(prompt)
    return F.when(F.size(words) == 0, F.lower(prompt)).otherwise(F.array_join(F.slice(words, 1, 3), " "))


def example_quality(prompt: Column, answer: Column, max_words: int = 280, echo: float = 0.65) -> Column:
    """struct<output_words, prompt_words, echo_overlap, lexical_diversity, flags>."""
    words = content_tokens(answer)
    overlap = set_overlap(F.array_distinct(content_tokens(prompt)), F.array_distinct(content_tokens(first_sentence(answer))))
    n = word_count(answer)
    flags = F.array(F.when(F.size(script_flags(F.concat_ws(" ", prompt, answer))) > 0, "mixed_script"), F.when(n > max_words, "too_long"), F.when(overlap >= echo, "question_echo"))
    diversity = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    return F.struct(n.alias("output_words"), word_count(prompt).alias("prompt_words"), overlap.alias("echo_overlap"), diversity.alias("lexical_diversity"), F.filter(flags, lambda f: f.isNotNull()).alias("flags"))


def quality_scores(examples: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, score) of examples (key, prompt, answer): better ones are higher; common prompt words lower it by their mean document frequency."""
    q = example_quality(F.col("prompt"), F.col("answer"))
    rows = examples.select(F.col(key).alias("key"), F.array_distinct(content_tokens(F.col("prompt"))).alias("words"), q.alias("q"))
    each = rows.select("key", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("df"))
    size = counts.agg(F.count("*").alias("vocabulary"))
    mean = each.join(counts, "word").groupBy("key").agg(F.avg("df").alias("mean_df"))
    both = rows.join(mean, "key", "left").crossJoin(F.broadcast(size))  # one row
    q = F.col("q")
    # fixed values: the weights of the score
    score = F.when(F.size(q["flags"]) == 0, 4.0).otherwise(0.0) + F.least(q["lexical_diversity"], F.lit(1.0)) * 2.0
    score = score + F.when(q["output_words"].between(45, 190), 1.5).otherwise(0.0) - F.greatest(F.lit(0), q["output_words"] - 220) / 60.0 - q["echo_overlap"] * 2.0
    score = score - F.coalesce(F.col("mean_df") / F.greatest(F.col("vocabulary"), F.lit(1)) * 2.0, F.lit(0.0))
    return both.select(F.col("key").alias(key), score.alias("score"))
