"""Scores of a model's answers: named formality bands, verdicts on coherence, asking back, derived tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.vocab import FORMALITIES
from weftline.operators.dialogue import _first_call, call_f1, call_texts, text_call_errors

#: Labels and other names of the formality bands, cues of verdicts and of asking back.
FORMALITY_LABELS = {"athletic": "thể thao", "casual": "thường ngày", "smart_casual": "lịch sự nhẹ", "formal": "trang trọng"}
FORMALITY_NAMES = {
    "smart_casual": ("business casual", "business-casual", "smart casual", "smart-casual"),
    "formal": ("semi-formal", "semi formal", "semi_formal", "semiformal", "semi-black-tie", "semi black tie", "black-tie", "black tie", "veston"),
    "athletic": ("sportswear", "sport wear", "sport-wear", "active wear", "activewear"),
}
INCOHERENT = ("không phù hợp", "không hợp", "lệch", "kém", "mâu thuẫn", "không nên")
COHERENT = ("phù hợp", "hài hòa", "hài hoàn", "gọn gàng", "tốt", "đẹp", "hợp lý")
ASK_BACK = r"\?|bạn muốn|cho mình hỏi|dịp nào|muốn mặc|phù hợp với|dịp gì"


def named_values(text: Column, values: tuple[str, ...], labels: dict[str, str], names: dict[str, tuple[str, ...]] | None = None) -> Column:
    """array<string>: the values that a text names, as a whole word or by their label; other names are replaced first, the longest first."""
    low = F.lower(text)
    for name, value in sorted(((n, v) for v, ns in (names or {}).items() for n in ns), key=lambda x: -len(x[0])):
        low = F.replace(low, F.lit(name), F.lit(value))

    def is_named(value: str) -> Column:
        word = low.rlike(rf"(?U)\b{value}\b")
        return word | F.contains(low, F.lit(labels[value].lower())) if value in labels else word

    return F.filter(F.array(*[F.when(is_named(v), F.lit(v)) for v in values]), lambda v: v.isNotNull())


def formality_answer(text: Column, appropriate: Column) -> Column:
    """struct<precision, recall, f1, wrong> of the bands that an answer names against the appropriate ones."""
    named = named_values(text, FORMALITIES, FORMALITY_LABELS, FORMALITY_NAMES)
    right = F.size(F.array_intersect(named, appropriate))
    precision, recall = (right / F.greatest(F.size(x), F.lit(1)) for x in (named, appropriate))
    f1 = F.when(right > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return F.struct(F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"), F.bround(f1, 4).alias("f1"), F.array_sort(F.array_except(named, appropriate)).alias("wrong"))


def verdict(text: Column) -> Column:
    """coherent, incoherent or undetermined; cues against come first, as they hold cues for."""
    low = F.lower(text)
    return F.when(low.rlike("|".join(INCOHERENT)), "incoherent").when(low.rlike("|".join(COHERENT)), "coherent").otherwise("undetermined")


def coherence_score(text: Column, is_coherent: Column) -> Column:
    return F.when(verdict(text) == F.when(is_coherent, "coherent").otherwise("incoherent"), 1.0).otherwise(0.0)


def ask_back(text: Column) -> Column:
    """struct<asked_back, invented, score>: an answer to a request without an occasion must ask back and not call with an occasion of its own."""
    asked = text.rlike(f"(?iU){ASK_BACK}")
    invented = F.exists(call_texts(text), lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$.arguments.occasion", "string"), F.lit("")) != "")
    return F.struct(asked.alias("asked_back"), invented.alias("invented"), F.when(asked & ~invented, 1.0).otherwise(0.0).alias("score"))


def derivation_score(text: Column, reference: Column) -> Column:
    """F1 of the call of an answer against a reference, 0 unless all of its calls are valid."""
    valid = _first_call(text).isNotNull() & (F.size(text_call_errors(text)) == 0)
    return F.bround(F.when(valid, F.coalesce(call_f1(text, reference), F.lit(0.0))).otherwise(0.0), 4)


def reward(kind: Column, scores: dict[str, Column]) -> Column:
    """The score of the answer's kind, between 0 and 1; 0 for an unknown kind."""
    out = F.lit(0.0)
    for k, s in scores.items():
        out = F.when(kind == k, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(s, F.lit(0.0))))).otherwise(out)
    return out
