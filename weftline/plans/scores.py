"""Queries of the scorers of answers: what each answer should get is stated beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import scorers
from weftline.operators.tags import formalities_for
from weftline.plans.dialogue_tools import CALLS
from weftline.plans.ingest import _list
from weftline.plans.registry import query
from weftline.sources.tables import pick, table

#: Answer, occasion, and what it should get: precision, recall, f1, wrong bands, verdict, asked back, invented, reward.
ANSWERS = (
    ("Nên mặc trang trọng hoặc smart casual.", "office", 1.0, 1.0, 1.0, "", "undetermined", False, False, 1.0),
    ("Business casual không phù hợp, mặc thể thao?", "office", 0.5, 0.5, 0.5, "athletic", "incoherent", True, False, 0.5),
    ("Đẹp, formal", "office", 1.0, 0.5, 0.6667, "", "coherent", False, False, 0.6667),
    ("Bạn muốn mặc dịp nào", "party", 0.0, 0.0, 0.0, "", "undetermined", True, False, 0.0),
    ("black-tie và thường ngày", "wedding", 0.5, 1.0, 0.6667, "casual", "undetermined", False, False, 0.6667),
    (f"Dịp gì? <tool_call>{CALLS[0][0]}</tool_call>", "office", 0.0, 0.0, 0.0, "casual", "undetermined", True, True, 0.0),
)


def _at(k: int) -> str:
    values = [a[k] for a in ANSWERS]
    listed = _list(values) if isinstance(values[0], str) else "[" + ",".join(str(v).lower() if isinstance(v, bool) else f"{v}::double" for v in values) + "]"
    return f"{listed}[event_id % {len(ANSWERS)} + 1]"


@query(f"""select event_id, {_at(2)} as "precision", {_at(3)} as recall, {_at(4)} as f1, {_at(5)} as wrong, {_at(6)} as verdict, {_at(7)} as asked_back, {_at(8)} as invented, case when {_at(7)} and not {_at(8)} then 1.0::double else 0.0::double end as ask_score, case when event_id % 2 = 0 then {_at(9)} else 0.0::double end as reward from events""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % len(ANSWERS)
    rows = table(spark, sf_dir, "events").select("event_id", pick(tuple(a[0] for a in ANSWERS), k).alias("text"), pick(tuple(a[1] for a in ANSWERS), k).alias("occasion"))
    text = F.col("text")
    rows = rows.select("event_id", scorers.formality_answer(text, formalities_for(F.col("occasion"))).alias("f"), scorers.verdict(text).alias("verdict"), scorers.ask_back(text).alias("a"))
    kind = F.when(F.col("event_id") % 2 == 0, "occasion_formality").otherwise("other")
    return rows.select("event_id", "f.precision", "f.recall", "f.f1", F.array_join("f.wrong", "|").alias("wrong"), "verdict", "a.asked_back", "a.invented", F.col("a.score").alias("ask_score"), scorers.reward(kind, {"occasion_formality": F.col("f.f1")}).alias("reward"))
