"""The scenario bank: ids, pools in turn, expectations, catalogs without seeds."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import scenarios

ITEM = "item_id string, category string, formality string, price bigint, title string, colors array<string>, url string, in_stock boolean"
ROWS = [
    ("top_office_1", "top", "smart_casual", 420_000, "Áo", ["trắng", ""], "u", True), ("top_office_2", "top", "formal", None, None, None, "u", True), ("dress_travel_1", "dress", "casual", 390_000, "Đầm", [], "u", True),
    ("shoes_1", "shoes", "formal", 1, "", [], "u", True), ("top_gone", "top", "formal", 1, "", [], "u", False), ("top_no_link", "top", "formal", 1, "", [], "", True),
]


def test_bank(spark):
    items = spark.createDataFrame(ROWS, ITEM)
    got = scenarios.scenario_bank(items, {"tool_calling_grounded": 3, "no_result_or_relax_constraints": 2, "multi_turn_grounded": 1, "polite_decline_anti_hallucination": 1}).orderBy("scenario_id").collect()
    assert [r["scenario_id"] for r in got] == [f"SC_{k:06d}" for k in range(1, 8)]
    calls = [r for r in got if r["task_type"] == "tool_calling_grounded"]
    assert [r["seed_item"]["item_id"] for r in calls] == ["top_office_1", "top_office_2", "top_office_1"]
    assert [r["request"]["price_max"] for r in calls] == [420_000, 350_000, 520_000] and all(r["expected"]["should_call_tool"] and not r["expected"]["should_decline"] for r in calls)
    assert [c["item_id"] for c in calls[0]["candidates"]] == ["top_office_1", "top_office_2"] and calls[0]["seed_item"]["colors"] == ["trắng"]
    none = [r for r in got if r["task_type"] == "no_result_or_relax_constraints"]
    assert none[0]["request"]["price_max"] == 389_999 and none[0]["candidates"] == [] and none[0]["request"]["occasion"] == "travel"
    turn = next(r for r in got if r["task_type"] == "multi_turn_grounded")
    assert turn["request"]["occasion"] is None and turn["target_occasion"] == "travel"
    assert next(r for r in got if "decline" in r["task_type"])["request"]["requested_outfit_id"] == "OUTFIT_FAKE_001"
    counts = {(r["part"], r["name"]): r["n"] for r in scenarios.summarize_bank(scenarios.scenario_bank(items, {"body_fit_grounded": 4})).collect()}
    assert counts == {("task", "body_fit_grounded"): 4, ("occasion", "office"): 4, ("size", "all"): 4}


def test_bank_without_seeds(spark):
    items = spark.createDataFrame(ROWS, ITEM).where(F.col("category") == "shoes")
    assert scenarios.scenario_bank(items, {"tool_calling_grounded": 3}).count() == 0
    with pytest.raises(ValueError, match="unknown tasks: x"):
        scenarios.scenario_bank(items, {"x": 1})
