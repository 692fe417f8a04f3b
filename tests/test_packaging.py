"""Packaged chat rows."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import packaging

ROW = "pos int, messages array<struct<role:string,content:string>>, task_type string, source_set string, scenario_id string"


def chat(k, text=None, task="a", source="g", scenario=None):
    return (k, [("user", "hi"), ("assistant", text or f"text {k}")], task, source, scenario)


def test_package(spark, tmp_path):
    grounded = spark.createDataFrame([chat(k, task=["a", "b", None][k % 3]) for k in range(12)] + [chat(20, "text 1")], ROW)
    known = spark.createDataFrame([chat(0, "text 2", "k", "known"), chat(1, "other", "k", "known")], ROW)
    got = {(r["part"], r["name"]): r["n"] for r in packaging.package(grounded, known, str(tmp_path), "pos", 0.5, 3).collect()}
    assert got["size", "train"] == 10 and got["size", "eval"] == 3 and got["source", "known"] == 1 and got["task", "a"] == 4 and got["task", ""] == 4
    assert spark.read.json(f"{tmp_path}/eval.jsonl").count() == 3 and spark.read.json(f"{tmp_path}/train.jsonl").count() == 10
    with pytest.raises(ValueError, match="at least 2"):
        packaging.package(grounded.limit(1), known.limit(0), str(tmp_path / "x"), "pos")


def test_quotas():
    assert packaging.evaluation_quotas({"b": 10, "a": 1, "c": 4}, 0.3, 99) == {"a": 0, "b": 3, "c": 1}
    assert packaging.evaluation_quotas({"b": 10, "c": 40}, 0.3, 4) == {"b": 3, "c": 1}
    assert packaging.evaluation_quotas({"a": 1, "b": 1}, 0.3, 9) == {"a": 0, "b": 1} and packaging.evaluation_quotas({"a": 5}, 0.5, 0) == {"a": 0}


def test_report_and_budget(spark):
    call = '<tool_call>{"name":"search_outfits","arguments":{"occasion":"date"}}</tool_call>'
    rows = spark.createDataFrame([chat(1, call, scenario="s1"), chat(2, "<tool_call>{x}</tool_call>", scenario="s1"), chat(3, "plain"), chat(4, "plain", scenario="s2"), (5, None, "a", "g", None)], ROW)
    r = packaging.report(rows).first()
    assert (r["total_rows"], r["tool_call_rows"], r["valid_tool_rows"], r["invalid_tool_rows"], r["duplicate_scenario_ids"], r["avg_turns"], r["max_turns"]) == (5, 2, 1, 1, 2, 1.6, 2)
    prices = spark.createDataFrame([(100, [10, 49]), (100, [50]), (100, []), (None, [1]), (0, [0])], "cap int, p array<int>")
    assert [x["n"] for x in prices.select(packaging.narrow_budget(F.col("cap"), F.col("p")).alias("n")).collect()] == [True, False, False, False, False]
