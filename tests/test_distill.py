"""Distilled and synthetic examples."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.operators import distill
from weftline.plans.distilling import SUFFIXES, TEMPLATES

SCHEMA = "key int, prompt string, answer string"
BLAZERS = [
    ("Làm thế nào để chọn một chiếc áo blazer bất hủ cho công sở?", "Hãy ưu tiên vai gọn, màu trung tính và chất liệu đứng form."),
    ("Làm thế nào để chọn một chiếc áo blazer bất hủ cho cuối tuần?", "Hãy ưu tiên blazer mềm, dễ phối cùng quần jeans hoặc chân váy."),
    ("Làm thế nào để chọn một chiếc áo blazer bất hủ cho mùa thu?", "Hãy chọn blazer dệt chặt, có thể mặc nhiều lớp nhưng không quá dày."),
    ("Làm sao xác định tông da để chọn màu quần áo phù hợp?", "Quan sát undertone và thử các nhóm màu ấm, lạnh, trung tính."),
    ("Cách giặt áo lụa để giữ bề mặt mịn và bền lâu?", "Giặt tay nhẹ bằng nước mát, tránh vắt mạnh và phơi râm."),
    ("Tôi nên mặc gì khi đi đám cưới ngoài trời buổi chiều?", "Ưu tiên trang phục thanh lịch, chất liệu thoáng và giày đi êm chân."),
]


def test_families_are_capped_and_topics_stay(spark):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(BLAZERS)], SCHEMA)
    got = distill.select_distilled(df, 4, max_per_family=1).collect()
    assert len(got) == 4 and sum("blazer bất hủ" in r["prompt"] for r in got) == 1 and {3, 4, 5} <= {r["key"] for r in got}
    assert distill.select_distilled(df, 5).count() == 5  # two of the family stay
    assert distill.select_distilled(df, 6, max_per_family=1).count() == 6  # as many as asked for: nothing is capped
    assert distill.select_distilled(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        distill.select_distilled(df, 0)


def test_interleaving_equals_round_robin(spark):
    words = ["giày", "màu", "vải", "giặt", "vai"]
    rows = [(i, f"{('Cách', 'Tôi', 'Gì')[i % 3]} {words[(i * i) % 5]} riêng{i} số{i}", " ".join(f"từ{i}x{j}" for j in range((10, 90, 200)[(i // 7) % 3]))) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = distill.select_distilled(df, 50, max_per_family=1)
    every = distill.select_distilled(df, 119, max_per_family=1).unionByName(distill.select_distilled(df, 120, max_per_family=1)).dropDuplicates(["key"]).withColumn("sig", distill.signature(F.col("prompt"), F.col("answer"))).collect()
    assert len(every) == 120
    strata = defaultdict(list)
    for r in sorted(every, key=lambda r: (-r["score"], r["sig"])):
        strata[r["topic"], r["style"], r["length_class"]].append(r["key"])
    order = sorted(strata, key=lambda k: (len(strata[k]), k))
    counts = defaultdict(int)
    for k in order:
        counts[k[0]] += len(strata[k])
    left = distill.topic_targets(counts, 50)
    assert sum(left.values()) == 50
    want = set()
    while any(left.values()):
        for k in order:
            if left[k[0]] > 0 and strata[k]:
                want.add(strata[k].pop(0))
                left[k[0]] -= 1
    assert {r["key"] for r in got.collect()} == want


def test_water_filling():
    assert distill.topic_targets({"a": 100, "b": 4, "c": 1}, 30) == {"a": 25, "b": 4, "c": 1}
    assert distill.topic_targets({"a": 9, "b": 9}, 5) == {"a": 2, "b": 3}
    assert distill.topic_targets({"a": 2, "b": 0}, 5) == {"a": 2, "b": 0} and distill.topic_targets({}, 3) == {}


def test_synthetic_examples_never_repeat(spark):
    df = spark.createDataFrame([(0, *BLAZERS[3]), (1, "x", "")], SCHEMA)
    made = distill.synthesize(df, TEMPLATES, {"multi_turn": 40, "polite_decline": 100, "tool_calling": 3}, SUFFIXES, no_hint="Plain things.").collect()
    assert len(made) == 143 and len({str(r["messages"]) for r in made}) == 143
    assert [m["role"] for m in next(r for r in made if r["task_type"] == "multi_turn")["messages"]] == ["user", "assistant", "user", "assistant"]
    call = next(r for r in made if r["task_type"] == "tool_calling")["messages"][-1]["content"]
    assert json.loads(call.removeprefix("<tool_call>").removesuffix("</tool_call>"))["arguments"]["occasion"]
    with pytest.raises(ValueError, match="no template"):
        distill.synthesize(df, TEMPLATES, {"other": 1}, SUFFIXES)
    with pytest.raises(ValueError, match="empty"):
        distill.synthesize(df.limit(0), TEMPLATES, {"multi_turn": 1}, SUFFIXES)


def test_suffixes_that_collide(spark):
    """A text that is already what another would become."""
    texts = ["a", "a", f"a {SUFFIXES[1]}", "a", f"a {SUFFIXES[2]}"]
    df = spark.createDataFrame([(i, [("assistant", t)]) for i, t in enumerate(texts)], "cursor int, messages array<struct<role:string,content:string>>")
    got = {r["cursor"]: r["messages"][0]["content"] for r in distill.unique_messages(df, SUFFIXES).collect()}
    assert len(set(got.values())) == 5 and got[0] == "a" and got[2] == texts[2] and got[4] == texts[4]


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(BLAZERS)], SCHEMA)
    got = {(r["part"], r["name"]): r["value"] for r in distill.bundle(df, str(tmp_path), 4, TEMPLATES, {"edge_case": 2}, SUFFIXES, "Be kind.", 1).collect()}
    assert got["size", "raw"] == 6 and got["size", "stylist_knowledge"] == 4 and got["size", "behavioral_synthetic"] == 2 and got["flag", "clean"] == 6
    train = spark.read.json(f"{tmp_path}/train.jsonl").collect()
    assert len(train) == 6 and all(r["messages"][0]["content"] == "Be kind." for r in train)
    assert spark.read.json(f"{tmp_path}/knowledge.jsonl").count() == 4
