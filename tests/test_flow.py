"""The recommendation flow: several passes of a search, tastes, sizes, requests without anything to find."""

import random

from pyspark.sql import functions as F

from weftline.operators import recommend
from weftline.operators.tags import formalities_for

RECORD = "outfit_id string, item_ids array<string>, styles array<string>, occasions array<string>, colors array<string>, price_tier string, price_total bigint, score double, formality string, seed_gender string"
ASKED = "request_id int, occasion string, gender string, price_max bigint, exclude_colors array<string>, style string"
BANDS = {"athletic": 0, "casual": 1, "smart_casual": 2, "formal": 3}


def test_passes_give_what_one_search_gives(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        rows.append((f"OF_{k}", [f"i{k:03d}"], [rng.choice(["casual", "sporty"])], ["date"], [rng.choice(["Red", "blue", "tan"])], rng.choice(["budget", "mid"]), rng.randrange(20) * 100, rng.choice([0.5, 0.6, 0.7]), rng.choice(list(BANDS)), rng.choice(["men", "women", "unisex"])))
    asked = [(1, "office", None, None, None, None), (2, "wedding", "women", 300, ["red"], None), (3, "travel", "men", None, None, "sporty"), (4, "school", None, -1, None, None), (5, "nowhere", None, None, None, None)]
    records, requests = spark.createDataFrame(rows, RECORD), spark.createDataFrame(asked, ASKED)
    bands = {r["request_id"]: r["f"] for r in requests.select("request_id", formalities_for(F.col("occasion")).alias("f")).collect()}
    want = {}
    for i, _, gender, most, without, style in asked:
        fits = [r for r in rows if r[8] in bands[i] and (gender is None or r[9] in (gender, "unisex")) and (most is None or r[6] <= most) and not (without and {c.lower() for c in r[4]} & set(without)) and (style is None or style in r[2])]
        for n, r in enumerate(sorted(fits, key=lambda r: (r[7], r[1]), reverse=True)[:7]):
            want[i, n + 1] = r[0]
    for first in (1, 3, 1000):
        got = {(r["request_id"], r["retrieval_rank"]): r["outfit_id"] for r in recommend.search_classes(records, requests, 7, first).collect()}
        assert got == want


def test_requests_of_one_rule_are_searched_once(spark):
    rows = [(f"OF_{k}", [f"i{k:02d}"], ["casual"], ["date"], ["Red"], "mid", 100 * k, 0.5, "formal", "women") for k in range(30)]
    asked = [(k, "wedding", None, 1500 if k % 2 else None, None, None) for k in range(60)]
    records, requests = spark.createDataFrame(rows, RECORD), spark.createDataFrame(asked, ASKED)
    _, hits, _ = recommend.search_rules(records, requests, 5, 2)
    assert hits.count() == 10 and hits.select("_rule").distinct().count() == 2
    got = recommend.search_classes(records, requests, 5, 2).collect()
    assert {(r["request_id"], r["retrieval_rank"], r["outfit_id"]) for r in got} == {(k, n, f"OF_{(16 if k % 2 else 30) - n}") for k in range(60) for n in range(1, 6)} and len(got) == 300


ITEM = "item_id string, category string, gender string, formality string, colors array<string>, price bigint, url string, styles array<string>, body_shapes array<string>, seasons array<string>, in_stock boolean, sizes_in_stock array<string>, available_sizes array<string>"
ASK = ASKED + ", quiz struct<styles:array<string>,occasions:array<string>,colors:array<string>,tier:string>, height int, weight int"


def catalog(spark, **changed):
    def item(i, category, color="red"):
        return (i, category, "unisex", "formal", [color], 200_000, "u", [], [], [], changed.get("in_stock", True), [], ["S", "M", "L"])

    items = spark.createDataFrame([item("t", "top", "Đỏ"), item("b", "bottom"), item("s", "shoes"), item("d", "dress")], ITEM)
    edges = spark.createDataFrame([("b", "t", "bottom", "top", 0.9), ("s", "t", "shoes", "top", 0.8), ("b", "s", "bottom", "shoes", 0.7)], "src_id string, dst_id string, src_category string, dst_category string, weight double")
    return items, edges


def ask(spark, *rows):
    return spark.createDataFrame(rows, ASK)


def test_flow(spark):
    items, edges = catalog(spark)
    plain = (1, "office", None, None, None, None, None, 165, 60)
    got = recommend.recommend(ask(spark, plain, (2, "office", None, None, ["đỏ"], None, None, None, None), (3, "office", None, 500_000, None, None, (None, None, None, "mid"), 165, 60)), items, edges).collect()
    by = {(r["request_id"], r["place"]): r for r in got}
    first = by[1, 1]
    assert first["item_ids"] == ["t", "b", "s"] and abs(first["score"] - 0.8) < 1e-9 and first["preference"] is None and [s["item_id"] for s in first["sizes"]] == ["t"]
    assert by[1, 2]["item_ids"] == ["d"] and by[1, 2]["sizes"] is None and by[1, 2]["score"] == 0.0
    assert by[2, 1]["item_ids"] == ["d"] and by[2, 1]["sizes"] == []  # without height and weight no size
    assert by[3, 1]["item_ids"] == ["d"] and abs(by[3, 1]["preference"] + 0.1) < 1e-9 and len(by) == 4
    none, _ = catalog(spark, in_stock=False)
    assert recommend.recommend(ask(spark, plain), none, edges).count() == 0


def test_requests_that_say_the_same_are_answered_once(spark, monkeypatch):
    """Answers follow what is asked, not how many ask; each request gets what it would get alone."""
    items, edges = catalog(spark)
    kinds = [(None, None, None, None, None, 165, 60), ("women", None, ["đỏ"], None, None, None, None), (None, 500_000, None, None, ([], None, ["đ"], "mid"), 165, 60)]
    asked = ask(spark, *[(k, "office", *kinds[k % 3]) for k in range(30)])
    alone = {(r["request_id"] % 3, r["place"]): r.asDict(True) | {"request_id": 0} for r in recommend.recommend(asked.where("request_id < 3"), items, edges).collect()}
    seen, answers = [], recommend.answers
    monkeypatch.setattr(recommend, "answers", lambda requests, *a: seen.append(requests.count()) or answers(requests, *a))
    got = recommend.recommend(asked, items, edges).collect()
    assert seen == [3] and {(r["request_id"] % 3, r["place"]) for r in got} == set(alone) and len(got) == 10 * len(alone)
    assert all(r.asDict(True) | {"request_id": 0} == alone[r["request_id"] % 3, r["place"]] for r in got)
