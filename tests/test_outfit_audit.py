"""Audits of outfit tags on outfits of every kind."""

from weftline.operators import outfit_audit

ITEM = "struct<item_id:string,category:string,gender:string,formality:string,body_shapes:array<string>,seasons:array<string>>"
OUTFIT = f"outfit_id string, schema_version string, items array<{ITEM}>, score double, occasions array<string>, styles array<string>, body_shapes array<string>, seasons array<string>, gender string, price_tier string"


def part(category, gender="women", formality="formal", shapes=("pear",), seasons=("summer",)):
    return (category, category, gender, formality, list(shapes), list(seasons))


def test_audit(spark):
    good = [part("top"), part("bottom"), part("shoes")]
    rows = [
        ("good", "3.1", good, 0.5, ["office"], ["elegant"], ["pear"], ["summer"], "women", "mid"),
        ("mixed", "3.1", [part("dress", "men"), part("shoes", "women", "casual")], 0.5, ["school"], None, ["apple"], ["winter"], "men", "mid"),
        ("odd", "2", [part("hat"), part("top", formality=None, shapes=())], None, [], ["x"], ["pear"], [], None, None),
        ("empty", "3.1", [], 0.1, None, None, None, None, "unisex", "budget"),
        ("bare", "3.1", [part("dress", "unisex")] * 7, 0.1, ["office"], [], ["pear"], ["summer"], "unisex", "budget"),
    ]
    n = outfit_audit.normalized(spark.createDataFrame(rows, OUTFIT))
    flags = outfit_audit.semantic_flags(n)
    found = {}
    for r in flags.collect():
        found.setdefault(r["outfit_id"], {})[r["rule_id"]] = r["evidence"]
    assert "good" not in found and found["bare"] == {"missing_recommended_shoes": '["' + '","'.join(["dress"] * 7) + '"]'}
    assert found["mixed"] == {"mixed_gender_items": "men, women", "outfit_gender_mismatch": "outfit=men expected=unisex", "occasion_formality_mismatch": '["school"]', "body_shape_not_in_main_garments": '["apple"]', "season_not_in_main_garments": '["winter"]'}
    assert found["odd"].keys() == {"outfit_gender_mismatch", "body_shape_not_in_main_garments", "invalid_item_combo"} and found["empty"] == {"invalid_item_combo": "[]"}
    invalid = {(r["outfit_id"], r["reason"]) for r in outfit_audit.invalid_values(n).collect()}
    assert invalid == {("odd", r) for r in ("invalid_schema_version", "missing_core_categories", "invalid_gender", "invalid_price_tier", "invalid_style")} | {("empty", "missing_core_categories")}
    assert [(r["outfit_id"], r["outlier_type"]) for r in outfit_audit.outliers(n).collect()] == [("bare", "too_many_items")]
    one = outfit_audit.summary(n).first()
    assert (one["total"], one["complete"], one["completion_rate"], one["flags"]) == (5, 2, 0.4, 10)
    sample = {r["outfit_id"]: r["flags"] for r in outfit_audit.review_sample(n, flags, 1).collect()}
    assert sample.keys() == {"good", "mixed", "odd", "empty", "bare"} and sample["good"] == ""
    by = {r["core_shape"]: r for r in outfit_audit.distribution(n, "core_shape").collect()}
    assert by["top+bottom+shoes"]["top_occasion"] == "office" and by["invalid"]["top_style"] is None and by["dress"]["avg_items"] == 7.0
