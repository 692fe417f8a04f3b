"""Building outfits: choice under caps against a plain greedy search, random combinations, records."""

import random
from collections import Counter

import pytest

from weftline.operators import diverse, generation
from weftline.operators.diverse import Caps, State


def plain_choice(rows, best, rand, targets, caps):
    """The greedy search over all candidates, one pick at a time."""
    state = State(caps, best + rand)
    out = []
    for method, tier in diverse.schedule(diverse.method_tier_counts(best, rand, targets)):
        pool = sorted((r for r in rows if (r["gen_method"], r["price_tier"]) == (method, tier) and tuple(r["item_ids"]) not in state.seen), key=diverse._place)
        ok = [r for r in pool if state.class_allowed(r["gender"], r["has_dress"], tuple(r["stores"])) and state.items_allowed(r["item_ids"])]
        how = "cap"
        if ok:
            got = max(ok, key=lambda r: state.value(r) + state.class_term(r["gender"], r["has_dress"], tuple(r["stores"])))  # the first of the greatest
        else:
            kept = [r for r in pool if state.items_allowed(r["item_ids"])]
            got, how = (kept[0], "relaxed") if kept else (pool[0], "last") if pool else (None, "")
        if got is not None:
            state.take(got)
            out.append((len(out) + 1, how, tuple(got["item_ids"]), got["gen_method"]))
    return out


def pool(seed, n, items=60, stores=4):
    rng = random.Random(seed)
    rows, seen = [], set()
    for k in range(n):
        ids = [f"i{rng.randrange(items):03d}" for _ in range(rng.choice([2, 3, 3, 4]))]
        method = rng.choice(diverse.METHODS)
        if len(set(ids)) < len(ids) or (method, tuple(ids)) in seen:
            continue
        seen.add((method, tuple(ids)))
        rows.append({
            "outfit_id": f"OF_{rng.randrange(10**6):06d}", "gen_method": method, "price_tier": rng.choice(["budget", "mid", "mid", "premium"]), "gender": rng.choice(["women", "men", "unisex"]),
            "score": rng.choice([0.7, 0.75, 0.8, 0.85, None]), "price_total": rng.randrange(5) * 100_000, "item_ids": ids, "store_ids": [f"s{int(i[1:]) % stores}" for i in ids], "has_dress": rng.random() < 0.3,
        })
    return rows


SCHEMA = "outfit_id string, gen_method string, price_tier string, gender string, score double, price_total bigint, item_ids array<string>, store_ids array<string>, has_dress boolean"
TARGETS = {"budget": 0.25, "mid": 0.5, "premium": 0.25}


@pytest.mark.parametrize(("seed", "n", "caps"), [
    (1, 300, Caps(max_item_reuse=3, target_gender_shares={"women": 0.55, "men": 0.45}, max_gender_shares={"women": 0.6}, target_store_shares={"s0": 0.5, "s1": 0.3}, max_store_shares={"s0": 0.4, "s2": 0.2})),
    (2, 40, Caps(max_item_reuse=1, max_dress_share=0.0, max_gender_shares={"men": 0.1})),
    (3, 200, Caps(max_item_reuse=None, max_dress_share=None)),
])
def test_choice_equals_plain_greedy(spark, monkeypatch, seed, n, caps):
    monkeypatch.setattr(diverse, "CLASSES", 5)
    monkeypatch.setattr(diverse, "HEADS", 2)
    rows = pool(seed, n)
    plain = [dict(r, score=r["score"] or 0.0, stores=sorted(r["store_ids"])) for r in rows]
    want = plain_choice(plain, 14, 6, TARGETS, caps)
    got = diverse.select_diverse(spark.createDataFrame(rows, SCHEMA), 14, 6, TARGETS, caps).collect()
    assert sorted((r["place"], r["chosen"], tuple(r["item_ids"]), r["gen_method"]) for r in got if r["chosen"] != "fill") == want
    assert len(got) == min(20, len({tuple(r["item_ids"]) for r in rows})) == len({tuple(r["item_ids"]) for r in got})
    use = Counter(i for r in got if r["chosen"] in ("cap", "relaxed") for i in r["item_ids"])
    if caps.max_item_reuse and not any(r["chosen"] in ("last", "fill") for r in got):
        assert max(use.values()) <= caps.max_item_reuse


def test_quotas():
    assert diverse.tier_counts(9, {"budget": 0.22, "mid": 0.45, "premium": 0.33}) == {"budget": 2, "mid": 4, "premium": 3}
    counts = diverse.method_tier_counts(7, 3, {"budget": 0.2, "mid": 0.5, "premium": 0.3})
    assert sum(c for (m, _), c in counts.items() if m == "fitb_beam") == 7 and sum(counts.values()) == 10
    order = diverse.schedule({("a", "x"): 3, ("b", "x"): 1, ("a", "y"): 0})
    assert order == [("a", "x"), ("b", "x"), ("a", "x"), ("a", "x")]
    assert Caps().relaxed(3).max_item_reuse == 65 and abs(Caps().relaxed(3).max_dress_share - 0.22) < 1e-9


def item(k, category, price=200_000, gender="women", formality="casual", colors=()):
    return (f"{category}_{k}", category, gender, formality, list(colors), price, "u", [], [], [])


ITEM = "item_id string, category string, gender string, formality string, colors array<string>, price bigint, url string, styles array<string>, body_shapes array<string>, seasons array<string>"


def test_records_of_a_small_catalog(spark):
    rows = [item(1, "top", 100_000), item(1, "bottom"), item(1, "dress", 300_000), item(1, "shoes", 400_000), item(2, "shoes", 450_000)]
    got = generation.build_records(spark.createDataFrame(rows, ITEM), 6, fitb_ratio=0.5).orderBy("record_id").collect()
    assert [r["record_id"] for r in got] == [f"OF_{i:05d}" for i in range(1, 7)]
    assert Counter(r["gen_method"] for r in got) == {"fitb_beam": 3, "random_scored": 3}
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    assert all("shoes" in r["categories"] and ("dress" in r["categories"] or {"top", "bottom"} <= set(r["categories"])) for r in got)
    empty = spark.createDataFrame([], ITEM)
    assert generation.best_combinations(empty, 5).count() == 0 and generation.random_combinations(empty, 5).count() == 0


def test_best_equals_the_sorted_product(spark):
    """Odd items: no colors, repeated colors, unknown formality, missing gender and price."""
    rng = random.Random(4)
    rows = []
    for category in ("top", "bottom", "dress", "shoes"):
        for k in range(14):
            colors = [rng.choice(["red", "Red", "blue", "", "green"]) for _ in range(rng.choice([0, 1, 2, 3]))]
            rows.append((f"{category[0]}{k:02d}", category, rng.choice(["men", "women", "unisex", "kid", None]), rng.choice(["casual", "formal", "athletic", "smart_casual", None, "odd"]), colors, rng.choice([None, 10_000, 200_000, 900_000, 2_000_000]), rng.choice(["u", "", None]), [], [], []))
    ranks = {"athletic": 0, "casual": 1, "smart_casual": 2, "formal": 3}

    def valid(combo):
        told = {c[2] or "unisex" for c in combo} - {"unisex"}
        bands = [ranks[c[3]] for c in combo if c[3] in ranks]
        return len(told) < 2 and (not bands or max(bands) - min(bands) <= 1)

    def score(combo):
        total = sum(c[5] or 0 for c in combo)
        s = 0.35 + (0.20 if 300_000 <= total <= 1_800_000 else 0.10 if 150_000 <= total <= 3_000_000 else 0.0)
        colors = [x.lower() for c in combo for x in c[4] if x]
        s += min(0.15, (len(colors) - len(set(colors))) * 0.05) + 0.05 if colors else 0.0
        return max(0.0, min(1.0, round(s + 0.15 * (sum(bool(c[6]) for c in combo) / len(combo)), 6)))

    by = {c: [r for r in rows if r[1] == c] for c in ("top", "bottom", "dress", "shoes")}
    combos = [x for t in by["top"] for b in by["bottom"] for s in by["shoes"] if valid(x := (t, b, s))] + [x for d in by["dress"] for s in by["shoes"] if valid(x := (d, s))]
    want = sorted(((score(c), [i[0] for i in c]) for c in combos), reverse=True)
    for n in (1, 30, 200):
        got = generation.best_combinations(spark.createDataFrame(rows, ITEM), n, firsts=3, pairs=5)
        assert sorted(((r["score"], r["item_ids"]) for r in got.collect()), reverse=True) == want[:n]


def test_random_combinations_are_uniform(spark):
    """Each valid combination is drawn about equally often (chi-square), reruns agree, and all are found in the end."""
    rows = [item(k, "top", gender=g, formality=f) for k, (g, f) in enumerate([("men", "casual"), ("women", "formal"), ("unisex", "casual"), ("women", "athletic")])]
    rows += [item(k, "bottom", gender=g, formality=f) for k, (g, f) in enumerate([("men", "casual"), ("women", "casual"), ("unisex", "smart_casual")])]
    rows += [item(k, "shoes", gender=g) for k, g in enumerate(["men", "women", "unisex"])] + [item(k, "dress", formality=f) for k, f in enumerate(["casual", "formal"])] + [item(1, "bag", gender="men")]
    items = spark.createDataFrame(rows, ITEM)
    got = generation.random_combinations(items, 500, chance=0.0).collect()
    bands = {"athletic": 0, "casual": 1, "smart_casual": 2, "formal": 3}

    def valid(xs):
        return len({x[2] for x in xs} - {"unisex"}) < 2 and max(bands[x[3]] for x in xs) - min(bands[x[3]] for x in xs) <= 1

    of = lambda c: [r for r in rows if r[1] == c]
    every = [[x[0] for x in xs] for xs in [(t, b, s) for t in of("top") for b in of("bottom") for s in of("shoes")] + [(d, s) for d in of("dress") for s in of("shoes")] if valid(xs)]
    assert sorted(r["item_ids"] for r in got) == sorted(every)
    assert got == generation.random_combinations(items, 500, chance=0.0).collect()
    drawn = Counter()
    for seed in range(8):
        drawn.update(tuple(r["item_ids"]) for r in generation.random_combinations(items, 12, seed=seed, chance=0.0).collect())
    each = sum(drawn.values()) / len(every)
    assert sum((drawn[tuple(c)] - each) ** 2 / each for c in every) < 3 * len(every)
    bags = generation.random_combinations(items, 500, chance=1.0).collect()
    assert any("bag_1" in r["item_ids"] for r in bags)
    assert all("bag_1" not in r["item_ids"] or not {x["gender"] for x in r["items"]} - {"unisex", "men"} for r in bags)


def test_attempts_relax_caps_and_keep_the_best(spark):
    rows = [dict(r, score=r["score"] or 0.0, categories=["dress", "shoes"] if r["has_dress"] else ["top", "bottom", "shoes"]) for r in pool(5, 250)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA + ", categories array<string>")
    items = spark.createDataFrame([(f"i{k:03d}", "unisex", "casual") for k in range(60)], "item_id string, gender string, formality string")
    loose = {"min_distinct_items": 1, "max_dress_share": 1.0, "min_dress_share": 0.0, "max_gender_share": 1.0, "max_store_share": 1.0, "min_score_mean": 0.0}
    caps = Caps(max_item_reuse=2, max_dress_share=None)
    chosen, reports = diverse.build_within_limits(df, items, 7, 3, TARGETS, caps, "s0", 3, loose)
    got = reports.collect()
    assert len(got) == 1 and got[0]["failures"] == [] and got[0]["total"] == 10 == chosen.count() and got[0]["best"] == 7
    _, reports = diverse.build_within_limits(df, items, 7, 3, TARGETS, caps, "s0", 2, loose | {"min_distinct_items": 1000, "max_reuse": 0})
    got = sorted(reports.collect(), key=lambda r: r["attempt"])
    assert [r["attempt"] for r in got] == [1, 2] and all([f.split()[0] for f in r["failures"]] == ["distinct_items", "reuse_max"] for r in got)
    r = got[0]
    want = r["score_mean"] + r["distinct_items"] / 1000 + max(0, 80 - r["reuse_p95"]) / 80 + max(0, 120 - r["reuse_max"]) / 120 + max(0, 1 - abs(r["dress_share"] - 0.12)) + max(0, 1 - abs(r["women_share"] - 0.55)) + max(0, 1 - r["store_share"])
    assert abs(r["quality"] - want) < 1e-9


def test_registered_choice_equals_plain_greedy(spark, monkeypatch):
    """The query diverse_outfits, which has no SQL, on its own candidates (built once)."""
    from weftline.plans import building
    from weftline.sources.shared import written

    sf = "/root/testdata/sf0.001"
    found = written(building.candidates(spark, sf), "candidates")
    monkeypatch.setattr(building, "candidates", lambda spark, sf_dir: found)
    rows = [r.asDict() for r in found.collect()]
    plain = [dict(r, score=r["score"] or 0.0, stores=sorted(r["store_ids"])) for r in rows]
    want = plain_choice(plain, building.CHOSEN_BEST, building.CHOSEN_RANDOM, building.TARGETS, building.CAPS)
    got = building.diverse_outfits(spark, sf).collect()
    assert sorted((r["place"], r["chosen"], tuple(r["item_ids"].split("|")), r["gen_method"]) for r in got if r["chosen"] != "fill") == want
    assert len(got) == building.CHOSEN_BEST + building.CHOSEN_RANDOM
