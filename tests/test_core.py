"""Core operators on odd rows: nulls, empty tables, ties, repeats, clashing names; streams over a restart; edges against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.expressions import pair_score
from weftline.functions.vocab import COMPLEMENTS, FORMALITIES
from weftline.operators import audit, catalog, checks, corpus, dialogue, graph, metrics, outfits, tags
from weftline.streaming import upserts

ITEMS = "item_id string, category string, gender string, formality string, colors array<string>, price bigint"


def test_upsert_stream_survives_a_restart(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    schema = "k int, at int, v string, rank int, age int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        updates = spark.readStream.schema(schema).parquet(source)
        upserts.maintain(updates, root, ["k"], checkpoint, "at").awaitTermination()
        now = upserts.current(spark.createDataFrame([], schema), root)
        return sorted((r["k"], r["at"], r["v"]) for r in now.collect())

    assert arrive([(1, 1, "a", 0, 0), (2, 1, "b", 0, 0)]) == [(1, 1, "a"), (2, 1, "b")]
    # every call starts anew from the folder; a late row does not replace a newer one
    assert arrive([(2, 3, "c", 0, 0), (3, 1, "d", 0, 0)]) == [(1, 1, "a"), (2, 3, "c"), (3, 1, "d")]
    assert arrive([(2, 2, "late", 0, 0)]) == [(1, 1, "a"), (2, 3, "c"), (3, 1, "d")]
    batch = spark.createDataFrame([(9, 1, "x", 0, 0)], schema)
    for _ in range(2):  # a batch that is run again changes nothing
        upserts.upsert(batch, 7, root, ["k"], "at")
    assert upserts.current(batch, root).count() == 4


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double")
    got = upserts.windowed_counts(rows.withColumn("ts", F.to_timestamp("ts"))).collect()
    assert sorted((r["n"], r["total"]) for r in got) == [(1, 4.0), (2, 3.0)]


def odd_items():
    rng = random.Random(3)
    rows = []
    for k in range(150):
        colors = rng.choice([["Red"], ["red ", "blue"], [], None, ["blue", "green"], ["black"]])
        rows.append((f"i{k:03d}", rng.choice([*COMPLEMENTS, "hat"]), rng.choice(["men", "women", "unisex", "kid"]), rng.choice([*FORMALITIES, None, "odd"]), colors, rng.choice([100_000, 100_000, 250_000, 999_000, 5_000_000])))
    return rows


def test_edges_are_those_of_all_pairs(spark):
    items = spark.createDataFrame(odd_items(), ITEMS)
    key = lambda e: sorted(map(tuple, e.collect()))
    for anchors in (None, items.where("item_id < 'i040'")):
        assert key(graph.build_edges(items, 4, anchors)) == key(graph.build_edges_with(pair_score, items, 4, anchors))
    assert graph.build_edges(items.limit(0), 4).count() == 0
    edges = graph.build_edges(items.where("item_id < 'i100'"), 4)
    more = graph.extend_edges(items, edges, 4)
    known = {(r["src_id"], r["dst_id"]): r["weight"] for r in edges.collect()}
    found = {(r["src_id"], r["dst_id"]): r["weight"] for r in more.collect()}
    assert known.items() <= found.items() and any(b >= "i100" for _, b in found)
    one = next(iter(sorted(known)))
    assert graph.neighbors(edges, one[0]).where(F.col("partner_id") == one[1]).count() == 1
    pairs = spark.createDataFrame([one, one[::-1], ("i000", "none")], "a string, b string")
    assert [r["weight"] for r in graph.edge_weights(pairs, edges).orderBy("a", "b").collect() if r["weight"]] == [known[one]] * 2
    assert graph.coherence_violations(items, edges).count() == 0


def test_edges_from_small_blocks_are_those_of_all_pairs(spark):
    # prices missing, below 0 and alike, blocks of one or few items, so that most anchors need more than one pass
    rng = random.Random(5)
    rows = [(*r[:5], rng.choice([r[5], r[5], rng.randrange(1_000, 9_000_000), None, 0, -5])) for r in odd_items()]
    items = spark.createDataFrame(rows, ITEMS)
    key = lambda e: sorted(map(tuple, e.collect()))
    want = key(graph.build_edges_with(pair_score, items, 3))
    for block in (1, 4):
        assert key(graph.build_edges(items, 3, block=block)) == want


def test_equal_weights_of_different_prices_go_by_id(spark):
    """Prices that only the seventh decimal tells apart: of many partners the smallest ids, not the nearest prices."""
    rows = [("t", "top", "men", "casual", ["red"], 2_000_000_000)] + [(f"b{k:02d}", "bottom", "men", "casual", ["red"], 2_000_000_040 - k) for k in range(40)]
    items = spark.createDataFrame(rows, ITEMS)
    got = graph.build_edges(items, 3, items.where("item_id = 't'")).collect()
    assert sorted(r["src_id"] for r in got) == ["b00", "b01", "b02"] and {r["weight"] for r in got} == {1.0}


def test_clique_expansion(spark):
    edges = spark.createDataFrame([("b", "t", "bottom", "top", 0.9), ("s", "t", "shoes", "top", 0.8), ("b", "s", "bottom", "shoes", 0.7), ("d", "o", "dress", "outerwear", 0.9), ("b", "s2", "bottom", "shoes", 0.1)], "src_id string, dst_id string, src_category string, dst_category string, weight double")
    seeds = spark.createDataFrame([("t", "top"), ("d", "dress"), ("t", "top"), ("x", "top"), ("e", "dress")], "item_id string, category string")
    got = {tuple(r["items"]): r["score"] for r in outfits.assemble(seeds.distinct(), edges).collect()}
    assert got == {("t", "b", "s"): 0.8, ("d", "o"): 0.9, ("e",): 0.0}


def test_batches_beyond_a_thousand_and_rows_of_one_position(spark):
    text = {c: F.lit("x").cast("string") for c in (*checks.CATALOG_COLUMNS, *checks.LINK_COLUMNS)}
    rows = spark.range(1002).withColumns(text).withColumns({"pos": F.col("id"), "item_id": F.col("id").cast("string"), "category": F.lit("top"), "colors": F.lit("[]"), "store_id": F.lit("s"), "product_url": F.lit("http://x/a"), "price_vnd": F.lit(50_000), "sale_price_vnd": F.lit(None).cast("bigint")})
    raws = spark.createDataFrame([("s", 1000)], "store_id string, raws bigint")
    batches = checks.gate_batches(rows, raws, ("s",), chunk=1)
    names = {r["batch_id"] for r in batches.collect()}
    assert len(names) == 1002 and {"s#000", "s#100", "s#1001"} <= names
    assert checks.promoted(rows, batches, chunk=1).groupBy("batch_id").count().where("count > 1").isEmpty()
    # two rows of one position, one of them bad: both of their chunks fail
    two = rows.where("pos = 7").unionByName(rows.where("pos = 7").withColumn("category", F.lit("hat")))
    assert [r["blocking_codes"] for r in checks.gate_batches(two, raws, ("s",), chunk=1).collect()] == [["invalid_category"]] * 2


def times_written(rows, name: str) -> int:
    return rows._jdf.queryExecution().optimizedPlan().toString().count(name + "(")


def test_answers_are_read_once_a_row(spark):
    rows = spark.createDataFrame([("{}",)], "t string").select(audit.sanitize_tags(F.col("t")).alias("x"))
    assert times_written(rows, "regexp_extract") == 1 and times_written(rows, "get_json_object") == 10


def test_calls_are_read_once_a_row(spark):
    rows = spark.createDataFrame([("a", "b")], "g string, r string").select(dialogue.call_f1(F.col("g"), F.col("r")).alias("x"))
    assert times_written(rows, "regexp_extract_all") == 2  # one for either text


def test_clashing_names_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 5, "a", 0), (1, 5, "a", 0), (None, 1, None, 9), (2, None, "b", 3)], "k int, rank int, age string, n int")
    assert catalog.latest(rows, ["k"], [F.desc("rank")]).count() == 3
    assert catalog.keep_last(rows, rows.where("k = 1"), ["k"]).count() == 3
    split = corpus.stratified_split(rows.withColumn("place", F.lit(1)), "rank", "age")
    assert split.count() == 4 and split.columns == [*rows.columns, "place", "is_eval"]
    assert corpus.distinct_first(rows.withColumn("signature", F.lit(1)), F.coalesce("age", F.lit("")), "rank").count() == 3
    assert metrics.nearest_rank(rows, "age", "n", 0.5, "upto").count() == 3
    assert corpus.word_stats(rows.limit(0), "n").first()["total"] == 0
    assert corpus.word_stats(rows, "n").first()[0:4] == (3.0, 3.0, 9.0, 9)
    tagged = spark.createDataFrame([("a", ["x", "y"], True, 1), ("a", ["y", " "], None, 3), (None, ["q"], False, 2), ("b", [], True, 7)], "g string, t array<string>, f boolean, v int")
    got = {r["g"]: (r["total"], r["f_share"], r["p50"], r["most"], r["top_tag"]) for r in corpus.group_distribution(tagged, "g", ["f"], "v", "t").collect()}
    assert got == {"a": (2, 0.5, 2.0, 3, "y"), "unknown": (1, 0.0, 2.0, 2, "q"), "b": (1, 1.0, 7.0, 7, None)}
    log = spark.createDataFrame([("m", True, ["a"], None, " n", 1.5), ("m", False, [], ["s"], None, None)], "model string, ok boolean, body_shapes array<string>, seasons array<string>, note string, latency_s double")
    assert tuple(corpus.model_summary(log, "model").first()) == ("m", 2, 1, 1, 1, 1, 1.5)
    assert metrics.fitb_accuracy(rows.limit(0), "k", "rank").first()["accuracy"] == 0.0


@pytest.mark.parametrize(
    "value, ok",
    [('["a", "b"]', True), ("[]", True), (" [ ] ", True), ("[null]", False), ('["a", null]', False), ("[1]", False), ('{"a": 1}', False), ("x", False), (None, False), ("", False)],
)
def test_json_strings(spark, value, ok):
    df = spark.createDataFrame([(value,)], "c string")
    assert df.select(checks.is_json_strings(F.col("c"))).first()[0] is ok


def test_missing_columns_are_all_that_is_reported(spark):
    items = spark.createDataFrame([("a", "hat")], "item_id string, category string")
    got = checks.check_frames(items, items, ("s",)).collect()
    assert [(r["code"], r["n"]) for r in got] == [("missing_catalog_columns", 9), ("missing_link_columns", 9)]


def test_shared_tags(spark):
    schema = "items array<struct<item_id:string,category:string,gender:string,formality:string,colors:array<string>,price:bigint,url:string,styles:array<string>,body_shapes:array<string>,seasons:array<string>>>"

    def item(category, body, season):
        return (category, category, "unisex", "casual", None, 1, None, None, body, season)

    cases = [
        [item("top", ["pear", "rectangle"], ["summer", "transitional"]), item("bottom", ["pear", "hourglass"], ["transitional"]), item("shoes", None, ["transitional", "rainy"])],
        [item("dress", ["hourglass", "pear"], ["summer", "transitional"]), item("shoes", ["rectangle"], ["summer"]), item("accessory", ["apple"], ["winter"])],
        [item("top", ["rectangle"], ["summer"]), item("bottom", ["pear"], ["transitional"]), item("accessory", ["apple"], ["winter"])],
        [],
    ]
    rows = spark.createDataFrame([(c,) for c in cases], schema)
    got = rows.select(tags.outfit_body_shapes(F.col("items")), tags.outfit_seasons(F.col("items")), tags.outfit_gender(F.col("items")), tags.outfit_occasions(F.col("items"))).collect()
    assert [tuple(r[:2]) for r in got] == [(["pear"], ["transitional"]), (["pear", "hourglass"], ["summer", "transitional"]), (["pear", "rectangle"], ["summer", "transitional"]), ([], [])]
    assert got[3][2:] == ("unisex", [])
    vectors = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0, 5.0], []],), ([],)], "v array<array<double>>")
    assert [r[0] for r in vectors.select(tags.mean_vector(F.col("v"))).collect()] == [[2.0, 3.0], []]


def test_dialogue_edges(spark):
    row = spark.range(1)
    args = F.struct(F.lit("office").alias("occasion"), F.lit(None).cast("bigint").alias("price_max"))
    text = row.select(dialogue.render_call(args)).first()[0]
    assert text == '<tool_call>{"name":"search_outfits","arguments":{"occasion":"office"}}</tool_call>'
    got = row.select(dialogue.text_call_errors(F.lit(text)), dialogue.call_f1(F.lit(text), F.lit("none")), dialogue.text_similarity(F.lit(""), F.lit("a")), dialogue.text_similarity(F.lit("a a b"), F.lit("A c")), dialogue.judge(F.lit(None).cast("array<struct<role:string,content:string>>"), F.lit("t"))).first()
    assert tuple(got) == ([], None, 0.0, 0.4, ["invalid_message_shape"])


def test_answer_scorers(spark):
    from weftline.operators import scorers

    good = '<tool_call>{"name":"search_outfits","arguments":{"occasion":"office","style":"casual"}}</tool_call>'
    half = good.replace("casual", "korean")
    bad = good.replace("casual", "odd")
    cases = [(good, good, True), (half, good, True), (bad, good, False), ("không phù hợp", good, False), ("phù hợp", "no call", True)]
    rows = spark.createDataFrame(cases, "text string, reference string, coherent boolean")
    got = rows.select(scorers.derivation_score(F.col("text"), F.col("reference")), scorers.coherence_score(F.col("text"), F.col("coherent"))).collect()
    assert [r[0] for r in got] == [1.0, 0.6667, 0.0, 0.0, 0.0]
    assert [r[1] for r in got[3:]] == [1.0, 1.0]


def test_balanced_selection(spark):
    from weftline.operators import selection

    rows = [("a", "mid", 400_000, 0.5), ("b", "mid", 300_000, 0.5), ("c", "premium", 900_000, 0.9), ("c", "premium", 900_000, 0.1), ("d", None, None, None)]
    found = spark.createDataFrame(rows, "outfit_id string, price_tier string, price_total long, score double")
    got = [tuple(r) for r in selection.select_balanced(found, {"budget": 1, "mid": 1, "premium": 5}).select("outfit_id", "chosen", "score").collect()]
    assert sorted(got, key=repr) == sorted([("b", "quota", 0.5), ("c", "quota", 0.9), ("a", "fill", 0.5), ("d", "fill", None), ("c", "repeat", 0.9), ("b", "repeat", 0.5), ("a", "repeat", 0.5)], key=repr)
    assert selection.select_balanced(found.limit(0), {"mid": 2}).count() == 0
    assert [r["score"] for r in selection.rescored(found, F.col("score") * 2, 0.9).collect()] == [1.0, 1.0, 1.0]


def test_audit_of_odd_rows(spark):
    from weftline.operators import audit

    columns = "item_id string, category string, store_id string, title string, body_shapes string, seasons string, colors string, note string, n long"
    rows = [(None,) * 9, ("i", "bag", "", None, "[1, null]", "NaN", "[", "Áo " + "x" * 200_000, 1)] + [("same", "top", "s", "t", '["pear"]', '["summer"]', '["a"]', "n", 2)] * 12
    found = audit.audited(spark.createDataFrame(rows, columns))
    flags = audit.semantic_flags(found)
    by = {(r["item_id"], r["rule_id"]) for r in flags.collect()}
    assert by == {(None, "fallback_note_review"), ("same", "repeated_generic_note"), ("i", "note_category_mismatch")}
    bad = {(r["item_id"], r["field"], r["reason"], r["evidence"]) for r in audit.invalid_tags(found).collect()}
    assert bad == {(None, "note", "empty_note", ""), ("i", "body_shapes", "invalid_body_shape", "1"), ("i", "colors", "invalid_json_list", "[")}
    assert [r["outlier_type"] for r in audit.outliers(found).collect()] == ["long_note"]
    assert {r["item_id"] for r in audit.review_sample(found, flags, per_category=1).collect()} >= {"i", "same"}
    empty = audit.audited(spark.createDataFrame([], columns))
    assert audit.review_sample(empty, audit.semantic_flags(empty)).count() == audit.invalid_tags(empty).count() == 0
    text = spark.createDataFrame([("{oops",), (None,)], "t string")
    assert [r["x"] is None for r in text.select(audit.sanitize_tags(F.col("t")).alias("x")).collect()] == [True, False]


def test_tables_that_grow_with_the_catalog_are_not_sent_out(spark, tmp_path):
    """Small files hold many rows: joins of edges with contexts and items build no table in memory."""
    spark.createDataFrame([("a", "s", "top", "shoes", 0.5), ("b", "s", "bottom", "shoes", 0.4)], "src_id string, dst_id string, src_category string, dst_category string, weight double").write.parquet(f"{tmp_path}/edges")
    spark.createDataFrame([("a", "top", "men", "casual"), ("b", "bottom", "men", "casual"), ("s", "shoes", "women", "casual")], "item_id string, category string, gender string, formality string").write.parquet(f"{tmp_path}/items")
    edges, items = spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/items")
    contexts = items.where("category = 'top'").select(F.col("item_id").alias("key"), F.array("item_id").alias("items"))
    found, bad = graph.rank_completions(contexts, edges, "shoes", 5), graph.coherence_violations(items, edges)
    for df in (found, bad):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("a", 1, "s")] and bad.count() == 2


def test_anchors_with_enough_of_their_color_end_the_search(spark, monkeypatch):
    """Where colors give all k, no partner is dealt out a second time; few anchors that are left get only blocks they look into."""
    rows = [(f"i{n:03}", "top" if n % 2 else "bottom", "men", "casual", "red", 100 + n) for n in range(60)]
    items = spark.createDataFrame(rows, "item_id string, category string, gender string, formality string, color string, price long")
    met, searches, pairs = graph._met, [], [("top", "bottom"), ("bottom", "top")]
    monkeypatch.setattr(graph, "_met", lambda *a: searches.append(a[2]) or met(*a))
    got = {(r["src_id"], r["dst_id"], r["weight"]) for r in graph.build_edges(items, 3, pairs=pairs).collect()}
    assert searches == [["category", "audience", "color"]]
    assert got == {(r["src_id"], r["dst_id"], r["weight"]) for r in graph.build_edges_with(pair_score, items, 3, pairs=pairs).collect()}


def test_new_edges_are_not_looked_up_among_the_old(spark):
    """Old edges stay as they are, and no join deals them out again."""
    rows = [(f"i{n:03}", "top" if n % 2 else "bottom", "men", "casual", "red", 100 + n) for n in range(40)]
    items = spark.createDataFrame(rows, "item_id string, category string, gender string, formality string, color string, price long")
    old = graph.build_edges(items.where("item_id < 'i030'"), 3)
    more = graph.extend_edges(items, old, 3)
    assert "LeftAnti" not in more._jdf.queryExecution().optimizedPlan().toString()
    pairs = [(r["src_id"], r["dst_id"]) for r in more.collect()]
    assert len(pairs) == len(set(pairs)) and {(r["src_id"], r["dst_id"]) for r in old.collect()} < set(pairs)


def test_outfits_deal_out_only_edges_they_can_use(spark, monkeypatch):
    """Places are those of tops and dresses; an edge is looked up for the category at its end, from what an outfit holds by then."""
    edges = spark.createDataFrame([("b", "t", "bottom", "top", 0.9), ("s", "t", "shoes", "top", 0.8), ("b", "s", "bottom", "shoes", 0.7), ("bag", "s", "bag", "shoes", 0.6)], "src_id string, dst_id string, src_category string, dst_category string, weight double")
    kept, links = [], outfits._links
    monkeypatch.setattr(outfits, "_links", lambda *a: kept.append(a[1]) or links(*a))
    seeds = spark.createDataFrame([("t", "top"), ("b", "bottom")], "item_id string, category string")
    assert [(r["items"], r["score"]) for r in outfits.assemble(seeds, edges).collect()] == [(["t", "b", "s"], 0.8)]
    assert kept[0] == ("top", "dress") and kept[1] == ("top", "dress", "bottom") and kept[-1][-1] == "bag"


def test_a_block_weighs_only_what_is_near_in_price(monkeypatch):
    """A block's work follows its anchors, not its pairs, whatever the number of equal prices; the k best are those of all pairs."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n, some, k = 3000, 400, 5

    def table(ids, prices):
        ranks = rng.integers(-1, 4, len(ids))
        return {"rank": pa.array(ranks, pa.int32()), "colors": [["red"]] * len(ids), "price": np.asarray(prices, float)}

    left = pa.table({"src": [f"a{i:04d}" for i in range(some)], **table(range(some), rng.integers(1000, 1400, some)), "loose": rng.random(some) < 0.5, "found": pa.array([None] * some, pa.list_(pa.struct([("loss", pa.int32()), ("dst", pa.string())]))), "bound": pa.array([-1] * some, pa.int32()), "more": pa.array([0] * some, pa.int32()), "ranks_there": pa.array([31] * some, pa.int32()), "odd": [False] * some, "plain": [False] * some})
    right = pa.table({"dst": [f"b{i:04d}" for i in rng.permutation(n)], **table(range(n), np.where(rng.random(n) < 0.5, 1200, rng.integers(1000, 1400, n)))})
    weighed, share = [], graph._price_share
    monkeypatch.setattr(graph, "_price_share", lambda p, q: weighed.append(np.broadcast(p, q).size) or share(p, q))
    near = graph._best_of_block(left, right, k, True)["found"].to_pylist()
    assert sum(weighed) < some * n / 4
    monkeypatch.setattr(graph, "_nearest", lambda best, rows, *a: best.__setitem__(rows, graph._largest(a[4](rows, np.arange(n)[None, :]), k)))
    assert near == graph._best_of_block(left, right, k, True)["found"].to_pylist() and all(len(x) == k for x in near)


def test_edges_are_neither_added_up_nor_sorted(spark):
    """An edge that both ends found is known from the partner's list; who has no gender has no list. Gates deal out edges to items without sorting."""
    rows = [(f"i{n:03}", "top" if n % 2 else "bottom", ("men", "unisex", None)[n % 3], "casual", "red", 100 + n) for n in range(60)]
    items = spark.createDataFrame(rows, "item_id string, category string, gender string, formality string, color string, price long")
    edges = graph.build_edges(items, 3)
    assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString()
    found = [(r["src_id"], r["dst_id"]) for r in edges.collect()]
    lists = {}
    for a in rows:
        fits = [b for b in rows if a[1] != b[1] and a[2] and (a[2] == b[2] or "unisex" in (a[2], b[2]))]
        share = lambda b: round(min(a[5], b[5]) / max(a[5], b[5]) * 250_000)  # noqa: B023, E731
        lists[a[0]] = [b[0] for b in sorted(fits, key=lambda b: (-share(b), b[0]))[:3]]
    assert sorted(found) == sorted({(min(a, b), max(a, b)) for a, bs in lists.items() for b in bs}) and any(int(x[1:]) % 3 == 2 for pair in found for x in pair)
    plan = graph.coherence_violations(items, edges)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin [src_id" not in plan


def test_completions_read_only_edges_that_can_count(spark, tmp_path):
    """Edges without an end in the category are left out before both directions are made; they are not sorted, and masked outfits are worked out once."""
    from weftline.operators import recommend

    rows = [("b", "t", "bottom", "top", 0.9), ("s", "t", "shoes", "top", 0.8), ("b", "s", "bottom", "shoes", 0.7), ("r", "t", "shoes", "top", 0.9), ("b", "r", "bottom", "shoes", 0.2), ("bag", "t", "bag", "top", 0.5)]
    spark.createDataFrame(rows, "src_id string, dst_id string, src_category string, dst_category string, weight double").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    pairs = lambda df: {(r["item_id"], r["partner_id"]) for r in df.collect()}
    assert pairs(graph.directed(edges, ("top",), ("shoes",))) == {("t", "s"), ("t", "r")} and pairs(graph.directed(edges, to=("bag",))) == {("t", "bag")} and len(pairs(graph.directed(edges))) == 12
    assert pairs(graph.best_partners(edges, "top", "shoes")) == {("t", "r")}
    contexts = spark.createDataFrame([("t", ["t", "b"])], "key string, items array<string>")
    found = graph.rank_completions(contexts, edges, "shoes", 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [(r["place"], r["partner_id"]) for r in found.orderBy("place").collect()] == [(1, "s"), (2, "r")] and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    slot = "struct<item_id:string,category:string>"
    outfits_ = spark.createDataFrame([("t", [("t", "top"), ("b", "bottom"), ("r", "shoes")]), ("x", [("x", "top"), ("b", "bottom")])], f"key string, items array<{slot}>")
    seen = []
    got = recommend.fitb_recall(outfits_, edges, lambda *a: seen.append(a[0]) or graph.rank_completions(*a), 1).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0.0)] and "FileScan parquet" in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_new_edges_are_not_added_up(spark):
    """Edges of an incremental build are known from lists as those of a whole one, also where one end is no anchor."""
    rows = [(f"i{n:03}", "top" if n % 2 else "bottom", "men", "casual", "red", 100 + n * n) for n in range(40)]
    items = spark.createDataFrame(rows, "item_id string, category string, gender string, formality string, color string, price long")
    fresh = items.where("item_id like '%5' or item_id like '%4'")
    old = graph.build_edges(items.join(fresh, "item_id", "left_anti"), 3)
    more = graph.extend_edges(items, old, 3)
    assert "Aggregate" not in more._jdf.queryExecution().optimizedPlan().toString()
    want = {tuple(r) for r in old.collect()} | {tuple(r) for r in graph.build_edges_with(pair_score, items, 3, fresh).collect()}
    found = [tuple(r) for r in more.collect()]
    assert len(found) == len(want) and set(found) == want
