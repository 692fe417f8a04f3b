"""Embeddings, evaluation by task, experiments and benchmark samples."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import dialogue, embedding, evaluate


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "Một áo  thun")], "k int, t string")
    got = {r["k"]: r["vector"] for r in embedding.encoded(rows, F.col("t"), embedding.HashEncoder, batch=2).collect()}
    assert all(len(v) == 128 for v in got.values()) and not any(got[2]) and not any(got[3])
    assert abs(math.sqrt(sum(x * x for x in got[1])) - 1) < 1e-12 and abs(math.sqrt(sum(x * x for x in got[4])) - 1) < 1e-12
    native = {r["k"]: r["vector"] for r in embedding.hashed_vectors(rows, "k", F.col("t"), 16).collect()}
    assert all(len(v) == 16 for v in native.values()) and not any(native[3]) and abs(sum(x * x for x in native[4]) - 1) < 1e-12

    class Short:
        def encode(self, texts):
            return [[1.0]] * (len(texts) - 1)

    class Ragged:
        def encode(self, texts):
            return [[1.0] * (k + 1) for k in range(len(texts))]

    class Empty:
        def encode(self, texts):
            return [[] for _ in texts]

    for encoder, message in ((Short, "embeddings for"), (Ragged, "dimensions, not 1"), (Empty, "0 dimensions")):
        with pytest.raises(Exception, match=message):
            embedding.encoded(rows.coalesce(1), F.col("t"), encoder).collect()


CALL = '<tool_call>{"name":"search_outfits","arguments":{"occasion":"date","price_max":%s}}</tool_call>'


def test_samples_and_rollup(spark):
    rows = [(1, "x", CALL % 5, CALL % '"5"'), (2, "x", "no", CALL % 5), (3, None, "a b b", "b b c"), (4, "y", "", "")]
    df = spark.createDataFrame(rows, "key int, task_type string, generated string, reference string")
    scored = evaluate.evaluate_samples(df)
    by = {r["key"]: r for r in scored.collect()}
    assert by[1]["tool_call_f1"] == 1.0 and by[2]["tool_call_f1"] == 0.0 and by[3]["tool_call_f1"] is None
    assert abs(by[3]["text_similarity"] - 2 / 3) < 1e-12 and by[4]["text_similarity"] == 0.0 and by[2]["format_compliance"] == 0.0
    got = {r["task_type"]: (r["count"], r["mean_tool_call_f1"], r["mean_format_compliance"]) for r in evaluate.summarize_scores(scored).collect()}
    assert got == {"x": (2, 0.5, 0.5), "unknown": (1, 0.0, 1.0), "y": (1, 0.0, 1.0), None: (4, 0.5, 0.75)}
    made = evaluate.generated_answers(df, "reference", lambda: str.upper).collect()
    assert {r["key"]: r["generated"] for r in made if r["key"] == 3} == {3: "B B C"} or made[2]["reference"] == "b b c"
    whole = spark.createDataFrame([('{"name":"search_outfits","arguments":{"occasion":"date","price_max":99999999999999999999}}',), ('{"name":"search_outfits","arguments":{"occasion":"date","price_max":1.5}}',)], "j string")
    assert [r["e"] for r in whole.select(dialogue.call_errors(F.col("j")).alias("e")).collect()] == [[], ["price_max must be an integer"]]


def test_metrics(spark, tmp_path):
    (tmp_path / "one.csv").write_text("ablation,metric,value,timestamp\nall,cov,0.1,2026-01-01T10:00:00\nall,cov,0.2,2026-01-02T10:00:00\nall,fitb,1.0,bad\n")
    (tmp_path / "two.csv").write_text("metric,value\ncov,3\n")
    rows = evaluate.read_metrics(spark, str(tmp_path))
    assert rows.count() == 4
    got = {(r["experiment"], r["ablation"]): (r["cov"], r["fitb"]) for r in evaluate.metrics_table(rows, ["cov", "fitb"]).collect()}
    assert got["one.csv", "all"] == ("0.2", "1.0") and got["two.csv", "unknown"][1] is None
    lines = [r["line"] for r in evaluate.markdown_lines(rows).where("experiment = 'one.csv'").orderBy("place").collect()]
    assert lines[0] == "| **one.csv** |  |  |  | 2026-01-02 10:00 |" and len(lines) == 4
    wide = spark.createDataFrame([("e", "a", 0.5, 3, None)], "experiment string, ablation string, recall double, n int, missing double")
    assert sorted((r["metric"], r["value"]) for r in evaluate.metrics_long(wide, ["experiment", "ablation"]).collect()) == [("n", 3.0), ("recall", 0.5)]


def test_sample_takes_whole_outfits_and_fails_when_it_can_not(spark):
    items = spark.createDataFrame([(f"{c}{k}", c, True) for c in ("bag", "shoes", "top") for k in range(5)], "item_id string, category string, tagged boolean")
    outfits = spark.createDataFrame([("o1", ["top0", "shoes0"]), ("o2", ["top1", "shoes0"])], "outfit_id string, item_ids array<string>")
    got = evaluate.benchmark_sample(outfits, items, 9, 2).collect()
    assert len({r["item_id"] for r in got}) == 9 and {r["item_id"] for r in got if r["why"] == "outfit"} == {"top0", "top1", "shoes0"} and sorted(r["place"] for r in got) == list(range(1, 10))
    assert [r["item_id"][:3] for r in sorted(got, key=lambda r: r["place"])[3:]] == ["bag", "sho", "top"] * 2
    with pytest.raises(ValueError, match="more than"):
        evaluate.benchmark_sample(outfits, items, 2, 2)
    with pytest.raises(ValueError, match="only"):
        evaluate.benchmark_sample(outfits, items, 99, 2)
    with pytest.raises(ValueError, match="positive"):
        evaluate.benchmark_sample(outfits, items, 0, 2)


def test_tokens_stay_in_their_task(spark):
    rows = spark.createDataFrame([(1, "a b b", "b B c"), (2, None, "x"), (3, "", ""), (4, "u", "v")], "k int, a string, b string")
    got = evaluate.text_similarities(rows, "k", F.col("a"), F.col("b"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["similarity"] for r in got.collect()} == {1: 2.0 * 2 / 6, 2: 0.0, 3: 0.0, 4: 0.0}
    from weftline.plans.evaluation import evaluate_pairs

    docs = spark.createDataFrame([(k, None if k % 5 == 0 else f"t{k}", "en") for k in range(40)], "doc_id long, text string, lang string").repartition(7)
    assert {r["doc_id"]: r["reference"] for r in evaluate_pairs(docs).collect()} == {k: None if k == 39 or (k + 1) % 5 == 0 else f"t{k + 1}" for k in range(40)}
