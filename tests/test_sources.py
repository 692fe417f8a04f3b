"""Readers of differing files, and stores."""

import json

import pytest

from weftline.sources import examples, stores


def test_four_formats_give_the_same_rows(spark, tmp_path):
    rows = [{"question": f"câu hỏi {k}", "answer": f"trả lời, \"{k}\"", "extra": str(k)} for k in range(3)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\nnot json\n\n")
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "under.json").write_text(json.dumps({"data": rows}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "t.csv").write_text('answer,question\n' + "".join(f'"trả lời, ""{k}""",câu hỏi {k}\n' for k in range(3)))
    (tmp_path / "m.csv").write_text('instruction_vi,instruction,output\n"hai\ndòng",two lines,x\n')
    spark.createDataFrame([(r["question"], r["answer"]) for r in rows], "prompt string, response string").coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "chat.jsonl").write_text(json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": " u "}, {"role": "assistant", "content": "v"}]}) + '\n{"question": "q"}\n[1]\n')
    found = examples.read_rows(spark, str(tmp_path))
    assert sorted(r["bad"] for r in found.where("bad is not null").collect()) == ["[1]", "not json", "{"]
    by = {}
    for r in examples.examples(found).collect():
        by.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["line"], r["prompt"], r["answer"]))
    want = [(r["question"], r["answer"]) for r in rows]
    parquet = next(k for k in by if k.startswith("part-"))
    for name in ("x.jsonl", "list.json", "under.json", "t.csv", parquet):
        assert [x[1:] for x in sorted(by[name])] == want, name
    assert [x[1:] for x in by["chat.jsonl"]] == [("u", "v")] and [x[1:] for x in by["m.csv"]] == [("hai\ndòng", "x")]
    assert [r["prompt"] for r in examples.examples(found, prefer_translated=False).where("answer = 'x'").collect()] == ["two lines"]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "edges")
    assert stores.read_edges(spark, path).count() == 0
    edges = spark.createDataFrame([("b", "c", "top", "bag", 0.5), ("a", "c", "top", "bag", 0.25)], stores.EDGE_SCHEMA)
    stores.write_edges(edges, path)
    stores.write_edges(edges, path)
    assert sorted(map(tuple, stores.read_edges(spark, path).collect())) == sorted(map(tuple, edges.collect()))
    edges.drop("weight").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="lack columns: weight"):
        stores.read_edges(spark, str(tmp_path / "bad"))
    records = spark.createDataFrame([("OF_1", ["a", "b"], ["đỏ"], 0.5)], "outfit_id string, item_ids array<string>, colors array<string>, score double")
    stores.write_outfits(records, str(tmp_path / "outfits"))
    assert stores.read_outfits(spark, str(tmp_path / "outfits")).drop("schema_version").collect() == records.collect()


def test_tags_are_written_back_if_full(spark):
    schema = "item_id string, body_shapes array<string>, seasons array<string>, note string"
    catalog = spark.createDataFrame([("a", ["pear"], [], "old"), ("b", [], [], ""), ("c", [], [], None)], schema)
    tagged = spark.createDataFrame([("a", ["apple"], ["winter"], "new"), ("b", ["apple"], [], "new"), ("c", ["pear"], ["rainy"], " "), ("z", ["pear"], ["rainy"], "x")], schema)
    got = {r["item_id"]: (r["body_shapes"], r["note"]) for r in stores.with_tags(catalog, tagged).collect()}
    assert got == {"a": (["apple"], "new"), "b": ([], ""), "c": ([], None)}
    items = spark.createDataFrame([("a", "top", "men", "formal", 5, None, "u")], "item_id string, category string, gender string, formality string, price int, in_stock boolean, url string")
    assert json.loads(stores.item_payload(items).first()["payload"]) == {"item_id": "a", "category": "top", "gender": "men", "formality": "formal", "price_vnd": 5, "in_stock": False, "has_vn_store": True}
