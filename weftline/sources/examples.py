"""Reading chat examples from folders of files whose formats and fields differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the fields that may hold a question, an answer, and their translated forms, the preferred first
QUESTIONS = ("question", "instruction", "prompt", "input", "user")
ANSWERS = ("answer", "response", "output", "completion", "assistant")
TRANSLATED = ("_vi", "_translated")
ROWS_FIELD = "data"
_MAP = "map<string,string>"


def _objects(text: Column) -> Column:
    """array<map>: the objects of a JSON text: of a list, of a list under `data`, or the one object; empty for anything else."""
    value = F.try_parse_json(text)
    inner = F.try_variant_get(value, f"$.{ROWS_FIELD}", "array<variant>")
    many = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), inner, F.when(F.schema_of_variant(value).startswith("OBJECT"), F.array(value)))
    maps = F.transform(many, lambda v: F.transform_values(v.try_cast("map<string,variant>"), lambda _, x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))))
    return F.coalesce(F.filter(maps, lambda m: m.isNotNull()), F.array().cast(f"array<{_MAP}>"))


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line, fields, bad) of all .csv, .jsonl, .json and .parquet files below a folder; fields: map<string, string>.

    Fields are those that a row has, so files may differ. A line of a .jsonl file, or a .json file, that isn't JSON has
    fields null and its text in bad. A .json file is a list of objects, an object with such a list under `data`, or one
    object; it is one row of one task until it is taken apart, as is a .csv file's header. A file's rows keep their line.
    """

    def at(suffix: str):
        return {"recursiveFileLookup": True, "pathGlobFilter": f"*.{suffix}"}

    name = F.col("_metadata.file_path").alias("file")
    none = F.lit(None).cast("string")
    lines = spark.read.text(folder, **at("jsonl")).select(name, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value").where("trim(value) <> ''")
    one = F.get(_objects(F.col("value")), F.lit(0))
    jsonl = lines.select("file", "line", one.alias("fields"), F.when(one.isNull(), F.col("value")).alias("bad"))
    whole = spark.read.text(folder, wholetext=True, **at("json")).select(name, "value", _objects(F.col("value")).alias("rows"))
    json = whole.select("file", F.posexplode("rows").alias("line", "fields")).select("file", F.col("line").cast("bigint").alias("line"), "fields", none.alias("bad"))
    broken = whole.where(F.try_parse_json("value").isNull() & (F.trim("value") != "")).select("file", F.lit(0).cast("bigint").alias("line"), F.lit(None).cast(_MAP).alias("fields"), F.col("value").alias("bad"))
    out = jsonl.unionByName(json).unionByName(broken)
    for part in (_csv(spark, folder), _parquet(spark, folder, at("parquet"))):
        out = out if part is None else out.unionByName(part)
    return out


#: Columns that a .csv file may have.
CELLS = 64


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of .csv files, each told by its own header; quoted cells may hold line feeds."""
    names = [f"c{k}" for k in range(CELLS)]
    schema = ", ".join(f"{n} string" for n in names)
    rows = spark.read.schema(schema).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.array(*names).alias("cells"))
    # with multiLine a file is one task, so its header has its least number
    header = rows.groupBy("file").agg(F.min_by("cells", "line").alias("header"), F.min("line").alias("first"))
    both = rows.join(header, "file").where("line > first")
    pairs = F.filter(F.arrays_zip(F.col("header").alias("k"), F.col("cells").alias("v")), lambda p: p["k"].isNotNull())
    return both.select("file", "line", F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p["k"]).alias("k"), p["v"].alias("v")))).alias("fields"), F.lit(None).cast("string").alias("bad"))


def _parquet(spark: SparkSession, folder: str, options: dict) -> DataFrame | None:
    try:
        rows = spark.read.options(**options).option("mergeSchema", True).parquet(folder)
    except Exception as e:  # a folder without such files has no schema
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), (F.col(c).cast("string") if t in ("string", "int", "bigint", "double", "boolean") else F.to_json(F.struct(c))).alias("v")) for c, t in rows.dtypes])
    fields = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), fields.alias("fields"), F.lit(None).cast("string").alias("bad"))


def _first(fields: Column, names: tuple[str, ...], translated: bool) -> Column:
    order = [n + s for s in TRANSLATED for n in names] + list(names) if translated else list(names)
    found = [F.trim(F.try_element_at(fields, F.lit(n))) for n in order]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def examples(rows: DataFrame, prefer_translated: bool = True) -> DataFrame:
    """(file, line, prompt, answer) of rows that have both: of messages (a JSON list of role and content) the first user and assistant turn, else the first field that is there."""
    turns = F.from_json(F.try_element_at("fields", F.lit("messages")), "array<struct<role:string,content:string>>")
    of = lambda role: F.get(F.transform(F.filter(turns, lambda m: m["role"] == role), lambda m: F.trim(m["content"])), F.lit(0))
    prompt = F.coalesce(of("user"), _first(F.col("fields"), QUESTIONS, prefer_translated))
    answer = F.coalesce(of("assistant"), _first(F.col("fields"), ANSWERS, prefer_translated))
    return rows.where("fields is not null").select("file", "line", prompt.alias("prompt"), answer.alias("answer")).where("coalesce(prompt, '') <> '' and coalesce(answer, '') <> ''")
