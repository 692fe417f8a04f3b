"""Queries of packaged chat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import packaging
from weftline.plans.registry import query
from weftline.sources.tables import table

FRACTION, MOST = 0.1, 12
_JSON = """'[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' order by turn) || ']'"""
_CHATS = f"""chats as (select conv_id, {_JSON} as m from conversations where text is not null and role is not null group by 1),
grounded as (select conv_id, conv_id as pos, m, case when conv_id % 4 > 0 then 'task' || (conv_id % 4) end as task, 'grounded' as source, 0 as s from chats where conv_id % 3 <> 1), known as (select conv_id, conv_id, m, 'knowledge', 'known', 1 from chats where conv_id % 2 = 0),
merged as (select * from (select * from grounded union all select * from known) qualify row_number() over (partition by m order by s, pos) = 1),
named as (select *, coalesce(task, 'unknown') as t, sha256('42:' || sha256(m)) as h from merged), sizes as (select t, count(*) as n from named group by 1), w as (select *, case when n > 1 then greatest(1, floor(n * {FRACTION}::double)::bigint) else floor(n * {FRACTION}::double)::bigint end as want from sizes),
caps as (select *, least(want, greatest(0, n - 1)) as cap from w), q as (select *, greatest(0, least(cap, {MOST} - coalesce(sum(cap) over (order by t rows between unbounded preceding and 1 preceding), 0))) as quota from caps)"""


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two sources of chats, of which a third is in both."""
    turns = table(spark, sf_dir, "conversations").where("text is not null and role is not null")
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    k = F.col("conv_id")
    grounded = chats.where(k % 3 != 1).select("*", F.when(k % 4 > 0, F.concat(F.lit("task"), (k % 4).cast("string"))).alias("task_type"), F.lit("grounded").alias("source_set"), F.format_string("SC_%d", F.floor(k / 2)).alias("scenario_id"))
    known = chats.where(k % 2 == 0).select("*", F.lit("knowledge").alias("task_type"), F.lit("known").alias("source_set"))
    return grounded, known


@query(f"with {_CHATS} select conv_id, t as task, source, row_number() over (partition by t order by h) <= quota as is_eval from named join q using (t)")
def packaged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packaging.split_rows(packaging.merged_rows(*_rows(spark, sf_dir), "conv_id"), FRACTION, MOST)
    return rows.select("conv_id", F.coalesce("task_type", F.lit("unknown")).alias("task"), F.col("source_set").alias("source"), "is_eval")


@query(f"""with {_CHATS}, turns as (select conv_id, count(*) as n from conversations where text is not null and role is not null group by 1)
select count(*) as total_rows, count(distinct m) as unique_message_rows, count(*) - count(distinct conv_id // 2) as duplicate_scenario_ids, round_even(avg(n), 2) as avg_turns, max(n)::int as max_turns from grounded join turns using (conv_id)""")
def chat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packaging.report(_rows(spark, sf_dir)[0]).select("total_rows", "unique_message_rows", "duplicate_scenario_ids", "avg_turns", "max_turns")
