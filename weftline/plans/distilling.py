"""Queries of distilled and synthetic examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocab import BODY_SHAPES, OCCASIONS, STYLES
from weftline.operators import distill
from weftline.plans.dialogue_tools import _CLEAN, _EX, _QUALITY, _WORDS, _examples, _topic_sql
from weftline.plans.ingest import _list
from weftline.plans.registry import query

TARGET, PER_FAMILY = 24, 1
_CLASSED = f"""{_EX}, {_QUALITY}, w as (select conv_id, unnest(pt) as t from q), df as (select t, count(*) as c from w group by 1), m as (select conv_id, avg(c) as mean_df from w join df using (t) group by 1), v as (select count(*) as n from df),
scored as (select conv_id, prompt, answer, nw, not (mixed or nw > 280 or echo >= 0.65) as clean, case when not mixed and nw <= 280 and echo < 0.65 then 4.0::double else 0.0::double end + least(div, 1.0::double) * 2.0::double + case when nw between 45 and 190 then 1.5::double else 0.0::double end
  - greatest(0, nw - 220) / 60.0::double - echo::double * 2.0::double - coalesce(mean_df / greatest(v.n, 1) * 2.0::double, 0.0::double) as score, {_topic_sql()} as topic,
  case when regexp_matches(lower(prompt), '^(làm thế nào|cách)') then 'how_to' when regexp_matches(lower(prompt), '^tôi') then 'first_person' when regexp_matches(lower(prompt), '^(bạn có thể|có thể)') then 'request' when regexp_matches(lower(prompt), '^(điều gì|gì|những)') then 'definition' else 'other' end as style,
  case when nw <= 80 then 'short' when nw <= 180 then 'medium' else 'long' end as length_class, case when len({_WORDS.format('prompt')}) = 0 then lower(prompt) else array_to_string({_WORDS.format('prompt')}[1:3], ' ') end as family,
  sha256(prompt || chr(31) || answer) as sig from q left join m using (conv_id), v)"""
#: Water filling, one pass a row: quotas of the open topics by the square root of their counts; topics without more than their quota are closed.
_FILLED = f"""counts as (select topic, count(*) as n from capped group by 1),
fill as (select 0 as pass, topic, n, {TARGET}::bigint as remaining, null::bigint as given, false as ended from counts
  union all select pass + 1, topic, n, remaining - coalesce(sum(case when given is null and quota >= n then n end) over (), 0), case when given is not null then given when quota >= n then n when not any_full then quota end, ended or not any_full
  from (select *, coalesce(bool_or(given is null and quota >= n) over (), false) as any_full from (select *, case when given is null then base + case when row_number() over (partition by given is null order by raw - base desc, topic desc) <= remaining - sum(case when given is null then base end) over () then 1 else 0 end end as quota
    from (select *, floor(raw)::bigint as base from (select *, remaining * sqrt(n) / sum(case when given is null then sqrt(n) end) over () as raw from fill where not ended and given is null or not ended)))) where pass < 20),
quotas as (select topic, max(given) as quota from fill group by 1)"""


@query(f"""with recursive {_CLASSED}, kept as (select * from scored where clean qualify row_number() over (partition by sig order by conv_id) = 1),
capped as (select * from kept qualify row_number() over (partition by family order by score desc, abs(nw - 120), sig) <= {PER_FAMILY}), {_FILLED},
strata as (select topic, style, length_class, row_number() over (order by n, topic, style, length_class) as stratum from (select topic, style, length_class, count(*) as n from capped group by 1, 2, 3)),
turns as (select *, row_number() over (partition by stratum order by score desc, sig) as round from capped join strata using (topic, style, length_class)),
taken as (select *, row_number() over (partition by topic order by round, stratum) as turn from turns)
select conv_id, topic, style, length_class, family, round, stratum from taken join quotas using (topic) where turn <= quota""")
def distilled_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = distill.select_distilled(_examples(spark, sf_dir).select("conv_id", "prompt", "answer"), TARGET, PER_FAMILY, key="conv_id")
    return got.select("conv_id", "topic", "style", "length_class", "family", F.col("round").cast("bigint").alias("round"), F.col("stratum").cast("bigint").alias("stratum"))


TEMPLATES = {
    "ask_missing_info": [("user", "I like the {style} style, what shall I wear?"), ("assistant", "Which occasion, and which budget? {hint}")],
    "polite_decline": [("user", "Make up some outfits for {occasion} below {budget}k."), ("assistant", "I can't make up products for {occasion}, but I can search.")],
    "multi_turn": [("user", "A plain wardrobe for work."), ("assistant", "Start with few things. {hint}"), ("user", "And for the weekend?"), ("assistant", "Keep the colors, take softer pieces.")],
    "tool_calling": [("user", "Find something for {occasion}, {style}."), ("assistant", "<tool_call>{call}</tool_call>")],
    "edge_case": [("user", "Only {budget}k for {occasion}."), ("assistant", "One good piece, for a {body_shape} figure.")],
}
SUFFIXES = ("Tell me more if you like.", "I can narrow it down.", "Shall I go on?")
SYNTHETIC = {"ask_missing_info": 40, "polite_decline": 200, "multi_turn": 90, "tool_calling": 60, "edge_case": 110}


def _filled(text: str) -> str:
    parts = {"style": f"{_list(STYLES)}[cursor % {len(STYLES)} + 1]", "occasion": f"{_list(OCCASIONS)}[cursor % {len(OCCASIONS)} + 1]", "body_shape": f"{_list(BODY_SHAPES)}[cursor % {len(BODY_SHAPES)} + 1]", "budget": "(500 + cursor % 5 * 100)::varchar", "hint": "hint"}
    call = """'{"name": "search_outfits", "arguments": {"occasion": "' || """ + parts["occasion"] + """ || '", "style": "' || """ + parts["style"] + """ || '", "body_shape": "' || """ + parts["body_shape"] + """ || '", "skin_tone": "' || ['warm','neutral','cool'][cursor % 3 + 1] || '", "price_max": ' || (700000 + cursor % 3 * 200000) || ', "exclude_colors": ["' || ['cam','hồng_neon'][cursor % 2 + 1] || '"]}}'"""
    out = "'" + text.replace("'", "''") + "'"
    for name, value in {**parts, "call": call}.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


def _before(task: str) -> int:
    tasks = list(SYNTHETIC)
    return sum(SYNTHETIC[t] for t in tasks[: tasks.index(task)])


_CHATS = " union all ".join(f"select {_before(t)} + i as cursor, '{t}' as task_type, {' || chr(30) || '.join(f'''chr(29) || '{r}' || {_filled(x)}''' for r, x in turns)} as chat from (select i, hint, {_before(t)} + i as cursor from range({SYNTHETIC[t]}) t(i) join hints on slot = ({_before(t)} + i) % (select count(*) from hints))" for t, turns in TEMPLATES.items())
_REPEATED = "case when nth <= 1 then '' else ' ' || " + _list(SUFFIXES) + f"[(nth - 1) % {len(SUFFIXES)} + 1] || case when nth - 1 >= {len(SUFFIXES)} then ' (' || ((nth - 1) // {len(SUFFIXES)} + 1) || ')' else '' end end"


@query(f"""with {_EX}, f as (select conv_id, regexp_extract({_CLEAN.format('answer')}, '^(.*?[.!?]) ', 1) as fs, answer from ex), h as (select conv_id, case when fs = '' then {_CLEAN.format('answer')} else fs end as s from f),
hints as (select case when length(s) > 500 then rtrim(s[1:499]) || '…' else s end as hint, row_number() over (order by sha256('42:' || conv_id), conv_id::varchar) - 1 as slot from h), chats as ({_CHATS}),
n as (select *, row_number() over (partition by chat order by cursor) as nth from chats)
select cursor, task_type, sha256(replace(replace(case when nth = 1 then chat else trim(regexp_replace(chat, '\\s+$', '')) || {_REPEATED} end, chr(29), ''), chr(30), '|')) as digest from n""")
def synthetic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = distill.synthesize(_examples(spark, sf_dir), TEMPLATES, SYNTHETIC, SUFFIXES, key="conv_id")
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["content"])), "|")
    return made.select("cursor", "task_type", F.sha2(flat, 256).alias("digest"))
