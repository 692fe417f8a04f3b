"""Chat formatting by prefix-target expansion, in native expressions.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its reply
is under the loss mask. Turns behind the last reply (or all, if there is no reply) become one example
without a reply, so the output holds every turn.

A turn is written as  <s>[TURN]role\\ntext</s>. Control strings inside a role or a text get a backslash
behind their first character ("</s>" becomes "<\\/s>", "<\\/s>" becomes "<\\\\/s>"), line feeds inside a role
are written as "\\n"; both are undone exactly when the output is read back, so no text can start or end a turn.

Turns are ordered by turn (null first), then role and text; repeated rows stay. A null text or role is
empty; a null conv_id is one conversation. An empty table gives no examples. A conversation is the unit of
work, as its examples need its earlier turns; their text grows with its number of replies.

Texts of any length are kept whole. Extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template, and further control strings of common templates, which are escaped too.
TURN_START, ROLE_END, TURN_END = "<s>[TURN]", "\n", "</s>"
CONTROL = r"([<\[])(\\*)(/?s>|/?TURN\]|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?TURN\]|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>)"
REPLY_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """text with one backslash more inside each control string."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    return unescaped(_unslash(role))


def _unslash(role: Column) -> Column:
    pieces = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(pieces, "\\")


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", reply_role: str = REPLY_ROLE) -> DataFrame:
    """One row per example: conv_id, example (0, 1, ...), formatted, reply_start, reply_end (code points of the reply within formatted; null without a reply)."""
    empty = F.lit("")
    rows = turns.select(
        turns[conv_col].alias("conv_id"),
        F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col], empty).alias("role"), F.coalesce(turns[text_col], empty).alias("text")).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = convs.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit(TURN_START), _role(t["role"]), F.lit(ROLE_END))).alias("heads"),
        F.transform("ts", lambda t: escaped(t["text"])).alias("bodies"),
        F.filter(F.transform("ts", lambda t, i: F.when(t["role"] == reply_role, i)), lambda i: i.isNotNull()).alias("replies"),
    )
    convs = convs.select("conv_id", "heads", "bodies", "replies", F.transform(F.arrays_zip("heads", "bodies"), lambda x: F.concat(x["heads"], x["bodies"], F.lit(TURN_END))).alias("parts"))
    last = F.coalesce(F.array_max("replies"), F.lit(-1))
    ends = F.when(last + 1 < F.size("parts"), F.concat(F.col("replies"), F.array(F.lit(-1)))).otherwise(F.col("replies"))
    each = convs.select("conv_id", "heads", "bodies", "parts", F.posexplode(ends).alias("example", "i"))
    has_reply = F.col("i") >= 0
    before = F.when(has_reply, F.concat(_joined(F.slice("parts", F.lit(1), F.greatest("i", F.lit(0)))), F.element_at("heads", F.col("i") + 1))).otherwise(_joined(F.col("parts")))
    each = each.select("conv_id", "example", before.alias("before"), F.when(has_reply, F.element_at("bodies", F.col("i") + 1)).alias("reply"))
    start = F.char_length("before")
    return each.select(
        "conv_id",
        "example",
        F.concat("before", F.when(F.col("reply").isNull(), "").otherwise(F.concat("reply", F.lit(TURN_END)))).alias("formatted"),
        F.when(F.col("reply").isNotNull(), start).alias("reply_start"),
        (start + F.char_length("reply")).alias("reply_end"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted example."""
    whole = F.filter(F.split(formatted, "</s>", -1), lambda p: p != "")
    cut = F.lit(len(TURN_START) + 1)

    def turn(p: Column) -> Column:
        end = F.locate(ROLE_END, p)
        return F.struct(_unrole(F.substring(p, cut, end - cut)).alias("role"), unescaped(F.substring(p, end + 1, F.char_length(p))).alias("text"))

    return F.transform(whole, turn)


def digests(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_conversations' rows.

    The last example of a conversation holds all its turns.
    """
    reply = unescaped(F.substring("formatted", F.col("reply_start") + 1, F.col("reply_end") - F.col("reply_start")))
    each = examples.select("conv_id", "example", "formatted", F.coalesce(reply, F.lit("")).alias("reply"))
    by = each.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "").alias("loss"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    by = by.select("*", read_turns(F.col("whole")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
