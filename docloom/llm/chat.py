r"""Chat formatting by multi-party perspective rotation (DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users; only the assistant's
own turns are trained on.  System turns are instructions that all perspectives
share; they are never a perspective themselves.

The result has a row per conversation, perspective and turn: whatever order
the rows are kept in, a dialogue is the concatenation of `rendered` by turn.
So no conversation is ever gathered in one task or row, however long it is;
turns meet the participants of their conversation by one join, in which a hot
conversation can be split.

Defined results: a null conv_id is a conversation of its own; a null role is
the speaker "unknown"; a null text is empty; a null turn stays null; repeated
rows stay repeated; a conversation of system turns only has no perspective and
gives no row; an empty table gives an empty result.  "<|" within a text or a
name becomes "< |", so that no turn can forge a delimiter.  Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, name, rendered, mask_start, mask_end, trained.

    `mask_start` and `mask_end` bound, in code points of `rendered`, what the
    loss is taken of (equal: nothing).
    """
    t = turns.select(F.col("conv_id").alias("conv_id"), "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    who = t.where(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    x = t.join(who, t["conv_id"].eqNullSafe(who["c"])).drop("c")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    x = x.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", _safe(F.col("speaker"))))
    head = F.concat(F.lit(START), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    x = x.withColumn("head", head).withColumn("rendered", F.concat("head", _safe(F.col("text")), F.lit(END)))
    return x.select(
        "conv_id", "perspective", "turn", "speaker", "role", "name", "rendered",
        F.when(own, F.char_length("head")).otherwise(0).cast("int").alias("mask_start"),
        F.when(own, F.char_length("rendered") - 1).otherwise(0).cast("int").alias("mask_end"),
        own.alias("trained"),
    )


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
x AS (SELECT t.*, who.perspective, t.speaker = who.perspective AS own,
        CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = who.perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
y AS (SELECT *, CASE WHEN role = 'user' THEN replace(speaker, '<|', '< |') END AS name FROM x),
z AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM y),
r AS (SELECT *, head || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS rendered FROM z)
SELECT conv_id, perspective, turn, speaker, role, name, rendered,
       (CASE WHEN own THEN length(head) ELSE 0 END)::INTEGER AS mask_start,
       (CASE WHEN own THEN length(rendered) - 1 ELSE 0 END)::INTEGER AS mask_end,
       own AS trained
FROM r
"""
