"""Multi-party chat formatting with perspective rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Roles that set the scene and don't speak: shown to each perspective, never its assistant.
CONTEXT_ROLES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What marks begin with, and what it becomes where a text or name holds it, so that neither can open or close a turn.
MARK, SPELLED = "<|im_", "<| im_"


def rotate_perspectives(turns: DataFrame, context_roles=CONTEXT_ROLES) -> DataFrame:
    """Render ``turns(conv_id, turn, role, text)`` once for each participant of the conversation.

    Returns a row per turn and perspective: ``conv_id, perspective, turn, shown_as, name, segment,
    mask_from, mask_to``. ``segment`` is the rendered turn; a perspective's dialogue is its segments in the
    order of ``turn, name, segment``. The perspective's own turns are shown as ``assistant`` and their
    text and end mark are to be learned: ``mask_from`` and ``mask_to`` bound them in code points. Other
    speakers are shown as ``user`` with their name and an empty mask (both bounds 0). Context roles
    keep their role and aren't perspectives. A null role is the speaker ``unknown``; a null text
    is empty; a null turn sorts first; rows with a null ``conv_id`` form one conversation. Repeated rows are
    repeated turns. A conversation with context alone has no participant and no rows. Marks inside a text or a name are spelled ``<| im_``,
    and control characters of a name are shown as a blank, so that what a speaker says can't forge a turn.

    One conversation may hold a third of all rows, so no task gathers one: participants are found by a
    combining distinct, and turns meet them in a join that can split a hot conversation.
    """
    named = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("name"), F.coalesce("text", F.lit("")).alias("text")
    )
    context = F.col("name").isin(*context_roles) if context_roles else F.lit(False)
    people = named.where(~context).select(F.col("conv_id").alias("_conv"), F.col("name").alias("perspective")).distinct()
    people = materialize(people, "participants")
    seen = named.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
    shown = F.when(context, F.col("name")).when(F.col("name") == F.col("perspective"), "assistant").otherwise("user")
    plain = lambda c: F.replace(c, F.lit(MARK), F.lit(SPELLED))
    title = plain(F.regexp_replace("name", r"[\x00-\x1F\x7F]+", " "))
    head = F.concat(F.lit(OPEN), F.col("shown_as"), F.when(F.col("shown_as") == "user", F.concat(F.lit(" name="), title)).otherwise(""), F.lit("\n"))
    learned = F.col("shown_as") == "assistant"
    return (
        seen.withColumn("shown_as", shown)
        .withColumn("_head", head)
        .withColumn("segment", F.concat("_head", plain(F.col("text")), F.lit(CLOSE)))
        .select(
            "conv_id",
            "perspective",
            "turn",
            "shown_as",
            "name",
            "segment",
            F.when(learned, F.length("_head")).otherwise(0).cast("long").alias("mask_from"),
            F.when(learned, F.length("segment") - 1).otherwise(0).cast("long").alias("mask_to"),
        )
    )


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP1_SQL = r"""
WITH n AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, name AS perspective FROM n WHERE name <> 'system'),
s AS (SELECT n.*, p.perspective,
        CASE WHEN name = 'system' THEN name WHEN name = perspective THEN 'assistant' ELSE 'user' END AS shown_as
      FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || shown_as || CASE WHEN shown_as = 'user' THEN ' name=' || replace(regexp_replace(name, '[\x00-\x1F\x7F]+', ' ', 'g'), '<|im_', '<| im_') ELSE '' END || chr(10) AS head FROM s),
g AS (SELECT *, head || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS segment FROM h)
SELECT conv_id, perspective, turn, shown_as, name, segment,
       CAST(CASE WHEN shown_as = 'assistant' THEN length(head) ELSE 0 END AS BIGINT) AS mask_from,
       CAST(CASE WHEN shown_as = 'assistant' THEN length(segment) - 1 ELSE 0 END AS BIGINT) AS mask_to
FROM g
"""
