"""Perspectives of a dialogue with several speakers, in DataFrame operations alone.

For every participant the dialogue is rendered once with that speaker as the assistant and all
others as named users; only the assistant's words, and the mark that ends them, are trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.ordering import running_sum
from marginalia.llm.registry import query, table

SHARED = ("system",)  # roles that instruct all and are nobody's perspective
BEGIN, END = "<|begin|>", "<|end|>"
NOBODY = "unknown"


def _plain(text: Column) -> Column:
    """Text that cannot be read as one of the marks."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def render_perspectives(turns: DataFrame, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """One row per perspective and turn of ``turns`` (conv_id, turn, role, text; other columns are ignored):
    conv_id, perspective, turn, speaker, role (assistant, user or system), rendered, start, end (where the piece stands in the
    rendered dialogue, in characters), mask_start, mask_end (what is trained on; null unless the assistant speaks).

    The pieces of a perspective in order of start are its dialogue. Turns are ordered by number (null first), speaker and text;
    repeated rows are turns each. A null role is a speaker of the name "unknown", null text is empty, a null conversation is one
    of its own. A dialogue of shared roles alone has no perspective. An empty table gives no rows.

    A dialogue is never gathered into a row: pieces are placed by running sums over ranges, so one with a third of all turns is
    many tasks. There are as many rows as turns times speakers of their dialogue, for every speaker hears all."""
    said = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(NOBODY)).alias("speaker"), _plain(F.col("text")).alias("said")
    )
    heard = said.filter(~F.col("speaker").isin(*shared)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(heard, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = (
        F.when(F.col("speaker").isin(*shared), F.lit("system"))
        .when(F.col("speaker") == F.col("perspective"), F.lit("assistant"))
        .otherwise(F.lit("user"))
    )
    rows = rows.withColumn("role", role)
    name = F.when(F.col("role") == "user", F.concat(F.lit(" name="), _plain(F.col("speaker")))).otherwise(F.lit(""))
    rows = rows.withColumn("_head", F.concat(F.lit(BEGIN), F.col("role"), name, F.lit("\n")))
    rows = rows.withColumn("rendered", F.concat("_head", "said", F.lit(END + "\n"))).withColumn(
        "_size", F.length("rendered").cast("bigint")
    )
    placed = running_sum(rows, ["conv_id", "perspective"], ["turn", "speaker", "said"], "_size", "end")
    start = F.col("end") - F.col("_size")
    trained = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "role", "rendered", start.alias("start"), "end",
        F.when(trained, start + F.length("_head")).alias("mask_start"),
        F.when(trained, F.col("end") - 1).alias("mask_end"),
    )


CHAT_SQL = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '{NOBODY}') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
heard AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
roles AS (SELECT s.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN heard h ON s.conv_id IS NOT DISTINCT FROM h.conv_id),
heads AS (SELECT *, '{BEGIN}' || role || CASE WHEN role = 'user' THEN ' name=' || replace(speaker, '<|', '< |') ELSE '' END || chr(10) AS head FROM roles),
pieces AS (SELECT *, head || said || '{END}' || chr(10) AS rendered FROM heads),
placed AS (SELECT *, (sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said
    ROWS UNBOUNDED PRECEDING))::BIGINT AS fin FROM pieces)
SELECT conv_id, perspective, turn, speaker, role, rendered, fin - length(rendered) AS start, fin AS "end",
  CASE WHEN role = 'assistant' THEN fin - length(rendered) + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN fin - 1 END AS mask_end
FROM placed"""


@query("op3_rotate_perspectives", CHAT_SQL)
def op3_rotate_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_perspectives(table(spark, sf_dir, "conversations"))
