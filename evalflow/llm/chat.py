"""Preference formatting of conversation pairs, DataFrame functions only.

The longest common prefix of turns (same role and text) of the chosen and
the rejected conversation is rendered once, as the prompt; what follows in
each is its completion. A completion's mask lists the spans, in characters
of the completion, on which loss is taken: the text and end mark of
assistant turns.

Rows: pair_id, chosen and rejected, arrays of (role, text). A null array is
a conversation without turns; null roles and texts are empty ones. Equal
conversations are all prompt, with empty completions. Other columns go. An
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.llm.shared import step

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def header(turn: F.Column) -> F.Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def render(turns: F.Column) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), t["text"], F.lit(END))), "")


def common_turns(a: F.Column, b: F.Column) -> F.Column:
    """Length of the longest common prefix of two arrays of turns."""
    shorter = F.least(F.size(a), F.size(b))
    differs = lambda i: (i >= shorter) | (F.get(a, i) != F.get(b, i))
    return F.array_min(F.filter(F.sequence(F.lit(0), shorter), differs))


def mask(turns: F.Column) -> F.Column:
    """Array of (start, end) of the assistant turns in ``render(turns)``."""
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(seen, t):
        text = seen["at"] + F.char_length(header(t))
        end = text + F.char_length(t["text"]) + F.lit(len(END))
        own = F.array(F.struct(text.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == ASSISTANT, F.concat(seen["spans"], own)).otherwise(seen["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), spans.alias("spans")), add, lambda x: x["spans"])


def preference(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask)."""
    empty = F.array().cast("array<struct<role:string,text:string>>")
    clean = lambda c: F.transform(F.coalesce(F.col(c), empty), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    p = pairs.select("pair_id", clean("chosen").alias("c"), clean("rejected").alias("r"))
    p = p.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    p = p.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return p.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        mask(F.col("c")).alias("chosen_mask"),
        render(F.col("r")).alias("rejected"),
        mask(F.col("r")).alias("rejected_mask"),
    )


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a row for each conversation, in turn order, ties by role and text. Rows without conv_id belong to none."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return (
        conversations.where("conv_id is not null")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", text("role"), text("text")))).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def pairs_from_conversations(conversations: DataFrame) -> DataFrame:
    """One pair (pair_id, chosen, rejected) for every conversation.

    Of conversations that open with the same turn, the one with the
    smallest id is chosen over each other one. That one itself is chosen
    over a copy whose last assistant turn repeats its first (or is empty,
    if there is one assistant turn only). A conversation meets its group's
    one reference, never the group.
    """
    # Written before they are joined, so that a very common opening is split like any skewed join key.
    t = step(conversation_turns(conversations), "chat-turns")
    turn = F.get("turns", F.lit(0))
    # the role's length first, so that no two turns are written alike
    opening = F.sha2(F.concat(F.char_length(turn["role"]).cast("string"), F.lit(":"), turn["role"], turn["text"]), 256)
    keyed = t.select("conv_id", "turns", opening.alias("opening"))
    lead = step(keyed.groupBy("opening").agg(F.min("conv_id").alias("lead")), "chat-leads")
    turns = F.col("turns")
    spoken = F.filter(F.transform(turns, lambda x, i: F.when(x["role"] == ASSISTANT, i)), lambda i: i.isNotNull())
    first, last = F.array_min(spoken), F.array_max(spoken)
    stale = F.when(first < last, F.get(turns, first)["text"]).otherwise(F.lit(""))
    spoiled = F.transform(turns, lambda x, i: F.struct(x["role"].alias("role"), F.when(i == last, stale).otherwise(x["text"]).alias("text")))
    mine = keyed.join(lead, "opening").select("conv_id", "lead", F.when(F.col("conv_id") == F.col("lead"), spoiled).otherwise(turns).alias("rejected"))
    return mine.join(t.select(F.col("conv_id").alias("lead"), F.col("turns").alias("chosen")), "lead").select(
        F.col("conv_id").alias("pair_id"), "chosen", "rejected"
    )


def mask_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ",")


_SPANS = """array_to_string(list_transform(list_filter(list_transform(range(1, len({x}) + 1), lambda i: {{
  'role': {x}[i].role, 'a': list_sum(list_transform({x}[1:i - 1], lambda t: length(t.role) + length(t.text) + 13)),
  'h': length({x}[i].role) + 5, 't': length({x}[i].text)}}), lambda s: s.role = 'assistant'),
  lambda s: CAST(CAST(coalesce(s.a, 0) + s.h AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(coalesce(s.a, 0) + s.h + s.t + 8 AS BIGINT) AS VARCHAR)), ',')"""
_RENDER = "array_to_string(list_transform({x}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"

#: DuckDB SQL for op6_preference_format.
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, turns, min(conv_id) OVER (PARTITION BY turns[1]) AS lead,
      list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS spoken FROM t),
m AS (
  SELECT k.conv_id AS pair_id, t.turns AS c,
         CASE WHEN k.conv_id = k.lead THEN list_transform(range(1, len(k.turns) + 1), lambda i: {{'role': k.turns[i].role, 'text':
           CASE WHEN i = list_max(spoken) THEN CASE WHEN len(spoken) > 1 THEN k.turns[list_min(spoken)].text ELSE '' END ELSE k.turns[i].text END}})
         ELSE k.turns END AS r
  FROM k JOIN t ON k.lead = t.conv_id),
n AS (SELECT pair_id, c, r, list_min(list_filter(range(0, least(len(c), len(r)) + 1), lambda i: i >= least(len(c), len(r)) OR c[i + 1] <> r[i + 1])) AS n FROM m),
s AS (SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS x, r[n + 1:] AS y FROM n)
SELECT pair_id, CAST(n AS BIGINT) AS n_prompt_turns, {_RENDER.format(x='p')} AS prompt, {_RENDER.format(x='x')} AS chosen, {_SPANS.format(x='x')} AS chosen_mask,
       {_RENDER.format(x='y')} AS rejected, {_SPANS.format(x='y')} AS rejected_mask
FROM s
"""
