"""Preference pairs: the longest common prefix of two conversations as prompt, both endings as masked completions.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (turn, role, text)) by turn; turns that repeat wholly count once, null conv_id goes.

    A null role is "unknown", null text is empty; equal turn numbers are ordered by role, then text.
    """
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def _clean(text: Column) -> Column:
    """Text cannot open or close a turn."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1 |>")


def segments(turns: Column) -> Column:
    """array of (text, loss): headers and turns of other roles carry no loss, answers and their closing mark do."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(OPEN), _clean(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(F.concat(_clean(t["text"]), F.lit(CLOSE)).alias("text"), (t["role"] == TRAINED).alias("loss")),
                F.struct(F.lit("\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )


def text_of(parts: str) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected) of pairs (pair_id, chosen, rejected: arrays of turns).

    Turns are equal if role and text are; the turn number does not count. The longest common prefix is rendered once
    as prompt; chosen and rejected become arrays of (text, loss) whose texts joined are the completion. If one
    conversation is a prefix of the other, or they are equal, its completion is empty. A null conversation is empty.
    """
    bare = lambda c: F.transform(
        F.coalesce(F.col(c), F.array()), lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    )
    rows = pairs.select("pair_id", bare("chosen").alias("c"), bare("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b))
    split = F.array_position(same, False)  # 1-based place of the first difference, 0 for none
    rows = rows.withColumn("n_prompt_turns", F.when(split > 0, split - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    rows = rows.select(
        "pair_id", "n_prompt_turns", segments(F.slice("c", F.lit(1), F.col("n_prompt_turns"))).alias("p"), segments(rest("c")).alias("chosen"), segments(rest("r")).alias("rejected")
    )
    return rows.select("pair_id", "n_prompt_turns", text_of("p").alias("prompt"), "chosen", "rejected")


def last_answer_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from conversations (conv_id, turn, role, text) without preference labels: the conversation is chosen; in
    the rejected one the answer before stands again in place of the last answer, an empty one if there is none.

    A conversation without answers is paired with itself, so both completions are empty.
    """
    rows = conversations(turns).select("conv_id", F.col("turns").alias("chosen"))
    answers = F.filter("chosen", lambda t: t["role"] == TRAINED)
    rows = rows.withColumn("answers", answers)
    n = F.size("answers")
    rows = rows.withColumn("last", F.when(n > 0, F.element_at("answers", -1)))
    rows = rows.withColumn("other", F.when(n > 1, F.element_at("answers", -2)["text"]).otherwise(F.lit("")))
    worse = F.transform(
        "chosen",
        lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(t.eqNullSafe(F.col("last")), F.col("other")).otherwise(t["text"]).alias("text")),
    )
    return rows.select(F.col("conv_id").alias("pair_id"), "chosen", worse.alias("rejected"))


QUERY_SQL = r"""
WITH c AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
             CASE WHEN role = 'assistant' THEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, role DESC, text DESC) END AS back FROM c),
b AS (SELECT o.*, CASE WHEN o.back = 1 THEN coalesce(p.text, '') ELSE o.text END AS worse
      FROM o LEFT JOIN o p ON p.conv_id = o.conv_id AND p.back = 2),
f AS (SELECT conv_id, count(*) AS n, coalesce(min(k) FILTER (WHERE text <> worse), count(*) + 1) AS split FROM b GROUP BY conv_id),
r AS (SELECT b.conv_id, k, split, role = 'assistant' AS loss, regexp_replace(text, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS text,
             regexp_replace(worse, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS worse,
             '<|im_start|>' || regexp_replace(role, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || chr(10) AS head FROM b JOIN f USING (conv_id))
SELECT conv_id, CAST(min(split) - 1 AS INTEGER) AS n_prompt_turns,
  sha256(coalesce(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) FILTER (WHERE k < split), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) FILTER (WHERE k >= split), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(head || worse || '<|im_end|>' || chr(10), '' ORDER BY k) FILTER (WHERE k >= split), '')) AS rejected_sha256,
  CAST(coalesce(sum(length(text) + 10) FILTER (WHERE k >= split AND loss), 0) AS BIGINT) AS chosen_loss_chars,
  CAST(coalesce(sum(length(worse) + 10) FILTER (WHERE k >= split AND loss), 0) AS BIGINT) AS rejected_loss_chars
FROM r GROUP BY conv_id
"""
