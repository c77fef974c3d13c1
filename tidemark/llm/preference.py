"""Preference formatting: one shared prompt, two masked completions for every pair of conversations.

The prompt is the longest common turn prefix (same role and same text, null equals null) of the chosen and
the rejected conversation, rendered once.  Each completion is the rendered rest of its side.  A mask lists the
character spans of a completion that a trainer may score: the texts and end marks of assistant turns.

Edge cases, all defined: a null text is empty and a null role is ``unknown`` when rendered; turns are ordered by
(turn, role, text) with nulls first, so repeated rows and ties have one order; a pair with one side missing keeps
its row with ``n_common`` 0 and an empty completion for the missing side; when one side is a prefix of the other its
completion is empty; rows whose pair is null are left out; an empty table gives an empty result; further input
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    piece = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit(CLOSE), F.coalesce(t["text"], F.lit("")), F.lit(END))
    return F.array_join(F.transform(turns, piece), "")


def _mask(turns: Column) -> Column:
    """``start:end`` spans, comma-joined, by a fold that carries the length rendered so far."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(F.coalesce(t["role"], F.lit("unknown"))) + len(OPEN + CLOSE)
        end = begin + F.length(F.coalesce(t["text"], F.lit(""))) + len(END)
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        keep = F.coalesce(t["role"], F.lit("unknown")) == "assistant"
        return F.struct(end.cast("long").alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """``turns(pair_id, chosen boolean, conv_id, turn, role, text)`` -> one row per pair.

    One shuffle, by pair; everything after it is a projection over the pair's own turns."""
    item = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"), F.col("conv_id").alias("conv_id"))
    sides = turns.where("pair_id IS NOT NULL AND chosen IS NOT NULL").groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("chosen"), item))).alias("c"),
        F.sort_array(F.collect_list(F.when(~F.col("chosen"), item))).alias("r"),
    )
    same = lambda i: F.col("c")[i - 1]["role"].eqNullSafe(F.col("r")[i - 1]["role"]) & F.col("c")[i - 1]["text"].eqNullSafe(F.col("r")[i - 1]["text"])
    shorter = F.least(F.size("c"), F.size("r"))
    common = F.when(shorter < 1, F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & same(i), i).otherwise(n))
    )
    rest = lambda side: F.expr(f"slice({side}, n + 1, size({side}))")
    return sides.withColumn("n", common).select(
        "pair_id",
        F.array_min(F.transform("c", lambda t: t["conv_id"])).alias("chosen_id"),
        F.array_min(F.transform("r", lambda t: t["conv_id"])).alias("rejected_id"),
        F.col("n").cast("long").alias("n_common"),
        F.when(F.size("c") > 0, _render(F.expr("slice(c, 1, n)"))).otherwise(F.lit("")).alias("prompt"),
        _render(rest("c")).alias("chosen_completion"),
        _render(rest("r")).alias("rejected_completion"),
        _mask(rest("c")).alias("chosen_mask"),
        _mask(rest("r")).alias("rejected_mask"),
    )


def op1_preference_format(spark, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) of the whole table form pair k."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference_pairs(
        conv.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "conv_id", "turn", "role", "text")
    )


ORACLE = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT pair_id, min(conv_id) FILTER (chosen) AS chosen_id, min(conv_id) FILTER (NOT chosen) AS rejected_id,
             greatest(coalesce(max(i) FILTER (chosen), 0), coalesce(max(i) FILTER (NOT chosen), 0)) AS longest
      FROM t GROUP BY pair_id),
bad AS (
  SELECT pair_id, min(i) AS i FROM (
    SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.i, r.i) AS i,
           c.i IS NOT NULL AND r.i IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
    FROM (SELECT * FROM t WHERE chosen) c FULL JOIN (SELECT * FROM t WHERE NOT chosen) r ON c.pair_id = r.pair_id AND c.i = r.i)
  WHERE NOT same GROUP BY pair_id),
n AS (SELECT p.*, coalesce(bad.i - 1, p.longest) AS n FROM p LEFT JOIN bad USING (pair_id)),
piece AS (
  SELECT t.pair_id, t.chosen, t.i, n.n, coalesce(t.role, 'unknown') AS role,
         '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10) AS piece
  FROM t JOIN n USING (pair_id)),
placed AS (
  SELECT *, sum(length(piece)) FILTER (i > n) OVER (PARTITION BY pair_id, chosen ORDER BY i) AS stop FROM piece),
span AS (SELECT *, (stop - length(piece) + length(role) + 5)::BIGINT || ':' || stop::BIGINT AS span FROM placed)
SELECT n.pair_id::BIGINT AS pair_id, n.chosen_id, n.rejected_id, n.n::BIGINT AS n_common,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (chosen AND i <= n.n), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (chosen AND i > n.n), '') AS chosen_completion,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT chosen AND i > n.n), '') AS rejected_completion,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (chosen AND i > n.n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (NOT chosen AND i > n.n AND role = 'assistant'), '') AS rejected_mask
FROM span JOIN n USING (pair_id) GROUP BY n.pair_id, n.chosen_id, n.rejected_id, n.n
"""
