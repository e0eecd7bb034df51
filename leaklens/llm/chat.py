"""Operator 8: chat formatting of maximal conversations.

Logs often hold every snapshot of a growing conversation.  A rolling hash of
each conversation's turn prefixes (two sums of hashes of position, role and
text, so that prefixes add up in chunks) finds conversations that are a proper
prefix of a longer one; an anti-join drops them, and of equal conversations
the one with the smallest conv_id stays.  The others are rendered, turn by
turn, in parts of at most ``PART_TURNS`` turns, so no conversation is gathered
in one place however long it is.

DataFrame functions only.

Results in corner cases: turns are ordered by turn, role and text (nulls
first); rows that repeat a whole turn (same conv_id, turn, role and text)
count once; a null role or text is rendered as empty, but differs from an
empty one when conversations are compared; rows with a null conv_id belong to
no conversation and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaklens.llm.graph import written

PART_TURNS = 512
CHUNK = 4096            # turns of a conversation that one window holds


def _numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``position`` within their conversation (from 0).

    Positions are counted per chunk of turn numbers; chunk sizes are added up
    before, so a conversation spreads over many tasks.
    """
    rows = (turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null").distinct()
            .withColumn("chunk", F.floor(F.col("turn") / CHUNK)))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", F.col("chunk").alias("__chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(within) - 1)
    starts = starts.withColumnRenamed("conv_id", "__conv")
    both = (rows["conv_id"] == starts["__conv"]) & rows["chunk"].eqNullSafe(starts["__chunk"])
    return rows.join(starts, both).select(
        "conv_id", "turn", "role", "text", (F.col("start") + F.col("place")).alias("position"),
        F.floor((F.col("start") + F.col("place")) / PART_TURNS).alias("part"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, length, h1, h2): the rolling hash of every turn prefix."""
    parts = []
    for seed in (1, 2):
        told = (F.lit(seed), F.col("position"), F.coalesce(F.xxhash64("role"), F.lit(0)), F.col("role").isNull(),
                F.coalesce(F.xxhash64("text"), F.lit(0)), F.col("text").isNull())
        parts.append(F.xxhash64(*told).cast("decimal(20,0)").alias(f"t{seed}"))
    rows = turns.select("conv_id", "part", "position", *parts)
    sums = rows.groupBy("conv_id", "part").agg(F.sum("t1").alias("s1"), F.sum("t2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select("conv_id", "part", *[F.coalesce(F.sum(f"s{i}").over(before), zero).cast("decimal(38,0)").alias(f"c{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv_id", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "part", "position", *[F.sum(f"t{i}").over(upto).alias(f"r{i}") for i in (1, 2)])
    return rows.join(sums, ["conv_id", "part"]).select(
        "conv_id", (F.col("position") + 1).alias("length"),
        *[(F.col(f"r{i}") + F.col(f"c{i}")).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id): conversations that are neither a proper prefix of another
    nor a later copy of one."""
    prefixes = written(_prefixes(turns), "chat-prefixes")
    last = prefixes.groupBy("conv_id").agg(F.max("length").alias("length"))
    ends = prefixes.join(last, ["conv_id", "length"])
    whole = ends.groupBy("length", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = (prefixes.join(last.withColumnRenamed("length", "total"), "conv_id").filter("length < total")
              .select("length", "h1", "h2").distinct())
    return whole.join(proper, ["length", "h1", "h2"], "left_anti").select("conv_id")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns and text of the maximal conversations; the parts
    of a conversation, joined in order, are its whole text."""
    numbered = written(_numbered(turns), "chat-turns")
    kept = maximal_conversations(numbered)
    empty = F.lit("")
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", empty), F.lit("\n"), F.coalesce("text", empty), F.lit("<|im_end|>\n"))
    return (numbered.join(kept, "conv_id", "left_semi").select("conv_id", "part", F.struct("position", line.alias("line")).alias("turn"))
            .groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("turns"))
            .select("conv_id", "part", "n_turns", F.array_join(F.col("turns.line"), "").alias("text")))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position FROM t),
x AS (SELECT *, CASE WHEN role IS NULL THEN 'n' ELSE 'r' || role END || chr(1) || CASE WHEN text IS NULL THEN 'n' ELSE 't' || text END || chr(2) AS told,
             '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM n),
p AS (SELECT conv_id, position, md5(string_agg(told, '') OVER (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING)) AS h,
             count(*) OVER (PARTITION BY conv_id) AS total FROM x),
w AS (SELECT h, total, min(conv_id) AS conv_id FROM p WHERE position + 1 = total GROUP BY h, total),
k AS (SELECT conv_id FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.h = w.h AND p.position + 1 = w.total AND p.position + 1 < p.total))
SELECT conv_id, CAST(floor(position / 512) AS BIGINT) AS part, count(*) AS n_turns, string_agg(line, '' ORDER BY position) AS text
FROM x WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY 1, 2
"""
