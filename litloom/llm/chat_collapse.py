"""Chat formatting with cumulative-snapshot collapse (DataFrame operations only).

A log often holds a conversation many times, each time a few turns longer. Rolling hashes of
every turn prefix, pre-aggregated to one row a prefix, show which conversations are a prefix of a
longer one (or equal to one with a smaller id). Such snapshots are compared turn by turn with
the conversation that holds them and removed by an anti-join; the rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.llm.common import id_key, written

#: Turns that one task sorts at a time; longer conversations are handled block by block.
BLOCK = 256
#: Turns in one rendered part.
PART = 512
#: Bits of a turn's hash: a running sum of 2**23 turns still fits a long.
_HASH_BITS = 40
#: Fixed values of the rendering.
OPEN, CLOSE = "<|", "|>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, idx, role, text``: turns numbered from 1 by turn (null last), role and text; repeated rows once."""
    rows = conversations.select(id_key("conv_id").alias("conv"), id_key("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    up = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "block", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before"))
    at = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    return rows.join(sizes, ["conv", "block"]).select("conv", (F.col("before") + F.row_number().over(at)).alias("idx"), "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv, idx, total, p1, p2, p3``: three rolling sums of 40-bit hashes of (position, role, text)."""
    def h(k: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(k), "idx", "role", "text"), F.lit(1 << _HASH_BITS))

    rows = turns.select("conv", "idx", F.floor(F.col("idx") / BLOCK).alias("block"), *[h(k).alias(f"h{k}") for k in (1, 2, 3)])
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("n"), *[F.sum(f"h{k}").alias(f"s{k}") for k in (1, 2, 3)])
    up = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.sum("n").over(Window.partitionBy("conv")).alias("total"), *[F.coalesce(F.sum(f"s{k}").over(up), F.lit(0)).alias(f"b{k}") for k in (1, 2, 3)])
    at = Window.partitionBy("conv", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(blocks, ["conv", "block"])
    return rows.select("conv", "idx", "total", *[(F.col(f"b{k}") + F.sum(f"h{k}").over(at)).alias(f"p{k}") for k in (1, 2, 3)])


def snapshots(turns: DataFrame) -> DataFrame:
    """``conv, kept_in``: conversations whose turns are exactly the first turns of ``kept_in``."""
    prefixes = prefix_hashes(turns)
    key = ["idx", "p1", "p2", "p3"]
    # One row a prefix, whatever the number of conversations that share it.
    longest = prefixes.groupBy(*key).agg(F.max(F.struct("total", (-F.col("conv")).alias("neg"))).alias("best"))
    whole = prefixes.where("idx = total").select("conv", *key)
    claim = whole.join(longest, key).select("conv", F.col("idx").alias("n"), (-F.col("best.neg")).alias("kept_in")).where("conv <> kept_in")
    mine = turns.join(claim, "conv").select("conv", "kept_in", "n", "idx", "role", "text")
    theirs = turns.select(F.col("conv").alias("kept_in"), "idx", F.col("role").alias("role2"), F.col("text").alias("text2"))
    same = mine.join(theirs, ["kept_in", "idx"]).where("role = role2 and text = text2")
    return same.groupBy("conv", "kept_in", "n").agg(F.count("*").alias("m")).where("m = n").select("conv", "kept_in")


def rendered_turn() -> Column:
    """Role and text between markers; markers inside a text are broken up so they can't be mistaken."""
    def safe(c: str) -> Column:
        return F.replace(F.col(c), F.lit(OPEN), F.lit("< |"))

    return F.concat(F.lit(OPEN), safe("role"), F.lit(CLOSE + "\n"), safe("text"), F.lit("\n" + OPEN + "end" + CLOSE + "\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, kept, kept_in, rendered``; one row per conversation and part of ``PART`` turns.

    A dropped snapshot has one row with ``part`` 0, no text and the conversation that holds it in
    ``kept_in``; equal conversations leave the one with the smallest id. Null roles and texts read
    as empty, null turns come last, rows without id form one conversation with a null id, repeated rows
    count once. Other columns are ignored; an empty table gives no rows.
    """
    turns = written(ordered_turns(conversations), "turns")
    dropped = written(snapshots(turns), "snapshots")
    kept = turns.join(dropped, "conv", "left_anti")
    null_id = F.lit(2**63 - 1)
    back = lambda c: F.when(F.col(c) != null_id, F.col(c))
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n_turns"))
    parts = kept.withColumn("part", F.floor((F.col("idx") - 1) / PART)).groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("idx", rendered_turn().alias("s")))).alias("s"))
    lines = parts.select("conv", "part", F.array_join(F.transform("s", lambda x: x["s"]), "").alias("rendered"))
    stay = lines.join(sizes, "conv").select(back("conv").alias("conv_id"), "part", "n_turns", F.lit(True).alias("kept"), back("conv").alias("kept_in"), "rendered")
    gone = dropped.join(sizes, "conv").select(back("conv").alias("conv_id"), F.lit(0).cast("long").alias("part"), "n_turns", F.lit(False).alias("kept"), back("kept_in").alias("kept_in"), F.lit(None).cast("string").alias("rendered"))
    return stay.unionByName(gone)


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn, role, text) AS l,
             list('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10) ORDER BY turn, role, text) AS r FROM t GROUP BY conv_id),
held AS (SELECT d.conv_id, first(k.conv_id ORDER BY len(k.l) DESC, k.conv_id) AS kept_in
         FROM c d JOIN c k ON k.conv_id <> d.conv_id AND k.l[1] = d.l[1] AND len(k.l) >= len(d.l) AND k.l[1:len(d.l)] = d.l
              AND (len(k.l) > len(d.l) OR k.conv_id < d.conv_id) GROUP BY d.conv_id)
SELECT c.conv_id, CAST(p.part AS BIGINT) AS part, CAST(len(c.l) AS BIGINT) AS n_turns, held.conv_id IS NULL AS kept,
       coalesce(held.kept_in, c.conv_id) AS kept_in,
       CASE WHEN held.conv_id IS NULL THEN array_to_string(c.r[p.part * 512 + 1 : p.part * 512 + 512], '') END AS rendered
FROM c LEFT JOIN held ON held.conv_id = c.conv_id, LATERAL (SELECT unnest(range((len(c.l) - 1) // 512 + 1)) AS part) p
WHERE held.conv_id IS NULL OR p.part = 0
"""
