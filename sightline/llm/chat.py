"""Chat formatting: logged conversations that are prefixes of longer ones collapse, the rest is rendered.

A service that logs the whole history after every answer leaves many snapshots of one conversation. Every turn
carries a rolling hash of the turns up to it; a conversation whose last hash is the hash of an earlier turn in a
longer one is dropped by an anti-join, and of equal conversations the one with the least id stays. Only hashes move
until then; the texts are shuffled once, for the conversations that are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _clean(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _content(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.length("role"), "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, n, h1, h2: pos numbers a conversation's n turns from 1; h1 and h2 hash turns 1 to pos.

    The hash of a prefix is the exclusive or of the hashes of (position, role, text), 128 bits in all, so a window
    can roll it. Turns are ordered by turn, nulls first, then by their hash; repeated rows count as one turn; null
    roles and texts count as empty; a null conv_id is an id like others.
    """
    narrow = _clean(turns).select("conv_id", "turn", _content("a").alias("a"), _content("b").alias("b")).distinct()
    order = W.partitionBy("conv_id").orderBy("turn", "a", "b")
    rolled = order.rowsBetween(W.unboundedPreceding, 0)
    placed = narrow.withColumn("pos", F.row_number().over(order))
    return placed.select("conv_id", "pos", F.count(F.lit(1)).over(W.partitionBy("conv_id")).alias("n"), F.bit_xor(F.xxhash64("pos", "a")).over(rolled).alias("h1"), F.bit_xor(F.xxhash64("b", "pos")).over(rolled).alias("h2"))


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id and n_snapshots of conversations that are no prefix of a longer one; of equal ones the least id, null last.

    n_snapshots counts the equal conversations that it stands for, itself included.
    """
    ends = hashed.filter("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_snapshots"))
    # prefixes that many conversations share are one row each before they meet the ends
    inner = hashed.filter("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "n_snapshots")


def render(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_snapshots, chat.

    The conversation is the unit of training and is rendered as one text, so its turns meet in one row, whatever the
    length of their texts. Null ids are one conversation, apart from that of empty ids; repeated rows are one turn; null roles and texts are
    empty. Turns with equal numbers follow each other by the hash of role and text. An empty table gives an empty result; extra columns are ignored.
    """
    kept = maximal(written(prefix_hashes(turns), "op4-hashes")).withColumnRenamed("conv_id", "_kept")
    body = _clean(turns).select("conv_id", F.struct("turn", _content("a").alias("a"), _content("b").alias("b"), "role", "text").alias("t"))
    # a null id is an id of its own, and another than an empty one
    joined = body.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")))
    chats = joined.groupBy("conv_id", "n_snapshots").agg(F.array_sort(F.array_distinct(F.collect_list("t"))).alias("t"))
    piece = F.transform("t", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE)))
    return chats.select("conv_id", F.size("t").cast("long").alias("n_turns"), "n_snapshots", F.array_join(piece, "").alias("chat"))


RENDER_SQL = """
WITH clean AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM clean),
whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, list(struct_pack(role := role, text := text) ORDER BY pos) AS turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
  FROM placed GROUP BY conv_id),
once AS (SELECT min(conv_id) AS conv_id, count(*)::BIGINT AS n_snapshots, n_turns, turns, chat FROM whole GROUP BY n_turns, turns, chat)
SELECT conv_id, n_turns, n_snapshots, chat FROM once a
WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.turns[1] = a.turns[1] AND b.n_turns > a.n_turns AND b.turns[1:a.n_turns] = a.turns)
"""
