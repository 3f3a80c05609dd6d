"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times, once after each turn.  Each
turn gets the hash of all turns up to it; a conversation whose last hash is
the hash of an inner turn of another one is a prefix of it and is dropped by an
anti-join.  What is left is rendered with a chat template.  DataFrame
operations only.

Turns are dealt to blocks of ``BLOCK`` turn numbers.  Positions and prefix
hashes are computed inside blocks and carried over block totals, so one
conversation that holds a third of all rows is still many groups.  A block with
more than ``DENSE`` rows, whose turns have few numbers or none, is cut further by
turn number, role and the text's first letters, which keeps the order.

Defined results: turns are ordered by (turn, role, text), nulls first, and
count by position, so logs that number turns from 0 or 1 compare alike; a
repeated row is a turn of its own; null roles and texts equal only nulls and
render as empty; rows with a null conv_id form one conversation; of equal
conversations the smallest conv_id stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

BLOCK = 256
DENSE = 1 << 16
#: Letters of a text by which dense blocks are cut.
LETTERS = 4
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, block, pos (1 for the first turn) and h1, h2 of the turns up to it.

    A turn's hash covers its position, so the exclusive-or of two independent
    64-bit hashes over the turns so far identifies the prefix.
    """
    rows = turns.select("conv_id", "turn", "role", "text", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))).cast("long").alias("b"))
    dense = rows.groupBy("conv_id", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DENSE).select("conv_id", "b", F.lit(True).alias("dense"))
    whole = F.struct("b", F.lit(-(1 << 62)).cast("long").alias("t"), F.lit("").alias("r"), F.lit("").alias("x"))
    if dense.isEmpty():
        rows = rows.withColumn("block", whole)
    else:
        # Nulls come first, as in the order of turns.
        first = lambda c: F.coalesce(F.concat(F.lit("1"), c), F.lit("0"))
        part = F.struct("b", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("t"), first(F.col("role")).alias("r"), first(F.substring("text", 1, LETTERS)).alias("x"))
        dense = materialize(dense, "chat-dense")
        on = F.col("r.conv_id").eqNullSafe(F.col("d.conv_id")) & (F.col("r.b") == F.col("d.b"))
        rows = rows.alias("r").join(dense.alias("d"), on, "left").select("r.*", "d.dense").withColumn("block", F.when(F.col("dense"), part).otherwise(whole)).drop("dense")
    rows = rows.drop("b")
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    on = F.col("r.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("r.block") == F.col("o.block"))
    placed = rows.alias("r").join(offsets.alias("o"), on).select("r.*", "o.skip").withColumn("pos", F.col("skip") + F.row_number().over(inner))
    # A null differs from an empty text.
    content = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = placed.withColumns({f"t{i}": F.xxhash64(F.lit(f"turn{i}"), "pos", *content) for i in (1, 2)})
    so_far = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.withColumns({f"l{i}": F.bit_xor(f"t{i}").over(so_far) for i in (1, 2)})
    totals = hashed.groupBy("conv_id", "block").agg(*[F.bit_xor(f"t{i}").alias(f"b{i}") for i in (1, 2)])
    carried = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    on = F.col("r.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("r.block") == F.col("o.block"))
    return local.alias("r").join(carried.alias("o"), on).select("r.conv_id", "r.role", "r.text", "r.block", "r.pos", *[F.col(f"r.l{i}").bitwiseXOR(F.col(f"o.c{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one begins with."""
    last = hashed.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e"))
    # Equal conversations meet before the join, so a much-copied one is a single row there.
    whole = last.groupBy(F.col("e.pos").alias("pos"), F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2")).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    # A hash that ends a conversation of pos turns lies inside another if that goes on beyond pos.
    ends = hashed.alias("a").join(last.alias("z"), F.col("a.conv_id").eqNullSafe(F.col("z.conv_id")) & (F.col("a.pos") < F.col("z.e.pos"))).groupBy("a.pos", "a.h1", "a.h2").agg(F.count(F.lit(1)).alias("n"))
    kept = whole.join(ends, ["pos", "h1", "h2"], "left_anti")
    return kept.select(F.col("first.conv_id").alias("conv_id"), F.col("pos").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, n_copies, chat for each maximal conversation."""
    before, between, after = (F.lit(x) for x in template)
    hashed = materialize(prefix_hashes(turns), "chat-hashed")
    kept = maximal_conversations(hashed)
    one = F.concat(before, F.coalesce("role", F.lit("")), between, F.coalesce("text", F.lit("")), after)
    rows = hashed.alias("r").join(kept.alias("k"), F.col("r.conv_id").eqNullSafe(F.col("k.conv_id"))).select("k.conv_id", "k.n_turns", "k.n_copies", "r.block", "r.pos", one.alias("s"))
    # A rendered conversation is one value; blocks are joined first, so no group holds more turns than a block's.
    parts = rows.groupBy("conv_id", "n_turns", "n_copies", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("a")).select("conv_id", "n_turns", "n_copies", F.col("a")[0]["pos"].alias("pos"), F.array_join(F.col("a.s"), "").alias("s"))
    whole = parts.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("a"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("a.s"), "").alias("chat"))


def op1_chat_collapse(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chat
  FROM conversations GROUP BY conv_id),
kept AS (
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.n > c.n AND d.turns[1:c.n] = c.turns))
SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, any_value(chat) AS chat FROM kept GROUP BY n, turns
"""
