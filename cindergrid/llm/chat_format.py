"""Chat formatting: cumulative snapshots of a conversation are dropped before the rest is rendered; DataFrame operations alone.

Turns of a conversation follow each other by turn, then role, then text, nulls first. Two 64-bit hashes of (position, role,
text) are folded by a running exclusive or, so every turn holds a rolling hash of the prefix that ends there. A
conversation whose last prefix hash is a shorter prefix of another one's is removed by an anti-join; of conversations equal
throughout the smallest id stays. What remains is rendered as one string: a header line with the role, the text, an end mark.

Rows without conv_id belong to no conversation and are left out. Null roles and texts count as empty ones of their own kind
(equal to each other, not to an empty string) and render as empty. Repeated rows are turns of their own. Other columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, END = "<|im_start|>", "<|im_end|>\n"


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that are kept; copies counts equal ones."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text", F.xxhash64("text", F.col("text").isNull(), F.lit(1)).alias("h1"), F.xxhash64(F.col("text").isNull(), "text", F.lit(2)).alias("h2"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv_id", "at", F.expr("bit_xor(xxhash64(at, role, role is null, h1))").over(upto).alias("a"), F.expr("bit_xor(xxhash64(h2, role is null, role, at))").over(upto).alias("b"), F.count("*").over(W.partitionBy("conv_id")).alias("n"))
    whole = rows.where("at = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    longer = rows.where("at < n").select(F.col("at").alias("n"), "a", "b").distinct()
    return whole.join(longer, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def render_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, chat) for every maximal conversation."""
    kept = maximal_conversations(turns)
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").join(kept, "conv_id")
    body = F.concat(F.lit(HEAD), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END))
    turn = F.struct("turn", "role", "text", body.alias("body"))
    chat = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return chat.select("conv_id", "n_turns", "copies", F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("chat"))
