"""Chat logs that hold every stage of a growing conversation: keep the longest stage of each, then render it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turn numbers per piece: a conversation of very many turns is ordered piece by piece.
PIECE = 1024
START, STOP = "<|im_start|>", "<|im_end|>"
KEYS = ("_h1", "_h2", "_turns")


def turn_prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, _h1, _h2, _turns, _last``: per turn number the rolling hash of everything up to it.

    The hash of a prefix is the exclusive or of two 64-bit hashes of each (turn, role, text) in it, so it rolls on from turn
    to turn and can be carried over pieces of a conversation without ordering it in one task. ``_turns`` counts the turn
    rows of the prefix; rows equal in all four columns are one row.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1 << 40)).alias("turn"),
        F.xxhash64(F.lit(1), F.col(turn_col), F.col(role_col).isNull(), F.col(role_col), F.col(text_col).isNull(), F.col(text_col)).alias("_a"),
        F.xxhash64(F.lit(2), F.col(text_col), F.col(text_col).isNull(), F.col(role_col), F.col(role_col).isNull(), F.col(turn_col)).alias("_b"),
    ).distinct()
    each = rows.groupBy("conv_id", "turn").agg(
        F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"), F.count(F.lit(1)).alias("_n")
    ).withColumn("_piece", F.floor(F.col("turn") / PIECE))
    inside = W.partitionBy("conv_id", "_piece").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("conv_id").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("conv_id")
    pieces = each.groupBy("conv_id", "_piece").agg(
        F.bit_xor("_a").alias("_pa"), F.bit_xor("_b").alias("_pb"), F.sum("_n").alias("_pn"), F.max("turn").alias("_pt")
    ).select(
        F.col("conv_id").alias("_c"), F.col("_piece").alias("_p"), F.coalesce(F.bit_xor("_pa").over(before), F.lit(0)).alias("_ca"),
        F.coalesce(F.bit_xor("_pb").over(before), F.lit(0)).alias("_cb"), F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_cn"),
        F.max("_pt").over(after).alias("_end"),
    )
    rolled = each.select(
        "conv_id", "turn", "_piece", F.bit_xor("_a").over(inside).alias("_ia"), F.bit_xor("_b").over(inside).alias("_ib"),
        F.sum("_n").over(inside).alias("_in"),
    ).join(pieces, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_piece") == F.col("_p")))
    return rolled.select(
        "conv_id", "turn", F.col("_ia").bitwiseXOR(F.col("_ca")).alias("_h1"), F.col("_ib").bitwiseXOR(F.col("_cb")).alias("_h2"),
        (F.col("_in") + F.col("_cn")).alias("_turns"), (F.col("turn") == F.col("_end")).alias("_last"),
    )


def maximal_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """``conv_id, n_turns, copies`` of the conversations that are no proper prefix of another one.

    Of equal conversations the one of the smallest id stands for all ``copies``. Both sides of the anti-join hold a hash
    once, however many conversations share a beginning.
    """
    marked = turn_prefixes(turns, **columns)
    whole = marked.where("_last").groupBy(*KEYS).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    beginnings = marked.where("NOT _last").select(*KEYS).distinct()
    return whole.join(beginnings, list(KEYS), "left_anti").select("conv_id", F.col("_turns").alias("n_turns"), "copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn in chat markup; a null role is a user, a null text is empty."""
    return F.concat(F.lit(START), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(STOP + "\n"))


def collapse_snapshots(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, turn, n_turns, copies, segment``: the rendered turns of maximal conversations, one row per turn.

    Segments in turn order, put one behind the other, are the training text; they stay rows, so a conversation of any
    length is never gathered in one task (:func:`whole_texts` joins them where conversations are known to be short).

    Null turn numbers come first; rows equal in all columns are one turn; several different rows of one turn number all
    stay, and prefixes end only between turn numbers. Rows of a null id are one conversation. An empty table gives no row.
    Further columns play no part.
    """
    kept = maximal_conversations(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    kept = kept.select(F.col("conv_id").alias("_keep"), "n_turns", "copies")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    ).distinct()
    return rows.join(kept, F.col("conv_id").eqNullSafe(F.col("_keep"))).select(
        "conv_id", "turn", "n_turns", "copies", rendered(F.col("role"), F.col("text")).alias("segment")
    )


def whole_texts(segments: DataFrame) -> DataFrame:
    """``conv_id, text`` for conversations short enough to be one row each."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["segment"]), "").alias("text"))
