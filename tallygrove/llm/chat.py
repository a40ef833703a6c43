"""Chat formatting after cumulative-snapshot collapse.

Chat logs often keep a conversation once for each turn. Every turn prefix has a rolling hash: the running sums of two hashes
of (place, role, text), 60 bits each, so equal prefixes have equal hashes and lengths. A conversation whose full hash is also
the hash of a proper prefix of another goes (anti-join); of equal conversations the smallest conv_id stays. Those that remain
are rendered.

Defined cases: rows with a null conv_id belong to no conversation and are left out; repeated rows of a turn count once; turns
are in the order of (turn, role, text), nulls first; null roles and texts are empty; conversations of any length are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallygrove.llm.common import save

#: Opening and closing of a turn.
START, STOP = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, two rolling hashes of the prefix that ends there, and the number of turns."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # Repeats lie next to each other in this order.
    now, before = F.struct("turn", "role", "text"), F.struct(F.lag("turn").over(order).alias("turn"), F.lag("role").over(order).alias("role"), F.lag("text").over(order).alias("text"))
    rows = rows.withColumn("_first", F.when(F.row_number().over(order) == 1, 1).otherwise(F.when(now.eqNullSafe(before), 0).otherwise(1))).where("_first = 1")
    rows = rows.withColumn("place", F.row_number().over(order))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    for i in (1, 2):
        part = F.pmod(F.xxhash64(F.lit(i), "place", "role", "text"), F.lit(1 << 60)).cast("decimal(20,0)")
        rows = rows.withColumn(f"h{i}", F.sum(part).over(run))
    return rows.withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id"))).select("conv_id", "place", "role", "text", "h1", "h2", "n_turns")


def _maximal(rows: DataFrame) -> DataFrame:
    key = ["n_turns", "h1", "h2"]
    whole = rows.where("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = rows.where("place < n_turns").select(F.col("place").cast("long").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", "n_turns", "n_copies")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies (equal conversations, itself included) of each that no other conversation continues."""
    return _maximal(save(prefixes(turns)))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the chat text of each maximal conversation."""
    rows = save(prefixes(turns))  # read three times
    kept = save(_maximal(rows))
    text = rows.select("conv_id", "place", "role", "text").join(kept.select("conv_id"), "conv_id", "left_semi")
    text = text.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("_turns"))
    text = text.select("conv_id", F.array_join(F.transform("_turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(STOP + "\n"))), "").alias("chat"))
    return kept.join(text, "conv_id")
