"""Sharding by balanced label propagation.

Documents with equal texts are linked. Linked documents start on shards drawn by hash and then, round by round, move towards
the shard on which most of their neighbours are, as far as the shard's quota has room; a group larger than a shard fills one
shard after another. While documents move a quota is a tenth above the final size, so that full shards do not block each
other; what lies above the final size then goes on, group by group, to where room is left. Documents of a group are interchangeable, so the state is one row for each (group, shard) with a count:
a group with a third of all rows is at most as many rows as there are shards. Unlinked documents cut no edge wherever they
lie; they are dealt out last, so that the shards' counts are at most one apart (the law ``rows``).

Defined cases: a null text has no bytes, the checksum 0, and no links; empty texts are equal to each other; rows that repeat
an id are rows of their own; an empty table has no shards; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallygrove.llm.common import number_rows, running_before, save

SHARDS = 40
#: Room that a shard has while documents move, as a multiple of its final size.
SLACK = 1.1
#: Rows that one task numbers at a time.
CHUNK_ROWS = 100_000


def _propagate(pieces: DataFrame, shards: int, quota: int) -> DataFrame:
    """pieces: group, shard, n. Moves counts towards each group's largest piece with room under ``quota`` rows a shard, until none is left to move."""
    while True:  # every move adds to the sum of n * n, so this ends
        load = {r["_shard"]: r["n"] for r in pieces.groupBy("_shard").agg(F.sum("n").alias("n")).collect()}  # as many rows as shards
        room = F.array(*(F.lit(max(0, quota - load.get(s, 0))) for s in range(shards)))
        here = pieces.withColumn("_room", F.get(room, F.col("_shard"))).withColumn("_rank", F.struct(F.col("n").alias("n"), F.xxhash64("_group", "_shard").alias("h")))
        # Every linked document has all others of its group as neighbours: the shard with most of them, of those with room.
        towards = here.where("_room > 0").groupBy("_group").agg(F.max(F.struct("_rank", F.col("_shard").alias("to"), F.col("_room").alias("room"))).alias("_t"))
        moving = here.join(towards, "_group").where("_shard <> _t.to").select("_group", "_shard", "n", F.col("_t.to").alias("_to"), F.col("_t.room").alias("_room"), (F.col("_rank") < F.col("_t._rank")).alias("_up")).where("_up or n <= _room")
        moving = running_before(moving, "_to", "n", ["_group", "_shard"], "_first").withColumn("_m", F.least(F.col("n"), F.col("_room") - F.col("_first")))
        # A part of a piece goes only where more of the group is; a whole one also joins a smaller piece.
        moving = save(moving.where("_m > 0 and (_up or _m = n)").select("_group", "_shard", "_to", "_m"))
        if moving.isEmpty():
            return pieces
        parts = pieces.unionByName(moving.select("_group", "_shard", (-F.col("_m")).alias("n"))).unionByName(moving.select("_group", F.col("_to").alias("_shard"), F.col("_m").alias("n")))
        pieces = save(parts.groupBy("_group", "_shard").agg(F.sum("n").alias("n")).where("n > 0"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    text = F.col("text").cast("binary")
    base = save(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.md5(text).alias("_group"),
            F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int").alias("_shard"),
        )
    )
    total = base.count()
    chunks = max(1, -(-total // CHUNK_ROWS), min(64, total // 1000))
    counted = base.where("_group is not null").groupBy("_group", "_shard").agg(F.count("*").alias("n"))
    counted = save(counted.withColumn("_all", F.sum("n").over(Window.partitionBy("_group"))))
    pieces = _propagate(counted.where("_all > 1").select("_group", "_shard", "n"), shards, int(total // shards * SLACK) + 1)

    # A shard above its final size gives up its smallest pieces; only a large one is cut.
    size = [total // shards + (s < total % shards) for s in range(shards)]
    space = F.get(F.array(*map(F.lit, size)), F.col("_shard")) - F.col("_first")
    pieces = running_before(pieces, "_shard", "n", ["_group"], "_first").withColumn("n", F.when((F.col("n") <= space) | (F.col("n") > total // shards // 8), F.least(F.col("n"), space)).otherwise(0))
    pieces = save(pieces.where("n > 0").drop("_first"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("_group").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = pieces.select("_group", F.col("_shard").alias("shard"), start.alias("_from"), (start + F.col("n")).alias("_until"))
    groups = counted.where("_all > 1").select("_group").distinct()
    linked = number_rows(base.drop("_shard").join(groups, "_group", "left_semi"), ["_group"], ["doc_id"], "_r", chunks)
    linked = linked.alias("d").join(spans.alias("s"), (F.col("d._group") == F.col("s._group")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_until")), "left")
    # The slices of a group that are numbered, and so placed, together.
    linked = save(linked.select("d.doc_id", "size", "text_crc32", "shard", F.xxhash64("d._group", F.floor(F.col("_r") / CHUNK_ROWS)).alias("_slice")))
    load = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # as many rows as shards, and one
    # What is left goes where most room is first, so that it is cut least.
    rooms = sorted(((size[s] - load.get(s, 0), -s) for s in range(shards)), reverse=True)
    ends, order = list(accumulate(n for n, _ in rooms)), F.array(*(F.lit(-s) for _, s in rooms))
    columns = ["doc_id", "size", "text_crc32"]
    left = number_rows(linked.where("shard is null"), [], ["_slice", "doc_id"], "_r", chunks).select(*columns, "_r")
    alone = number_rows(base.join(groups, "_group", "left_anti"), [], ["doc_id"], "_r", chunks).select(*columns, (F.col("_r") + load.get(None, 0)).alias("_r"))
    rest = left.unionByName(alone).select(*columns, F.get(order, F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("_r")))).alias("shard"))
    placed = number_rows(linked.where("shard is not null").select(*columns, "shard").unionByName(rest), ["shard"], ["doc_id"], "slot", chunks)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
