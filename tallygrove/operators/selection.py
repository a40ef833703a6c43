"""Exact percentiles by distributed selection.

No task and no state holds all values of a group. A bounded sketch of each range proposes splitters, the rows are counted by
the ranges between them, and only the ranges that hold a wanted rank are looked at again, until each has few rows or a single
value. Counts are exact, so a sketch's error costs another round and never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.session import dropped, saved

#: Rows of a range that are sorted at last; the sketch's accuracy; splitters of a round after the first.
FEW, ACCURACY, SPLITTERS = 10_000, 1000, 31


def _bucket(value: Column, cuts: Column) -> Column:
    """Odd for a cut's own value, even between cuts, ascending: a value that most rows share has a range of its own."""
    return 2 * F.size(F.filter(cuts, lambda c: c < value)) + F.array_contains(cuts, value).cast("int")


def _narrowed(inside: DataFrame, wanted: DataFrame, levels: list[float]) -> DataFrame:
    """wanted with the range between the sketch's splitters in which each rank lies."""
    cuts = inside.groupBy("_k", "_lo").agg(F.array_distinct(F.array_sort(F.percentile_approx("_v", levels, ACCURACY))).alias("_cuts"))
    counts = inside.join(cuts, ["_k", "_lo"]).groupBy("_k", "_lo", _bucket(F.col("_v"), F.col("_cuts")).alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    before = Window.partitionBy("_k", "_lo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # two rows a splitter
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_rank") - F.col("_below")
    found = wanted.join(counts, ["_k", "_lo"]).where((place >= F.col("_before")) & (place < F.col("_before") + F.col("_n")))
    return found.select("_k", "_rank", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_n").alias("_size"))


def ranked(rows: DataFrame, wanted: DataFrame, levels: list[float], few: int = FEW) -> DataFrame:
    """rows: _k, _v (not null); wanted: _k, _rank (from 0), _size of the group. _k, _rank and the value of that rank."""
    state = saved(wanted.select("_k", "_rank", F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"), F.lit(0).cast("bigint").alias("_below"), "_size"))
    while True:
        open_ = state.where("_lo < _hi")
        ranges = open_.select("_k", "_lo", "_hi", "_below").distinct()
        inside = rows.join(ranges.withColumnRenamed("_k", "_key"), (F.col("_k") == F.col("_key")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop("_key")
        most = open_.agg(F.max("_size")).first()[0]
        if most is None or most <= few:
            break
        kept = saved(inside.select("_k", "_v", "_lo", "_below"))  # what no range holds is not read again
        rows, before = kept.select("_k", "_v"), state
        state = saved(_narrowed(kept, open_, levels).unionByName(state.where("_lo >= _hi")))
        dropped(before)
        levels = [i / (SPLITTERS + 1) for i in range(1, SPLITTERS + 1)]
    place = F.row_number().over(Window.partitionBy("_k", "_lo").orderBy("_v")) - 1 + F.col("_below")  # ``few`` rows at most
    last = inside.select("_k", "_v", "_lo", place.alias("_rank")).join(open_.select("_k", "_lo", "_rank"), ["_k", "_lo", "_rank"])
    return last.select("_k", "_rank", "_v").unionByName(state.where("_lo >= _hi").select("_k", "_rank", F.col("_lo").alias("_v")))


def percentiles(df: DataFrame, value: str, levels: list[float], by: tuple[str, ...] = (), out: str = "percentiles", few: int = FEW) -> DataFrame:
    """by and an array of the exact percentiles of ``value`` at ``levels``, interpolated between neighbouring ranks.

    Missing values (null, NaN) don't count; a group of none has null for each level. Null keys make a group like any other.
    Without ``by`` one row, even for an empty table.
    """
    key = F.struct(*by) if by else F.lit(0)
    v = F.col(value).cast("double")
    rows = df.select(key.alias("_k"), F.when(~F.isnan(v), v + 0.0).alias("_v"))
    groups = saved(rows.groupBy("_k").agg(F.count("_v").alias("_size")))
    at = groups.select("_k", "_size", F.posexplode(F.array(*(F.lit(float(p)) for p in levels))).alias("_i", "_p")).withColumn("_at", F.col("_p") * (F.col("_size") - 1))
    at = at.where("_size > 0").select("_k", "_i", "_size", F.floor("_at").alias("_down"), F.ceil("_at").alias("_up"), (F.col("_at") - F.floor("_at")).alias("_part"))
    wanted = at.select("_k", "_size", F.explode(F.array("_down", "_up")).alias("_rank")).distinct()
    off = 2 / ACCURACY
    first = sorted({min(max(p + d, 0.0), 1.0) for p in levels for d in (-off, off)})
    found = saved(ranked(rows.where("_v is not null"), wanted, first, few))
    side = lambda rank, name: found.select("_k", F.col("_rank").alias(rank), F.col("_v").alias(name))
    got = at.join(side("_down", "_a"), ["_k", "_down"]).join(side("_up", "_b"), ["_k", "_up"])
    value_of = F.when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a")))
    lists = got.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", value_of.alias("_q")))), lambda x: x["_q"]).alias(out))  # one a level
    none = F.array(*(F.lit(None).cast("double") for _ in levels))
    if not by:
        one = df.sparkSession.range(1).select(F.lit(0).alias("_k"))
        return one.join(lists, "_k", "left").select(F.coalesce(out, none).alias(out))
    whole = groups.withColumnRenamed("_k", "_key").join(lists, F.col("_key") == F.col("_k"), "left")
    return whole.select(*(F.col(f"_key.`{c}`").alias(c) for c in by), F.coalesce(out, none).alias(out))
