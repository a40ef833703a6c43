"""Similarity join of names by the sequence matcher's ratio, without comparing all with all.

The ratio of two names is 2 M / T for M matched characters of T in both. A ratio of at least ``cutoff`` leaves at most
U = T - 2 M characters unmatched, so the matched ones lie in at most U + 1 runs and the names share at least M - U - 1 grams of
two characters, each at places no further apart than U. That gives the filters, none of which loses a pair:

- prefix: of all grams in a common order, the rarest first, two names that share enough have one in common among the first
  few of both; only these are indexed, within a block.
- length and letters: U bounds the difference of the lengths, and the number of letters that only one of the names has.
- count: the grams of both, with repeats, are at least as many as needed.
- position: the same counted only where places agree to within U.

What is left gets the exact ratio. For names that contain each other the index holds the rarest gram of the shorter one.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTOFF = 0.85


def needed(total: Column, cutoff: float) -> tuple[Column, Column]:
    """Characters that may be left unmatched of ``total`` in both names, and grams that both must share."""
    matched = F.ceil(F.lit(cutoff / 2) * total - 1e-9).cast("int")
    free = total - 2 * matched
    return free, matched - free - 1


def usable(cutoff: float) -> bool:
    """Whether names that differ must always share a gram: from a cutoff of 0.85 on they do, at any length."""
    for total in range(2, 400):
        free = total - 2 * math.ceil(cutoff / 2 * total - 1e-9)
        if free > 0 and (total - free) // 2 - free - 1 < 1:
            return False
    return True


def grams(name: Column) -> Column:
    """The grams of a name with their place; the whole name where it is too short for one."""
    n = F.char_length(name)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.substring(name, i, F.lit(2)).alias("gram"), i.alias("at")))).otherwise(F.array(F.struct(name.alias("gram"), F.lit(1).alias("at"))))


def letters(name: Column) -> Column:
    """A bit for each letter that occurs, by its code point modulo 64."""
    one = F.transform(F.sequence(F.lit(1), F.char_length(name)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(F.substring(name, i, F.lit(1))) % 64))
    return F.aggregate(one, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sequence matcher's ratio of b to a, which differs from edit distance and from the ratio of a to b."""
    out, m = [], SequenceMatcher()
    for x, y in zip(a, b, strict=True):
        m.set_seq2(x)
        m.set_seq1(y)
        out.append(m.ratio())
    return pd.Series(out, dtype="float64")


def _tokens(names: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each gram of each name: the gram, its number among the name's equal ones, and its place."""
    flat = names.select(*keys, "name", F.explode(grams(F.col("name"))).alias("_g")).select(*keys, "name", F.col("_g.gram").alias("gram"), F.col("_g.at").alias("at"))
    nth = F.row_number().over(Window.partitionBy(*keys, "name", "gram").orderBy("at"))  # a name's own grams
    return flat.withColumn("nth", nth)


def _indexed(tokens: DataFrame, counts: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """The first tokens of each name, the rarest first: as many as it takes to meet every partner that it may have."""
    order = Window.partitionBy(*keys, "name").orderBy("n", "gram", "nth")
    ranked = tokens.join(counts, [*keys, "gram", "nth"]).withColumn("_place", F.row_number().over(order)).withColumn("_size", F.char_length("name"))
    # The least that any partner of a possible length needs.
    ends = [F.ceil(F.col("_size") * F.lit(cutoff / (2 - cutoff)) - 1e-9), F.floor(F.col("_size") * F.lit((2 - cutoff) / cutoff) + 1e-9)]
    lengths = F.sequence(*(F.greatest(n.cast("int"), F.lit(1)) for n in ends))
    least = F.array_min(F.transform(lengths, lambda n: needed(F.col("_size") + n, cutoff)[1]))
    first = ranked.where(F.col("_place") <= F.greatest(F.col("_size") - 1, F.lit(1)) - F.greatest(least, F.lit(1)) + 1)
    return first.select(*keys, "name", "gram", "nth", F.col("_size").alias("size"), letters(F.col("name")).alias("letters"))


def candidates(left: DataFrame, right: DataFrame, keys: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """left, right: keys, name (not null, not empty). keys, a, b: every pair of names of a block that may reach the cutoff."""
    if not usable(cutoff):
        raise ValueError(f"a cutoff of {cutoff} does not imply a shared gram")
    left, right = left.select(*keys, "name").distinct(), right.select(*keys, "name").distinct()
    ours, theirs = _tokens(left, keys), _tokens(right, keys)
    counts = ours.unionByName(theirs).groupBy(*keys, "gram", "nth").agg(F.count("*").alias("n"))
    side = lambda tokens, x: _indexed(tokens, counts, keys, cutoff).withColumnsRenamed({c: f"{x}_{c}" for c in ("name", "size", "letters")})
    free, shared = needed(F.col("a_size") + F.col("b_size"), cutoff)
    near = (F.abs(F.col("a_size") - F.col("b_size")) <= free) & (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= free)
    met = side(ours, "a").join(side(theirs, "b"), [*keys, "gram", "nth"]).where(near).select(*keys, F.col("a_name").alias("a"), F.col("b_name").alias("b"), free.alias("_free"), shared.alias("_shared")).distinct()
    return met.where((F.col("a") == F.col("b")) | _enough("a", "b", "_free", "_shared")).select(*keys, "a", "b")


@F.pandas_udf(T.BooleanType())
def _enough(a: pd.Series, b: pd.Series, free: pd.Series, shared: pd.Series) -> pd.Series:
    """The count and the position filter."""
    known: dict[str, dict[str, list[int]]] = {}

    def places(name: str) -> dict[str, list[int]]:
        if name not in known:
            known[name] = {}
            for i in range(len(name) - 1):
                known[name].setdefault(name[i : i + 2], []).append(i)
        return known[name]

    out = []
    for x, y, far, least in zip(a, b, free, shared, strict=True):
        own, other = places(x), places(y)
        met = [(at, other[g]) for g, at in own.items() if g in other]
        out.append(sum(min(len(i), len(j)) for i, j in met) >= least and sum(any(abs(p - q) <= far for q in j) for i, j in met for p in i) >= least)
    return pd.Series(out, dtype="bool")


def similar(left: DataFrame, right: DataFrame, keys: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """keys, a, b, ratio: every pair of names of a block whose ratio reaches the cutoff."""
    return candidates(left, right, keys, cutoff).withColumn("ratio", likeness("a", "b")).where(F.col("ratio") >= cutoff)


def contained(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b: every pair of names of a block of which one holds the other."""
    left, right = left.select(*keys, "name").distinct(), right.select(*keys, "name").distinct()

    def all_of(names: DataFrame) -> DataFrame:
        """Grams and, for names of one character, single characters."""
        one = F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda i: F.substring(F.col("name"), i, F.lit(1)))
        return names.select(*keys, "name", F.explode(F.array_distinct(F.concat(F.transform(grams(F.col("name")), lambda t: t["gram"]), one))).alias("gram"))

    def rarest(short: DataFrame, held: DataFrame) -> DataFrame:
        tokens = short.select(*keys, "name", F.explode(F.array_distinct(F.transform(grams(F.col("name")), lambda t: t["gram"]))).alias("gram"))
        counted = tokens.join(held.groupBy(*keys, "gram").agg(F.count("*").alias("n")), [*keys, "gram"], "left")
        # A gram that no other name has rules the name out.
        least = counted.groupBy(*keys, "name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_t"))
        return least.where("_t.n > 0").select(*keys, F.col("name").alias("_short"), F.col("_t.gram").alias("gram"))

    def inside(short: DataFrame, long: DataFrame) -> DataFrame:
        held = all_of(long)
        return rarest(short, held).join(held, [*keys, "gram"]).where(F.contains("name", "_short"))

    ours = inside(left, right).select(*keys, F.col("_short").alias("a"), F.col("name").alias("b"))
    theirs = inside(right, left).select(*keys, F.col("name").alias("a"), F.col("_short").alias("b"))
    return ours.unionByName(theirs).distinct()
