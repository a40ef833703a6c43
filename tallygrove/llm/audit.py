"""Filter interaction audit: what each filter removes, in every order in which the filters could be applied.

A document's failures are a bit mask, which does not depend on any order. Documents are counted by part and mask, and the
masks, at most 2**5, are unpivoted against the steps of all orders: a running bit-or over an order's earlier steps tells which
failing documents an earlier filter has taken. Conditional sums over a part's cells give the counts of a step, and a window
over a part and a filter gives what it removes in all orders.

The filter E asks whether a smaller doc_id has the same text. No join is needed for it: of each text the smallest doc_id's
document passes and all others fail, so the failing documents of a part and mask are all less those that are first of their
text. All shuffles carry digests, masks and counts, never texts, and are summed before they leave a task, so a source or a
text that a third of all rows share is a row for each task.

Defined cases: a null text is empty; a null source is the empty string; documents without a label lose nothing good or toxic,
of several labels of one document the greatest counts; rows that repeat a doc_id count as the one of the smallest digest (and
source); rows without a doc_id are left out; extra columns are ignored; no documents give no rows; texts are taken whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import SPACE_CLASS, digest, save

#: The filters; a document's mask has bit i set where it fails the i-th.
FILTERS = "ABCDE"


def failures(text: Column) -> Column:
    """The mask of the filters that look at one text alone, A to D."""
    words = F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    out = F.lit(0)
    for i, f in enumerate(failed):
        out = out + F.when(f, 1 << i).otherwise(0)
    return out.cast("int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just these filters, and how many of them are labelled."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.where("doc_id is not null").select("doc_id", digest(text).alias("text_id"), F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("mask"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text_id", "part", "mask")).alias("_r")).select("doc_id", "_r.*")
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = save(rows.join(marks, "doc_id", "left").select("doc_id", "text_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))

    counts = ("n", "good", "toxic")
    counted = lambda df: df.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    first = save(counted(rows.groupBy("text_id").agg(F.min(F.struct("doc_id", "part", "mask", "good", "toxic")).alias("_r")).select("_r.*")))
    same = F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("mask")
    late = counted(rows).select("part", same, *counts).unionByName(first.select("part", same, *((-F.col(c)).alias(c) for c in counts)))
    return late.unionByName(first).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in counts)).where("n > 0")


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order, step (from 1), filter, bit: every step of every order, 5 * 5! rows."""
    rows = [("".join(p), k + 1, f, 1 << filters.index(f)) for p in permutations(filters) for k, f in enumerate(p)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, bit int")


def verdicts(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """mask, filter_order, step, filter, fails, gone: each mask at each step, whether it fails there and whether it went before."""
    long = steps(spark, filters).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(before), F.lit(0))
    return long.select("mask", "filter_order", "step", "filter", (F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("fails"), (earlier != 0).alias("gone"), (F.col("mask") == F.col("bit")).alias("alone"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and the counts of the step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    long = cells(docs, labels).join(F.broadcast(verdicts(spark)), "mask")  # 2**5 masks at 600 steps
    count = lambda hit, column="n": F.coalesce(F.sum(F.when(hit, F.col(column))), F.lit(0)).cast("long")
    now = F.col("fails") & ~F.col("gone")
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(~F.col("fails") & ~F.col("gone")).alias("kept"), count(now).alias("removed"), count(F.col("fails") & F.col("gone")).alias("redundant"),
        count(F.col("alone")).alias("unique_fails"), count(now, "good").alias("good_lost"), count(now, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
