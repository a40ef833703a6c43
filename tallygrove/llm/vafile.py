"""Exact top-k search by inner product over a vector-approximation file.

Components are whole numbers, floor(scale * x). Each dimension is cut into cells at quantiles of a bounded sample; the outer
cells end at the least and greatest value of all rows, so a cell holds every value that it is written for. The approximation
file has a byte a dimension, its cell. From cells alone a vector's product with a query lies within its centre's product and,
on both sides, the half widths' product with the query's absolute components.

1. Scan: every approximation is bounded against a block of queries, as matrix products. A task keeps for each query its best
   lower bounds and drops what lies above none of them; what is left is cut again by the best lower bounds of all tasks.
2. Exact vectors are read in the order of their upper bounds, in rounds that grow, until no unread bound reaches the k-th
   result. What equals it is read, so ties are exact.

The queries are a stated set, taken in blocks of at most ``BLOCK`` numbers, each broadcast and run against all rows; so a
worker's matrices are bounded. Equal vectors are one entry with its k + 1 smallest ids, which is all that any result can name:
a vector that a third of all rows share costs as much as one, and equal queries are searched once.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; vectors of different lengths
are not compared; rows that repeat a vec_id count as the one of the smallest vector; rows without a vec_id are left out; a
query's own row is no result, equal vectors under other ids are; fewer candidates than k are all results; no queries give no
rows; values whose products need more than 62 bits raise a ValueError; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import save

#: Cells of a dimension, and the vectors that they are fitted on.
CELLS, SAMPLE = 64, 10_000
#: Numbers in a block of queries, and in a matrix of bounds.
BLOCK, MATRIX = 2_000_000, 2_000_000
#: Parts that a class of equal vectors is dealt to where its rows are joined.
SALT = 16


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: the vectors that take part, as whole numbers."""
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"))
    ids = rows.groupBy("vec_id").count()
    return rows if ids.where("count > 1").isEmpty() else rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _dealt(many: DataFrame, few: DataFrame, on: list[str], by: str) -> DataFrame:
    """An inner join in which the rows of a key of ``many`` go to SALT tasks, and those of ``few`` to all of them."""
    many = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    return many.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*on, "_salt"]).drop("_salt")


class Cells:
    """The cells of all dimensions of vectors of one length: ``cuts`` by dimension, and the bounds of each cell."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, greatest: np.ndarray, n: int = CELLS):
        self.cuts = [np.unique(np.ceil(np.quantile(sample[:, d], np.arange(1, n) / n)).astype(np.int64)) for d in range(sample.shape[1])]
        self.low, self.high = np.zeros((2, sample.shape[1], n))
        for d, cuts in enumerate(self.cuts):
            low, high = np.concatenate([[least[d]], cuts]), np.concatenate([cuts - 1, [greatest[d]]])
            self.low[d, : len(low)], self.high[d, : len(high)] = np.minimum(low, high), np.maximum(low, high)

    def codes(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, v[:, d], side="right") for d, cuts in enumerate(self.cuts)], 1).astype(np.uint8)

    def bounds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centre and half width of each component's cell."""
        d = np.arange(codes.shape[1])
        low, high = self.low[d, codes], self.high[d, codes]
        return (low + high) / 2, (high - low) / 2


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _scan(approximations: DataFrame, cells: Cells, names: np.ndarray, queries: np.ndarray, k: int, slack: float) -> DataFrame:
    """query, entry, lower, upper: for each query the entries that may be among its ``k`` best."""
    shared = approximations.sparkSession.sparkContext.broadcast((cells, names, queries.T.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, names, turned = shared.value
        size, best, held, n_held = np.abs(turned), np.full((k, turned.shape[1]), -np.inf), [], 0

        def out() -> pa.RecordBatch:
            at, entry, lower, upper = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = upper >= best.min(0)[at]
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (names[at], entry, lower, upper)], ["query", "entry", "lower", "upper"])

        step = max(1, MATRIX // turned.shape[1])
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, turned.shape[0])
            entries = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(codes), step):
                centre, half = cells.bounds(codes[i : i + step])
                middle, spread = centre @ turned, half @ size + slack
                lower, upper = middle - spread, middle + spread
                best = np.partition(np.concatenate([best, lower]), -k, axis=0)[-k:]
                row, at = np.nonzero(upper >= best.min(0))
                held.append((at, entries[i + row], lower[row, at], upper[row, at]))
                n_held += len(row)
                if n_held > MATRIX:
                    yield out()
                    held, n_held = [], 0
        if held:
            yield out()

    return approximations.mapInArrow(run, "query bigint, entry bigint, lower double, upper double")


def _best(rows: DataFrame, k: int, order: str, name: str) -> DataFrame:
    """query and its ``k``-th greatest ``order``, of queries that have as many rows."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(order), "entry"))
    return rows.withColumn("_rn", place).where(F.col("_rn") <= k).groupBy("query").agg(F.min(F.when(F.col("_rn") == k, F.col(order))).alias(name))


def _exact(wanted: DataFrame, entries: DataFrame, names: np.ndarray, queries: np.ndarray) -> DataFrame:
    """query, entry, score, ids: the exact products of the wanted pairs."""
    shared = wanted.sparkSession.sparkContext.broadcast((names, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        for batch in batches:
            at = np.searchsorted(names, batch.column(0).to_numpy(zero_copy_only=False))
            score = np.einsum("ij,ij->i", _matrix(batch.column(3), queries.shape[1]), queries[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), batch.column(2)], ["query", "entry", "score", "ids"])

    return wanted.join(entries, "entry").select("query", "entry", "ids", "v").mapInArrow(run, "query bigint, entry bigint, score bigint, ids array<bigint>")


def _searched(entries: DataFrame, approximations: DataFrame, cells: Cells, names: np.ndarray, queries: np.ndarray, k: int, slack: float) -> DataFrame:
    """query, vec_id, score: the ``k`` best rows of each query of a block, its own among them."""
    found = save(_scan(approximations, cells, names, queries, k, slack))
    found = found.join(_best(found, k, "lower", "least"), "query").where("least is null or upper >= least")
    found = save(found.select("query", "entry", "upper", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "entry")).alias("place")))
    read, many, rest, scored = 0, 4 * k, found, None
    while True:
        got = save(_exact(rest.where(F.col("place") <= read + many).select("query", "entry"), entries, names, queries))
        scored = got if scored is None else scored.unionByName(got)
        read, many = read + many, 4 * many
        rest = found.where(F.col("place") > read).join(_best(scored, k, "score", "kth"), "query").where("kth is null or upper >= kth")
        if rest.isEmpty():
            break
    rows = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_rn") <= k).drop("_rn")


def _blocks(entries: DataFrame, d: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names (ascending) and vectors of the queries, a bounded block at a time."""
    rows: list = []
    for r in entries.select("entry", "v").toLocalIterator():
        rows.append((r["entry"], r["v"]))
        if len(rows) * d >= most:
            yield _sorted(rows)
            rows = []
    if rows:
        yield _sorted(rows)


def _sorted(rows: list) -> tuple[np.ndarray, np.ndarray]:
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def search(vectors: DataFrame, wanted: Column, k: int = 5, scale: int = 256, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is ``wanted`` (a condition on vec_id) the ``k`` other rows of greatest product."""
    spark = vectors.sparkSession
    rows = whole(vectors, scale).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    same = ["_h", "_g"]
    ids = save(rows.select("vec_id", F.size("v").alias("d"), F.xxhash64("v").alias("_h"), F.xxhash64(F.lit(1), "v").alias("_g")))
    first = ids.withColumn("_rn", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("_rn") <= k + 1)
    classes = save(first.groupBy(*same).agg(F.min("vec_id").alias("entry"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    queries = save(_dealt(ids.where(wanted), classes.select(*same, "entry"), same, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"), "d"))
    entries = save(rows.withColumnRenamed("vec_id", "entry").join(classes.select("entry", "ids"), "entry"))
    best = []
    for d in sorted(r["d"] for r in queries.select("d").distinct().collect()):  # one for each length of vectors
        own = entries.where(F.size("v") == d)
        ends = own.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x"), F.max("x")).orderBy("at").collect()  # a row for each dimension
        least, greatest = (np.array([r[i] for r in ends]) for i in (1, 2))
        top = max(abs(int(least.min())), abs(int(greatest.max())))
        if d * top * top >= 1 << 62:
            raise ValueError("products of these vectors need more than 62 bits")
        slack = 0.0 if d * top * top < 1 << 50 else d * top * top * 2.0**-44
        sample = np.array([r["v"] for r in own.select("v", F.xxhash64("entry").alias("_o")).orderBy("_o").limit(SAMPLE).collect()], np.int64)
        grid = Cells(sample, least, greatest, cells)
        shared = spark.sparkContext.broadcast(grid)

        def encode(batches: Iterator[pa.RecordBatch], shared=shared, d=d) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = shared.value.codes(_matrix(batch.column(1), d)) if len(batch) else np.zeros((0, d), np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["entry", "cells"])

        approximations = save(own.select("entry", "v").mapInArrow(encode, "entry bigint, cells binary"))
        asked = own.join(queries.select(F.col("query").alias("entry")).distinct(), "entry", "left_semi")
        best += [save(_searched(own, approximations, grid, names, block_of, k + 1, slack)) for names, block_of in _blocks(asked, d, block)]
    if not best:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = _dealt(queries.drop("d"), reduce(DataFrame.unionByName, best), ["query"], "query_id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
