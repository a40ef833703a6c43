"""Ranked lexical search by the three-phase uniform threshold algorithm over term-partitioned postings.

The items are a query set: they are taken in blocks of at most ``BLOCK_TERMS`` terms (a longer item is a block), and what a
block brings to the workers, its terms and which items hold them, has that bound. For each block one scan of the documents
counts the block's terms in every document. The counts become postings, dealt out by range of (term, impact), so that a list
lies in descending order and a term that most documents hold is spread over many tasks.

1. Heads: the k greatest impacts of every list. Their partial sums give each item a k-th sum, the lower bound t1.
2. Uniform threshold: of all m lists of an item what reaches t1 / m is fetched and summed by document. A document that none of
   the lists shows stays below t1. A list that does not show a document adds less than the threshold, and no more than its
   greatest entry, which gives the upper bound. Documents that cannot reach the k-th exact sum of those in the heads go at
   once, and then those that cannot reach the k-th sum of what was fetched.
3. Exact scores of the candidates left, looked up in the documents' counts.

Sums, weights and bounds are 64-bit integers, and what equals a bound stays, so the ranking with its ties is exact.

Terms are named by 64-bit hashes of their folded bytes and their length. Defined cases: a null text has no terms, and a
document without terms is no document for the statistics; items that repeat an id count as the one of the smallest text, and
so do documents; rows without an id are left out; a term repeated in an item counts as often; extra columns are ignored; items
without terms, or without a document above 0, have no rows; texts are taken whole, a long one in pieces cut between terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.llm import vec
from tallygrove.llm.common import save, unique_docs

#: Terms (with repeats) of the items in one pass.
BLOCK_TERMS = 200_000
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_SEPARATOR = re.compile(b"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_IN_TERM = np.array([_SEPARATOR.match(bytes([i])) is None for i in range(256)])
_FOLD = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_FOLD))


def blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[list[tuple[object, Counter]]]:
    """(item_id, its terms) of each item that has any, a bounded block at a time."""
    block: list[tuple[object, Counter]] = []
    size = 0
    for row in items.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")).toLocalIterator():
        found = terms_of(row["text"])
        if block and size + len(found) > most:
            yield block
            block, size = [], 0
        if found:
            block.append((row["item_id"], Counter(found)))
            size += len(found)
    if block:
        yield block


def _pieces(texts: list[bytes], most: int = vec.CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts and the rows that they come from, about ``most`` bytes at a time; longer texts are cut behind a separator."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = _SEPARATOR.search(text, at + most) if len(text) - at > most else None
            stop = cut.end() if cut else len(text)
            rows.append(i)
            parts.append(text[at:stop])
            size, at = size + stop - at, stop
            if size >= most:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def _hashed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length and part of every term."""
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    change = np.diff(_IN_TERM[raw].view(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return vec.spans(vec.sums(vec._FOLDED[raw]), start, stop), stop - start, np.searchsorted(begins, start, side="right") - 1


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all its terms, with repeats), terms and tfs: places in ``terms`` and how often; documents without any term are left out."""
    hashes, sizes, _ = _hashed([t.encode() for t in terms])
    order = np.argsort(hashes)
    if len(np.unique(hashes)) < len(terms):
        raise ValueError("two terms have the same hash")
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], sizes[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths, places = shared.value
        for batch in vec.parts(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n, hits = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
            for rows, parts in _pieces(texts):
                found, size, part = _hashed(parts)
                row = np.array(rows, np.int64)[part]
                n += np.bincount(row, minlength=len(texts))
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = (known[at] == found) & (lengths[at] == size)
                hits.append(row[hit] * len(known) + places[at[hit]])
            pair, tf = np.unique(np.concatenate(hits), return_counts=True)
            offsets = np.searchsorted(pair, np.arange(len(texts) + 1) * len(known)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (pair % len(known), tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n bigint, terms array<int>, tfs array<int>").fields])
    return unique_docs(docs).select("doc_id", "text").mapInArrow(run, schema)


def _kth(sums: DataFrame, k: int, score: str) -> dict:
    """The k-th greatest score of each item that has as many: a number for each item of a block."""
    ranked = sums.withColumn("_rn", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(score), "doc_id"))).where(F.col("_rn") <= k)
    return {r["item_id"]: r["s"] for r in ranked.where(F.col("_rn") == k).select("item_id", F.col(score).alias("s")).collect()}


def _ranked(docs: DataFrame, items: DataFrame, block: list[tuple[object, Counter]], k: int) -> DataFrame:
    spark, item = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    names = sorted({t for _, found in block for t in found})
    place = {t: i for i, t in enumerate(names)}
    counts = save(counted(docs, names))
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row for each term of the block
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in held.items()}
    # What any list can add: terms in no document or of weight 0 are in no list.
    lists = [(place[t], i, tf) for i, found in block for t, tf in found.items() if weight.get(place[t])]
    if not lists:
        return spark.createDataFrame([], f"item_id {item}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")

    def small(rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, schema))  # bounded by the block

    impact = F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8L * (25L + (75L * n * {n_docs}L) div {n_terms}L)))")
    weights = small(sorted((t, w) for t, w in weight.items() if w), "term int, w bigint")

    def entries(rows: DataFrame, *keep: str) -> DataFrame:
        """A row for each term that a document holds, with its impact."""
        flat = rows.select(*keep, "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("_e"))
        return flat.select(*keep, "doc_id", "n", F.col("_e.terms").alias("term"), F.col("_e.tfs").alias("tf")).join(weights, "term").select(*keep, "term", "doc_id", impact.alias("impact"))

    postings = entries(counts).where("impact > 0").repartitionByRange("term", F.desc("impact"), "doc_id").sortWithinPartitions("term", F.desc("impact"), "doc_id")
    postings = save(postings)
    both = small(lists, f"term int, item_id {item}, times int")

    def exact(pairs: DataFrame) -> DataFrame:
        """item_id, doc_id, score of the given pairs, from the documents' counts."""
        return entries(pairs.join(counts, "doc_id"), "item_id").join(both, ["term", "item_id"]).groupBy("item_id", "doc_id").agg(F.sum(F.col("impact") * F.col("times")).alias("score"))

    by_list = Window.partitionBy("term").orderBy(F.desc("impact"), "doc_id")
    heads = save(postings.withColumn("_rn", F.row_number().over(by_list)).where(F.col("_rn") <= k))
    greatest = dict(heads.where("_rn = 1").select("term", "impact").collect())  # a row for each term of the block
    seen = save(heads.join(both, "term").groupBy("item_id", "doc_id").agg(F.sum(F.col("impact") * F.col("times")).alias("partial")))
    first, sure = _kth(seen, k, "partial"), _kth(exact(seen.select("item_id", "doc_id")), k, "score")
    n_lists = Counter(i for _, i, _ in lists)
    threshold = {i: -(-first.get(i, 0) // n) for i, n in n_lists.items()}
    rows = [(t, i, tf, threshold[i], max(0, min(tf * greatest[t], threshold[i] - 1))) for t, i, tf in lists if t in greatest]
    unseen = Counter()
    for _, i, _, _, most in rows:
        unseen[i] += most
    # Dealt out by document, so that the sums of all items need no shuffle of their own.
    fetched = postings.repartition("doc_id").join(small(rows, f"term int, item_id {item}, times int, threshold bigint, most bigint"), "term").where("impact * times >= threshold")
    sums = fetched.groupBy("item_id", "doc_id").agg(F.sum(F.col("impact") * F.col("times")).alias("partial"), F.sum("most").alias("shown"))
    bounds = small([(i, unseen[i], sure.get(i, 0)) for i in n_lists], f"item_id {item}, unseen bigint, least bigint")
    sums = save(sums.join(bounds, "item_id").select("item_id", "doc_id", "partial", (F.col("partial") + F.col("unseen") - F.col("shown")).alias("upper"), "least").where("upper >= least").drop("least"))
    second = _kth(sums, k, "partial")
    least = small([(i, max(second.get(i, 0), sure.get(i, 0))) for i in n_lists], f"item_id {item}, least bigint")
    scored = exact(save(sums.join(least, "item_id").where("upper >= least").select("item_id", "doc_id")))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, most: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents of the highest scores above 0, equal ones by ascending doc_id."""
    found = [save(_ranked(docs, items, block, k)) for block in blocks(items, most)]
    empty = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], empty)
