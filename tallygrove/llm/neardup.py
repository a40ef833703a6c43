"""Near duplicates by SetSketch registers.

A document's set is that of its distinct word shingles. Register i of its sketch is 1 - log_b(h / a), rounded down and cut to
the range 0 to q + 1, where h is the least of the shingles' exponential hashes for i: exponentially spaced, truncated minima
(Ertl, VLDB 2021). Sketches merge by the greater register. Bands of equal registers give candidates; the likelihood of the
registers' order (above, below, equal), together with the sizes, gives a joint estimate; pairs whose estimate is well below
the threshold go, and all others are confirmed on their full sets.

Defined cases: a null text, or one without words, has an empty set and no links; one of fewer words than a shingle has its
whole sequence as one; equal sets are linked; rows with a null doc_id are left out; rows that repeat a doc_id count as the one
of the smallest text; extra columns are ignored; texts and sets are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm import lsh, vec
from tallygrove.llm.common import save, unique_docs

#: Registers of a sketch; bands, each of some of them, drawn: replayed on random sets, these miss 0.003 % of pairs of similarity 0.8 and join 14 % of those of 0.5.
REGISTERS, BANDS, ROWS = 256, 160, 10
_DRAWN = vec.draws_of(BANDS, ROWS, REGISTERS)
#: Parameters of SetSketch.
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: How far below the threshold an estimate drops a pair, in standard deviations of the registers.
SLACK = 5.5
#: Documents whose sketches a task gathers before it groups and sends them.
FLUSH = 20_000
_SAME = np.dtype([("key", "u8"), ("key2", "u8"), ("item", "i8")])
_ITEM = np.dtype([("item", "i8"), ("n", "i8"), ("sketched", "?"), ("sketch", "u2", REGISTERS)])
_OUT = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("sketch", pa.binary())])


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, in order."""
    hashes, begins = vec.words(texts, fold=True)
    shingles = vec.grams(hashes, size)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(vec.distinct(shingles[a : b - size + 1]))
        elif b > a:
            out.append(vec.mix((hashes[a:b] * vec.ODD[: b - a]).sum(keepdims=True) + vec.U64(b - a)))
        else:
            out.append(np.empty(0, vec.U64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The registers (rows) of each of the sets, none of them empty."""
    sizes = np.array([len(x) for x in sets])
    low = vec.minima((np.concatenate(sets) >> vec.U64(32)).astype(np.uint32), np.cumsum(sizes) - sizes, REGISTERS)
    h = -np.log1p(-(low + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood for each pair of sketches (rows), given the sets' sizes."""
    up, down, equal = (a > b).sum(1), (a < b).sum(1), (a == b).sum(1)
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (B - 1) / B) / np.log(B), 1e-12)

    def likelihood(j: np.ndarray) -> np.ndarray:
        above, below = p(u - v * j), p(v - u * j)
        return up * np.log(above) + down * np.log(below) + equal * np.log(np.maximum(1 - above - below, 1e-12))

    lo, hi = np.zeros(len(u)), top
    for _ in range(40):  # concave: a ternary search
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) > likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def _sketch(docs: DataFrame, size: int, n_buckets: int) -> DataFrame:
    def flush(items: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """items: _ITEM rows without their sketches done; keys: two hashes of each whole set."""
        bucket = int(items["item"][0] % n_buckets)
        full = np.flatnonzero(items["n"] > 0)
        order = full[np.lexsort((items["item"][full], keys[1][full], keys[0][full]))]
        k0, k1 = keys[0][order], keys[1][order]
        new = np.ones(len(order), bool)
        new[1:] = (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])
        first = order[new]  # of the copies in hand only the least is banded
        links = np.empty(len(order) - len(first), lsh.STAR)
        links["key"], links["centre"], links["item"] = 0, items["item"][first][np.cumsum(new) - 1][~new], items["item"][order[~new]]
        yield lsh.passed(lsh.SAME + 10, links, bucket)
        items["sketched"] = False
        items["sketched"][first] = True
        same = np.empty(len(first), _SAME)
        same["key"], same["key2"], same["item"] = keys[0][first], keys[1][first], items["item"][first]
        yield lsh.dealt(lsh.SAME, same, n_buckets)
        bands = vec.band_keys(items["sketch"][first].T, _DRAWN)
        least, star = lsh.stars(bands.ravel(), np.tile(items["item"][first], len(bands)))
        yield lsh.dealt(lsh.BAND, least, n_buckets)
        yield lsh.passed(lsh.MEMBER, star, bucket)
        yield lsh.passed(lsh.ITEM, items, bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keyed, n = [], [], 0
        for batch in vec.parts(batches, 1):
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in vec.slices([len(x) for x in texts]):
                sets = shingle_sets(texts[a:b], size)
                items = np.zeros(b - a, _ITEM)
                items["item"], items["n"] = ids[a:b], [len(x) for x in sets]
                keys = np.array([(vec.mix(x).sum(), vec.mix(x * vec.ODD[9] + vec.ODD[8]).sum()) for x in sets], vec.U64).reshape(-1, 2).T
                full = np.flatnonzero(items["n"])
                if len(full):
                    items["sketch"][full] = registers([sets[i] for i in full]).T
                held.append(items)
                keyed.append(keys)
                n += len(items)
                if n >= FLUSH:
                    yield from flush(np.concatenate(held), np.concatenate(keyed, 1))
                    held, keyed, n = [], [], 0
        if n:
            yield from flush(np.concatenate(held), np.concatenate(keyed, 1))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, lsh.PACKED)


def _extra(table: pa.Table) -> Iterator[pa.Table]:
    links = lsh.unpack(table, lsh.SAME + 10, lsh.STAR)
    yield pa.table({"kind": pa.array(np.full(len(links), lsh.SAME), pa.int32()), "a": links["centre"], "b": links["item"]})
    same = lsh.undealt(table, lsh.SAME, _SAME)
    order = np.lexsort((same["item"], same["key2"], same["key"]))
    same = same[order]
    new = np.ones(len(same), bool)
    new[1:] = (same["key"][1:] != same["key"][:-1]) | (same["key2"][1:] != same["key2"][:-1])
    least = same["item"][new][np.cumsum(new) - 1] if len(same) else same["item"]
    yield pa.table({"kind": pa.array(np.full(int((~new).sum()), lsh.SAME), pa.int32()), "a": least[~new], "b": same["item"][~new]})
    items = lsh.unpack(table, lsh.ITEM, _ITEM)
    sketches = [x.tobytes() if s else None for x, s in zip(items["sketch"], items["sketched"], strict=True)]
    yield pa.table({"kind": pa.array(np.full(len(items), lsh.ITEM), pa.int32()), "a": items["item"], "b": items["n"], "sketch": pa.array(sketches, pa.binary())})


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every document.

    Two documents are linked where 100 * intersection >= percent * union of their sets of ``size``-word shingles.
    """
    docs = unique_docs(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs = docs.count()
    n_buckets, tasks = lsh.buckets(n_docs * BANDS), lsh.tasks_for(n_docs)
    rows = save(lsh.grouped(_sketch(docs, size, n_buckets), _extra, "kind int, a bigint, b bigint, c bigint, sketch binary", _OUT), "kind")
    items = rows.where(F.col("kind") == lsh.ITEM).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "sketch")
    members = rows.where(F.col("kind") == lsh.MEMBER).select(F.col("a").alias("key"), F.col("b").alias("centre"), F.col("c").alias("item"))
    bound = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    # What the checks need of every candidate: one pass over the texts, however many rounds follow.
    ids = members.select(F.col("item").alias("doc_id")).unionByName(members.select(F.col("centre").alias("doc_id"))).distinct()
    candidates = save(docs.join(ids.join(items, "doc_id").hint("shuffle_merge"), "doc_id").select(F.col("doc_id").alias("_id"), F.col("n_shingles").alias("_n"), "sketch", "text"))

    @F.pandas_udf("double")
    def likely(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (a, b))
        return pd.Series(estimate(x, y, na.to_numpy(float), nb.to_numpy(float)))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.parts(batches, 2):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            keep = np.zeros(len(a), bool)
            for lo, hi in vec.slices([len(x) + len(y) for x, y in zip(left, right, strict=True)]):
                texts = dict(zip(a[lo:hi], left[lo:hi], strict=True)) | dict(zip(b[lo:hi], right[lo:hi], strict=True))
                sets = dict(zip(texts, shingle_sets(list(texts.values()), size), strict=True))
                for i in range(lo, hi):
                    x, y = sets[a[i]], sets[b[i]]
                    both = vec.common(x, y)
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    def side(x: str, column: str) -> DataFrame:
        return candidates.select(F.col("_id").alias(x), F.col("_n").alias(f"_n{x}"), F.col(column).alias(f"_{x}")).hint("shuffle_merge")

    def verify(pairs: DataFrame) -> DataFrame:
        # Sizes alone rule out many pairs: the intersection is at most the smaller set.
        near = pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").where(100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb"))
        near = save(near.where(likely("_a", "_b", "_na", "_nb") >= bound).select("a", "b"))
        both = near.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "_a", "_b")
        return save(both.mapInArrow(confirm, "a bigint, b bigint"))

    def compare(rows: DataFrame) -> DataFrame:
        known = candidates.select(F.col("_id").alias("item"), "text").hint("shuffle_merge")
        links = lambda t: lsh.block_links(t, "text", lambda texts: shingle_sets([x.encode() for x in texts], size), percent)
        return rows.join(known, "item").groupBy("bucket").applyInArrow(links, "a bigint, b bigint")

    roots = lsh.link(members, rows.where(F.col("kind") == lsh.SAME).select("a", "b"), verify, compare, tasks)
    return items.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
