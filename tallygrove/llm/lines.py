"""Fuzzy line deduplication by MinHash.

A line is taken in lower case. Lines are the same where their texts are; distinct lines have a MinHash signature of their
character shingles, whose bands give candidates; candidates are confirmed by the exact Jaccard similarity of their shingle
sets, and union-find makes classes. Of every class one line stays, the first by (doc_id, line number); all others go from
their documents.

Distinct lines are named by 64-bit hashes and go through the shuffle packed, once for each task; what has the same name is the
same line only if another 64 bits, of its minima, agree too. Texts of lines travel only for candidates.

Defined cases: a null text has no lines and stays null; blank lines stay; a line shorter than a shingle is one shingle; rows
with a null doc_id stay as they are; rows that repeat a doc_id are rows of their own, in the order of a hash of their texts, so
of equal rows one keeps the lines; other columns are kept, whatever their names; lines and texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.llm import lsh, vec
from tallygrove.llm.common import free, save

#: Characters in a shingle.
SHINGLE = 8
#: Bands and the minima of each, none of them in two bands: replayed on random sets of similarity 0.8, these miss 0.003 % of pairs.
BANDS, ROWS = 20, 4
MINIMA = BANDS * ROWS
_DRAWN = vec.own_of(BANDS, ROWS)
PERCENT = 80
#: Lines that a task gathers before it groups and sends them.
FLUSH = 150_000
#: Characters hashed at a time: few enough for a core's own cache.
CHUNK = 300_000
FIRST, GONE = 4, 5
_PLACE = np.dtype([("key", "u8"), ("check", "u8"), ("doc", "i8"), ("line", "i4")])
_OUT = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
_CODES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def hashed_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: hash, whether it is blank, start and stop in the joined texts; then the prefix sums."""
    codes = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    values = _CODES[codes & 0xFFFF]
    if codes.max(initial=0) > 0xFFFF:
        values += (codes >> 16).astype(np.uint64) * vec.ODD[5]
    prefix = vec.sums(values)
    ends = np.flatnonzero(codes == 10)
    start, stop = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(codes)]])
    seen = np.concatenate([[0], np.cumsum((codes != 32) & ((codes < 9) | (codes > 13)))])
    return vec.spans(prefix, start, stop), seen[start] == seen[stop], start, stop, prefix


def _hashes(prefix: np.ndarray) -> np.ndarray:
    """The 64-bit hash of the SHINGLE characters from each place that has so many."""
    _, inverses = vec.powers(len(prefix))
    raw = prefix[SHINGLE:] - prefix[:-SHINGLE]
    raw *= inverses[: len(raw)]
    raw += vec.U64(SHINGLE)
    return vec.mix(raw)


def signatures(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The minima (rows) of each line (columns), none of them empty and all in ascending order."""
    n = len(prefix) - 1
    hashes = np.zeros(n, np.uint32)
    if n >= SHINGLE:
        hashes[: n - SHINGLE + 1] = _hashes(prefix) >> vec.U64(32)
    sizes = stop - start - SHINGLE + 1
    short = sizes < 1
    hashes[start[short]] = vec.spans(prefix, start[short], stop[short]) >> vec.U64(32)
    sizes[short] = 1
    # The places of all shingles, as a mask.
    edge = np.zeros(n + 1, np.int8)
    edge[start] += 1
    np.subtract.at(edge, start + sizes, 1)
    inside = np.cumsum(edge[:n], dtype=np.int8).view(bool)
    return vec.minima(hashes[inside], np.cumsum(sizes) - sizes, MINIMA)


def shingle_hashes(lines: list[str]) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each line, in order."""
    _, _, start, stop, prefix = hashed_lines(lines)
    hashes = _hashes(prefix) if len(prefix) > SHINGLE else np.empty(0, vec.U64)
    whole = vec.spans(prefix, start, stop)
    out = []
    for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        out.append(vec.distinct(hashes[a : b - SHINGLE + 1]) if b - a >= SHINGLE else whole[k : k + 1])
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the Jaccard similarity of two shingle sets is at least ``percent``."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = vec.common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _split(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each line, in the order of keys, and the other ones."""
    rows = rows[np.lexsort((rows["line"], rows["doc"], rows["check"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["check"][1:] != rows["check"][:-1])
    first = rows[new]
    again = first[np.cumsum(new) - 1]
    return first, rows[(rows["doc"] != again["doc"]) | (rows["line"] != again["line"])]


def _scan(docs: DataFrame, n_buckets: int) -> DataFrame:
    """docs: row (unique) and text, neither null."""

    def flush(places: np.ndarray, hashes: np.ndarray, bands: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = int(lsh.buckets_of(places["key"][:1], n_buckets)[0])
        first, again = _split(places)
        yield lsh.passed(GONE, again, bucket)
        yield lsh.dealt(FIRST, first, n_buckets)
        _, once = np.unique(hashes, return_index=True)
        least, star = lsh.stars(bands[:, once].ravel(), np.tile(hashes[once].view(np.int64), BANDS))
        yield lsh.dealt(lsh.BAND, least, n_buckets)
        yield lsh.passed(lsh.MEMBER, star, bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, hashes, bands, n = [], [], [], 0
        for batch in vec.parts(batches, 1):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in vec.slices([len(x) for x in texts], CHUNK):
                found, blank, start, stop, prefix = hashed_lines(texts[a:b])
                if blank.all():
                    continue
                counts = np.array([x.count("\n") + 1 for x in texts[a:b]])
                own = np.empty(len(found), _PLACE)
                own["key"], own["doc"] = found, np.repeat(ids[a:b], counts)
                own["line"] = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
                own = own[~blank]
                _, once, which = np.unique(own["key"], return_index=True, return_inverse=True)
                # Signatures go line by line in the order of the text.
                order = np.argsort(once)
                at = np.flatnonzero(~blank)[once[order]]
                keys = vec.band_keys(signatures(prefix, start[at], stop[at]), _DRAWN)
                check = np.empty(len(once), vec.U64)
                check[order] = vec.mix(keys.sum(0))
                own["check"] = check[which]
                places.append(own)
                hashes.append(found[at])
                bands.append(keys)
                n += len(own)
                if n >= FLUSH:
                    yield from flush(np.concatenate(places), np.concatenate(hashes), np.concatenate(bands, 1))
                    places, hashes, bands, n = [], [], [], 0
        if n:
            yield from flush(np.concatenate(places), np.concatenate(hashes), np.concatenate(bands, 1))

    return docs.mapInArrow(run, lsh.PACKED)


def _extra(table: pa.Table) -> Iterator[pa.Table]:
    first, again = _split(lsh.undealt(table, FIRST, _PLACE))
    again = np.concatenate([again, lsh.unpack(table, GONE, _PLACE)])
    first = first[np.diff(first["key"], prepend=~first["key"][:1]) != 0]  # of different lines of one name, only one has a class
    for kind, rows in ((FIRST, first), (GONE, again)):
        yield pa.table({"kind": pa.array(np.full(len(rows), kind), pa.int32()), "a": rows["key"].view(np.int64), "b": rows["doc"], "c": rows["line"].astype(np.int64)})


def numbered(docs: DataFrame) -> tuple[DataFrame, str, int]:
    """docs with a column that numbers its rows in the order of doc_id, null where the id is; the column's name; all lines.

    The ids number the rows themselves where none of them repeats; else the rows are written once in that order.
    """
    known = docs.where("doc_id is not null and text is not null")
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    most, total = known.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(n_lines).alias("l")).agg(F.max("n"), F.sum("l")).first()
    name = free("_row", docs.columns)
    if (most or 1) == 1 and docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs.withColumn(name, F.col("doc_id").cast("long")), name, total or 0
    order = ("doc_id", F.xxhash64("text"))
    ordered = docs.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    return save(ordered.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()))), name, total


def repeats(docs: DataFrame, n_lines: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, lines: the numbers (from 0) of the lines that go from each document that loses any.

    docs: doc_id (a unique long, here the number of a row) and text, neither null; n_lines: how many lines they have.
    """
    n_buckets, tasks = lsh.buckets(n_lines * BANDS), lsh.tasks_for(n_lines // 10)
    rows = save(lsh.grouped(_scan(docs, n_buckets), _extra, "kind int, a bigint, b bigint, c bigint", _OUT), "kind")
    members = rows.where(F.col("kind") == lsh.MEMBER).select(F.col("a").alias("key"), F.col("b").alias("centre"), F.col("c").alias("item"))
    firsts = rows.where(F.col("kind") == FIRST).select(F.col("a").alias("item"), F.col("b").alias("doc_id"), F.col("c").alias("line"))
    items = members.select("item").unionByName(members.select(F.col("centre").alias("item"))).distinct()
    wanted = firsts.join(items, "item").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), "item")).alias("_wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.parts(batches, 0):
            names, found = [], []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split = text.split("\n")
                for x in own:
                    names.append(x["item"])
                    found.append(split[x["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.string())], ["item", "line"])

    texts = save(docs.join(wanted, "doc_id").select("text", "_wanted").mapInArrow(cut, "item bigint, line string"))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        left, right = a.tolist(), b.tolist()
        for lo, hi in vec.slices([len(x) + len(y) for x, y in zip(left, right, strict=True)]):
            own = list(dict.fromkeys(left[lo:hi] + right[lo:hi]))  # a line comes in many pairs
            sets = dict(zip(own, shingle_hashes(own), strict=True))
            for i in range(lo, hi):
                out[i] = similar(sets[left[i]], sets[right[i]], percent)
        return pd.Series(out)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("item").alias("a"), F.col("line").alias("_la")), "a").join(texts.select(F.col("item").alias("b"), F.col("line").alias("_lb")), "b")
        return save(both.where(alike("_la", "_lb")).select("a", "b"))

    def compare(rows: DataFrame) -> DataFrame:
        links = lambda t: lsh.block_links(t, "line", shingle_hashes, percent)
        return rows.join(texts.hint("shuffle_merge"), "item").groupBy("bucket").applyInArrow(links, "a bigint, b bigint")

    roots = lsh.link(members, None, verify, compare, tasks)
    classed = save(firsts.join(roots.withColumnRenamed("node", "item"), "item").select("root", "doc_id", "line"))
    kept = classed.groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("_kept"))
    more = classed.join(kept, "root").where(F.struct("doc_id", "line") != F.col("_kept")).select("doc_id", "line")
    gone = rows.where(F.col("kind") == GONE).select(F.col("b").alias("doc_id"), F.col("c").alias("line")).unionByName(more)
    return gone.groupBy("doc_id").agg(F.collect_set(F.col("line").cast("int")).alias("lines"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all its columns, its texts without the lines that go, and two more: how many lines there were, and went.

    The two are n_lines_ and n_removed_, with more underscores where ``docs`` has such columns; they are always the last.
    """
    names = docs.columns
    at = names.index("text")
    docs, row, n_lines = numbered(docs)
    gone = repeats(docs.where(F.col(row).isNotNull() & F.col("text").isNotNull()).select(F.col(row).alias("doc_id"), "text"), n_lines, percent)
    gone_id, gone_lines = free("_gone_id", names), free("_gone_lines", names)
    joined = docs.join(gone.select(F.col("doc_id").alias(gone_id), F.col("lines").alias(gone_lines)), F.col(row) == F.col(gone_id), "left").select(*names, gone_lines)
    total_name, removed_name = free("n_lines_", names), free("n_removed_", names)
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(total_name, T.LongType()), T.StructField(removed_name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.parts(batches, at):
            out, total, removed = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                total.append(text.count("\n") + 1 if text is not None else 0)
                drop = set(drop or ()) if text is not None else set()
                out.append(text if not drop else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
                removed.append(len(drop))
            columns = [pa.array(out, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, total_name, removed_name])

    return joined.mapInArrow(run, schema)
