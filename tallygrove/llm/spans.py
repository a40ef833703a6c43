"""Substring deduplication by a compacted de Bruijn graph.

Windows of ``WINDOW`` words are the edges of a de Bruijn graph, the ``WINDOW`` - 1 words at either end of one its nodes. Only
edges that repeat matter, so the graph is built from those alone:

- Windows in a row that share their minimizer (the least ``GRAM``-word gram inside, the leftmost of equal ones) make a run. Equal
  windows have equal minimizers at equal offsets, so grouping the runs by minimizer over all documents shows what repeats: a
  minimizer whose runs are all equal gives one piece, a path of several edges; one whose runs differ is opened, and its windows
  are grouped by their own hash, each that repeats being a piece of one edge. (What a task has found of an opened minimizer's
  equal runs stays with the run.)
- A piece knows its first source coordinates (doc_id, word) and its end nodes. A Spark aggregation counts the pieces that end and
  begin at each node, a join marks the nodes with one of each, and there the pieces that follow each other in their source are
  compacted into one nonbranching path.
- All other occurrences of the pieces are joined to the paths and merged into long spans, each with the coordinates of its
  source. A digest of the words at the source coordinates goes to every span of it, and a span is removed only if the words
  at its own place have that digest.

Each task sends a minimizer, a run or a window once however often it has it, so one passage that a third of all documents share
is an entry for each task. Hashes (128 bits for runs, 96 for windows, 64 for nodes, over 64-bit word hashes) only propose; BLAKE2 digests of
128 bits over the words themselves decide.

Defined cases: a null text has no words; texts of fewer words than a window keep all; rows with a null doc_id are left out;
rows that repeat a doc_id count as the one of the smallest text; extra columns are ignored; texts are whole, whatever their
number of words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm import lsh, vec
from tallygrove.llm.common import save, unique_docs

#: Words of a window, and of a minimizer.
WINDOW, GRAM = 20, 8
#: Entries that a task gathers before it groups and sends them.
FLUSH = 1_500_000
#: Windows whose minimizers are found at a time: their places fit the bits that a packed gram has for them.
SEGMENT = 1 << 25
_PLACE_BITS = vec.U64(26)
_PLACES = vec.U64((1 << 26) - 1)
RUN, CHECK, AGAIN, PIECE, OPENED = 0, 1, 2, 3, 4
#: Bits of ``flags``: the task has more of the same; the task has others of the same minimizer.
MANY, BRANCHES = 1, 2
_RUN = np.dtype([("key", "u8"), ("unit", "u8"), ("doc", "i8"), ("start", "i4"), ("n", "u1"), ("flags", "u1"), ("head", "u8"), ("tail", "u8")])
_SPAN = np.dtype([("doc", "i8"), ("start", "i4"), ("n", "i4")])
_AGAIN = np.dtype([("piece", "i8"), ("doc", "i8"), ("start", "i4"), ("n", "u1")])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_OUT = "kind int, piece bigint, doc_id bigint, start int, n int, head bigint, tail bigint"


def _first(rows: np.ndarray, *fields: str) -> np.ndarray:
    """Which rows, in their order, have other values of ``fields`` than the one before."""
    out = np.ones(len(rows), bool)
    if len(rows):
        out[1:] = np.logical_or.reduce([rows[f][1:] != rows[f][:-1] for f in fields])
    return out


def _as(rows: np.ndarray, dtype: np.dtype) -> np.ndarray:
    out = np.empty(len(rows), dtype)
    for f in dtype.names:
        out[f] = vec.mix(rows["key"] * vec.ODD[12] + rows["unit"]).view(np.int64) if f == "piece" else rows[f]
    return out


def _nodes(rows: np.ndarray, prefix: np.ndarray, at: np.ndarray) -> None:
    """Fills in the nodes at which the windows from each place begin and end; places are those of the hashed words."""
    stop = at + rows["n"]
    rows["head"] = vec.spans(prefix, at, at + WINDOW - 1)
    rows["tail"] = vec.spans(prefix, stop, stop + WINDOW - 1)


def runs(texts: list[bytes], segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """The runs of all texts (doc: the text's number), and for each text where its words begin."""
    hashes, begins = vec.words(texts, fold=False)
    text = np.repeat(np.arange(len(texts)), np.diff(begins))
    found = [np.empty(0, _RUN)]
    gram, prefix = vec.grams(hashes, GRAM), vec.sums(hashes)
    for lo in range(0, len(hashes) - WINDOW + 1, segment):
        own = gram[lo : lo + segment + WINDOW - GRAM]
        low = own >> _PLACE_BITS << _PLACE_BITS | np.arange(len(own), dtype=vec.U64)
        for step in (1, 2, 4, WINDOW - GRAM + 1 - 8):  # minima of 2, 4, 8, then 13 grams in a row
            low = np.minimum(low[:-step], low[step:])
        windows = np.flatnonzero(text[lo : lo + len(low)] == text[lo + WINDOW - 1 : lo + WINDOW - 1 + len(low)])
        place = (low[windows] & _PLACES).astype(np.int64)
        at = np.flatnonzero(np.diff(place, prepend=-1))
        if not len(at):
            continue
        out = np.empty(len(at), _RUN)
        start, n, place = windows[at] + lo, np.diff(at, append=len(windows)), place[at]
        # Minimizers are small numbers; mixed, they are dealt evenly.
        out["key"], out["n"], out["doc"], out["flags"] = vec.mix(own[place]), n, text[start], 0
        out["unit"] = vec.mix(vec.spans(prefix, start, start + n + WINDOW - 1) + (place + lo - start).astype(vec.U64) * vec.ODD[11])
        out["start"] = start - begins[out["doc"]]
        _nodes(out, prefix, start)
        found.append(out)
    return np.concatenate(found), begins


def _settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal rows in hand the first, by (key, unit), and the other ones."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["unit"], rows["key"]))]
    new = _first(rows, "key", "unit")
    many = np.diff(np.flatnonzero(new), append=len(rows)) > 1
    once = rows[new]
    once["flags"][many] |= MANY
    return once, _as(rows[~new], _AGAIN)


def _scan_runs(docs: DataFrame, n_buckets: int) -> DataFrame:
    def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = int(lsh.buckets_of(rows["key"][:1], n_buckets)[0])
        once, again = _settle(rows)
        alone = _first(once, "key")
        count = np.diff(np.flatnonzero(alone), append=len(once))
        branches = np.repeat(count > 1, count)
        once["flags"][branches] |= BRANCHES
        yield lsh.passed(AGAIN, again, bucket)
        yield lsh.passed(CHECK, _as(once[branches], _SPAN), bucket)
        # What branches here is opened anyway: only a mark goes on, and what was found again.
        yield lsh.dealt(RUN, once[~branches | alone | (once["flags"] & MANY > 0)], n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in vec.parts(batches, 1):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in vec.slices([len(x) for x in texts]):
                rows, _ = runs(texts[a:b])
                rows["doc"] = ids[a:b][rows["doc"]]
                held.append(rows)
                n += len(rows)
                if n >= FLUSH:
                    yield from flush(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from flush(np.concatenate(held))

    return docs.mapInArrow(run, lsh.PACKED)


def _rows(parts: list[tuple[int, np.ndarray]]) -> pa.Table:
    out = []
    for kind, x in parts:
        column = lambda f, t, x=x: pa.array(x[f].astype(t)) if f in x.dtype.names else pa.nulls(len(x), pa.from_numpy_dtype(t))
        node = lambda f, x=x: pa.array(x[f].copy().view(np.int64)) if f in x.dtype.names else pa.nulls(len(x), pa.int64())
        out.append(pa.table({"kind": np.full(len(x), kind, np.int32), "piece": column("piece", np.int64), "doc_id": column("doc", np.int64), "start": column("start", np.int32), "n": column("n", np.int32), "head": node("head"), "tail": node("tail")}))
    return pa.concat_tables(out)


_PIECE = np.dtype([("piece", "i8"), ("doc", "i8"), ("start", "i4"), ("n", "i4"), ("head", "u8"), ("tail", "u8")])


def _join_runs(table: pa.Table) -> pa.Table:
    """One bucket of minimizers. Where a minimizer does not branch, what repeats is a PIECE and all its runs but the first are AGAIN, else CHECK."""
    rows = lsh.undealt(table, RUN, _RUN)
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["unit"], rows["key"]))]
    new = _first(rows, "key", "unit")
    at = np.flatnonzero(new)
    several = np.bitwise_or.reduceat(rows["flags"], at) & MANY > 0 if len(at) else np.empty(0, bool)
    several |= np.diff(at, append=len(rows)) > 1
    alone = _first(rows, "key")
    starts = np.flatnonzero(alone)
    group = np.cumsum(alone) - 1
    branching = np.bitwise_or.reduceat(rows["flags"], starts) & BRANCHES > 0 if len(starts) else np.empty(0, bool)
    branching |= np.add.reduceat(new.astype(np.int64), starts) > 1 if len(starts) else False
    opened = branching[group] if len(rows) else np.empty(0, bool)
    # Where a minimizer branches, its edges come from the windows, and a run only serves the occurrences that tasks have found themselves.
    held = np.zeros(len(at), bool)
    if len(at):
        held = opened[at] & (np.bitwise_or.reduceat(rows["flags"], at) & MANY > 0)
        several &= ~opened[at]
    sent = rows["flags"] & BRANCHES > 0
    return _rows([(PIECE, _as(rows[at[several]], _PIECE)), (OPENED, _as(rows[at[held]], _PIECE)), (AGAIN, _as(rows[~opened & ~new], _AGAIN)), (CHECK, _as(rows[opened & ~sent], _SPAN)), (AGAIN, lsh.unpack(table, AGAIN, _AGAIN)), (CHECK, lsh.unpack(table, CHECK, _SPAN))])


def _scan_windows(docs: DataFrame, n_buckets: int) -> DataFrame:
    """docs: doc_id, text, spans (start, n)."""

    def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        once, again = _settle(rows)
        yield lsh.passed(AGAIN, again, int(lsh.buckets_of(rows["key"][:1], n_buckets)[0]))
        yield lsh.dealt(RUN, once, n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in vec.parts(batches, 1):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            lists = batch.column(2)
            offsets, inner = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            starts, sizes = inner.field(0).to_numpy().astype(np.int64), inner.field(1).to_numpy().astype(np.int64)
            for a, b in vec.slices([len(x) for x in texts]):
                hashes, begins = vec.words(texts[a:b], fold=False)
                own = slice(offsets[a], offsets[b])
                doc = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                n_own, total = sizes[own], int(sizes[own].sum())
                at = np.repeat(starts[own] + begins[doc], n_own) + np.arange(total) - np.repeat(np.cumsum(n_own) - n_own, n_own)
                which = np.repeat(doc, n_own)
                rows, prefix = np.empty(total, _RUN), vec.sums(hashes)
                rows["key"] = vec.spans(prefix, at, at + WINDOW)
                rows["unit"] = vec.spans(vec.sums(vec.mix(hashes)), at, at + WINDOW) >> vec.U64(32)
                rows["doc"], rows["start"], rows["n"], rows["flags"] = ids[a:b][which], at - begins[which], 1, 0
                _nodes(rows, prefix, at)
                held.append(rows)
                n += total
                if n >= FLUSH:
                    yield from flush(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from flush(np.concatenate(held))

    return docs.mapInArrow(run, lsh.PACKED)


def _join_windows(table: pa.Table) -> pa.Table:
    rows = lsh.undealt(table, RUN, _RUN)
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["unit"], rows["key"]))]
    new = _first(rows, "key", "unit")
    at = np.flatnonzero(new)
    several = np.bitwise_or.reduceat(rows["flags"], at) & MANY > 0 if len(at) else np.empty(0, bool)
    several |= np.diff(at, append=len(rows)) > 1
    return _rows([(PIECE, _as(rows[at[several]], _PIECE)), (AGAIN, _as(rows[~new], _AGAIN)), (AGAIN, lsh.unpack(table, AGAIN, _AGAIN))])


def paths(pieces: DataFrame) -> DataFrame:
    """pieces: piece, doc_id, start, n, head, tail. piece, source (doc_id), source_start and path: the start, in the source, of the piece's path.

    A piece goes on with the path of the one before it in its source where the node between them has one piece in and one out.
    """
    ends = pieces.select(F.col("tail").alias("_node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(pieces.select(F.col("head").alias("_node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    unbranched = ends.groupBy("_node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i = 1 and o = 1").select("_node", F.lit(True).alias("_one"))
    along = Window.partitionBy("doc_id").orderBy("start")
    marked = pieces.join(unbranched, pieces["head"] == unbranched["_node"], "left").select("piece", "doc_id", "start", "n", "head", "tail", F.coalesce("_one", F.lit(False)).alias("_one"))
    goes_on = F.col("_one") & (F.lag("tail").over(along) == F.col("head")) & (F.lag(F.col("start") + F.col("n")).over(along) == F.col("start"))
    marked = marked.withColumn("_begin", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("start")))
    return marked.select("piece", F.col("doc_id").alias("source"), F.col("start").alias("source_start"), F.max("_begin").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("path"))


def spans_of(again: DataFrame, pathed: DataFrame) -> DataFrame:
    """again: piece, doc_id, start, n. doc_id, start, n, source, source_start of long spans: what follows along one path of one source, as one."""
    rows = again.join(pathed, "piece").withColumn("_shift", F.col("start") - F.col("source_start"))
    own = Window.partitionBy("doc_id", "source", "path", "_shift").orderBy("start")
    rows = rows.withColumn("_new", F.when(F.lag(F.col("start") + F.col("n")).over(own) == F.col("start"), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("doc_id", "source", "path", "_shift", "_island").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"))
    return merged.select("doc_id", "start", "n", "source", (F.col("start") - F.col("_shift")).alias("source_start"))


def word_digest(words: list[bytes], start: int, n: int) -> bytes:
    """Of the words that ``n`` windows in a row from ``start`` cover."""
    return hashlib.blake2b(b" ".join(words[start : start + n + WINDOW - 1]), digest_size=16).digest()


def _digests(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, spans (start, n). source, source_start, n, digest of each span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.parts(batches, 1):
            ids, starts, sizes, digests = [], [], [], []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                for x in spans:
                    ids.append(doc)
                    starts.append(x["start"])
                    sizes.append(x["n"])
                    digests.append(word_digest(words, x["start"], x["n"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], ["source", "source_start", "n", "digest"])

    return docs.mapInArrow(run, "source bigint, source_start int, n int, digest binary")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, spans (start, n, digest): the windows of each document whose words also start earlier, n windows in a row from
    start, with the digest of the words at the earlier place.

    docs: doc_id (unique, not null) and text (not null).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A run is 7 windows on the average, and a window has 2 characters a word at least.
    n_buckets = lsh.buckets((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 50)
    found = save(_scan_runs(docs, n_buckets).groupBy("bucket").applyInArrow(_join_runs, _OUT), "kind")
    listed = F.collect_list(F.struct("start", "n")).alias("spans")
    check = found.where(F.col("kind") == CHECK).groupBy("doc_id").agg(listed)
    windows = save(_scan_windows(docs.join(check, "doc_id").select("doc_id", "text", "spans"), n_buckets).groupBy("bucket").applyInArrow(_join_windows, _OUT), "kind")
    both = found.unionByName(windows)
    # A run of an opened minimizer is no edge of its own, so it is its own path.
    alone = found.where(F.col("kind") == OPENED).select("piece", F.col("doc_id").alias("source"), F.col("start").alias("source_start"), F.col("start").alias("path"))
    pathed = save(paths(both.where(F.col("kind") == PIECE).drop("kind")).unionByName(alone))
    spans = save(spans_of(both.where(F.col("kind") == AGAIN).select("piece", "doc_id", "start", "n"), pathed))
    wanted = spans.select(F.col("source").alias("doc_id"), F.col("source_start").alias("start"), "n").distinct().groupBy("doc_id").agg(listed)
    digests = save(_digests(docs.join(wanted, "doc_id").select("doc_id", "text", "spans")))
    return spans.join(digests, ["source", "source_start", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))


def _kept(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words that no span covers whose digest its own words have."""
    edge = np.zeros(len(words) + 1, np.int64)
    for x in spans:
        if word_digest(words, x["start"], x["n"]) == x["digest"]:
            edge[x["start"]] += 1
            edge[x["start"] + x["n"] + WINDOW - 1] -= 1
    stay = (np.cumsum(edge)[:-1] == 0).tolist()
    return [w for w, s in zip(words, stay, strict=True) if s]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each document's words without those that a repeated window covers, one space between."""
    docs = unique_docs(docs)
    joined = docs.join(repeated(docs), "doc_id", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vec.parts(batches, 1):
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()  # at the same characters as _WORD: bytes know no other white space
                total.append(len(words))
                words = _kept(words, spans) if spans else words
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).schema)


def brute_force(texts: dict[int, str]) -> dict[int, tuple[int, int, str]]:
    """doc_id: words, removed, digest of what is kept; for tests."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for doc in sorted(texts):
        words = _WORD.findall(texts[doc].encode())
        covered = [False] * len(words)
        for i in range(len(words) - WINDOW + 1):
            key = tuple(words[i : i + WINDOW])
            if key in seen:
                covered[i : i + WINDOW] = [True] * WINDOW
            seen.add(key)
        kept = [w for w, c in zip(words, covered, strict=True) if not c]
        out[doc] = len(words), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest()
    return out
