"""Benchmark decontamination by pigeonhole edit matching.

A test item of n normalised characters may differ from a passage by ``rate * n`` edits. It is split into one piece more than
that, so a passage within the budget holds at least one piece unchanged, near the piece's place. An automaton finds all pieces
of all items in one scan of a text; around each hit Myers' bit-parallel search gives the least distance of the whole item.

The items are a query set: they are taken in blocks of at most ``BLOCK_CHARS`` characters (a longer item is a block), each
broadcast and run against all rows. With more than one block, each one's result is written to the shared folder and its
broadcast destroyed before the next is read, so the driver and a worker hold one block at a time, whatever the benchmark's size.
Of an item's passages in a document the least distant is reported, of equal ones the one that ends first.

Texts and items are compared in lower case with each run of white space as one space. Defined cases: null and blank texts
match nothing; null and blank items match nothing; items too short for an edit must occur exactly; equal items match each;
repeated rows are judged each; texts of any length are searched whole; an empty benchmark leaves all rows as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallygrove.llm import vec
from tallygrove.llm.common import drop, save

#: Edits allowed for each character of an item.
RATE = 0.05
#: Characters of items in one pass.
BLOCK_CHARS = 2_000_000

MATCH = "item_id bigint, distance int, start int, stop int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> Iterator[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 pieces of nearly equal lengths that make up the item."""
    n = budget + 1
    for i in range(n):
        a, b = i * len(item) // n, (i + 1) * len(item) // n
        yield a, item[a:b]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def search(mask: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of ``m`` characters to a passage of ``text``, and the first end of one that has it."""
    ones, high = (1 << m) - 1, 1 << m - 1
    up, down, score = ones, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        equal = mask.get(c, 0)
        v = equal | down
        h = ((equal & up) + up ^ up) | equal
        grow, shrink = down | ~(h | up) & ones, up & h
        if grow & high:
            score += 1
        elif shrink & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        grow, shrink = grow << 1 & ones, shrink << 1 & ones
        up, down = shrink | ~(v | grow) & ones, grow & v
    return best, end


class Items:
    """A block of test items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, x, int(rate * len(x))) for i, x in items if x]
        self.masks: dict[int, tuple[dict, dict]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, budget) in enumerate(self.items):
            for at, piece in pieces(item, budget):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) of each item's best passage in a normalised text."""
        if not text or not self.items:
            return
        starts: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for k, at in where:
                starts.setdefault(k, set()).add(end - n + 1 - at)
        for k, own in starts.items():
            item_id, item, budget = self.items[k]
            m = len(item)
            if k not in self.masks:
                self.masks[k] = masks(item), masks(item[::-1])
            windows: list[list[int]] = []
            for s in sorted(own):
                a, b = max(0, s - budget), s + m + budget
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            best = min(((d, a + e) for a, b in windows for d, e in [search(self.masks[k][0], m, text[a:b])]), default=(m, 0))
            if best[0] <= budget:
                stop = best[1]
                back = text[max(0, stop - m - budget) : stop][::-1]
                yield item_id, best[0], stop - search(self.masks[k][1], m, back)[1], stop


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        item = normal(row["text"])
        if not item:
            continue
        if block and size + len(item) > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], item))
        size += len(item)
    if block:
        yield block


_ready: dict[object, Items] = {}


def _items(shared, rate: float) -> Items:
    """One automaton for each worker process and block."""
    key = (shared.value[0], rate)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Items(shared.value[1], rate)
    return _ready[key]


def _per_block(docs: DataFrame, benchmark: DataFrame, rate: float, most: int, step: Callable[[Callable[[], Items], bool], None]) -> None:
    """Calls ``step`` with each block's items, ready on the workers, and whether it is the only block; what step gives is final."""
    following = blocks(benchmark, most)
    block, after = next(following, None), next(following, None)
    alone = after is None
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast((hash(tuple(block)), block))
        step(lambda shared=shared: _items(shared, rate), alone)
        if not alone:
            shared.destroy()
        block, after = after, next(following, None)


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, stop: a row for each document and item within the item's budget; places are in the normalised text."""
    schema = T.StructType([docs.select("doc_id").schema[0], *T._parse_datatype_string(MATCH).fields])
    found: list[DataFrame] = []

    def step(items_of: Callable[[], Items], alone: bool) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = items_of()
            for batch in vec.parts(batches, 1):
                rows, ids = [], []
                for i, text in enumerate(batch.column(1)):
                    for match in items.matches(normal(text.as_py())):
                        ids.append(i)
                        rows.append(match)
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True))], ["doc_id", "item_id", "distance", "start", "stop"])

        got = docs.select("doc_id", "text").mapInArrow(run, schema)
        found.append(got if alone else save(got))

    _per_block(docs, benchmark, rate, most, step)
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns."""
    at = docs.columns.index("text")
    left = [docs]

    def step(items_of: Callable[[], Items], alone: bool) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = items_of()
            for batch in vec.parts(batches, at):
                yield batch.filter(pa.array([next(items.matches(normal(x.as_py())), None) is None for x in batch.column(at)], pa.bool_()))

        got = left[0].mapInArrow(run, docs.schema)
        before, left[0] = left[0], got if alone else save(got)
        if before is not docs:
            drop(before)

    _per_block(docs, benchmark, rate, most, step)
    return left[0]
