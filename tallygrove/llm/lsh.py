"""Candidates by banding, links by a check of the candidates, and classes by distributed union-find.

Rows go through the shuffle as packed arrays: each task gathers its items' band keys, groups equal keys at once, and sends
only the least item of each key on, to the bucket of the key. So a key that a third of all items share is one entry for each
task. Groups are stars: the least item and each other one. What the stars' checks leave apart is tried further: buckets whose
other items lie in different classes are compared pair by pair, so no pair of a bucket that is not already in one class stays
unchecked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import drop, save

BAND, SAME, MEMBER, ITEM = 0, 1, 2, 3
#: What a task sends: entries of ``kind`` packed in ``blob``, to ``bucket``.
PACKED = "bucket int, kind int, blob binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
KEYED = np.dtype([("key", "u8"), ("item", "i8")])
STAR = np.dtype([("key", "u8"), ("centre", "i8"), ("item", "i8")])
#: Band entries of a bucket, about.
BUCKET_ENTRIES = 500_000


def buckets(entries: int) -> int:
    return int(max(12, -(-entries // BUCKET_ENTRIES)))


def tasks_for(rows: int) -> int:
    """Tasks of a stage over rows of a few numbers, a fraction of the table's ``rows`` or a small multiple."""
    return int(max(12, -(-rows // 50_000)))


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key, by its upper bits: keys in order are buckets in order."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def stars(keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """KEYED of each key's least item, STAR of each other item of the keys that have several; both in the order of keys."""
    order = np.argsort(keys)
    keys, items = keys[order], items[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    least = np.empty(len(at), KEYED)
    least["key"] = keys[at]
    least["item"] = np.minimum.reduceat(items, at) if len(at) else items
    several = np.flatnonzero(np.repeat(np.diff(at, append=len(keys)) > 1, np.diff(at, append=len(keys))))
    rest = np.empty(len(several), STAR)
    rest["key"], rest["centre"], rest["item"] = keys[several], least["item"][np.cumsum(first)[several] - 1], items[several]
    rest = rest[rest["item"] != rest["centre"]]
    rest = rest[np.lexsort((rest["item"], rest["key"]))]
    new = np.ones(len(rest), bool)
    new[1:] = (rest["key"][1:] != rest["key"][:-1]) | (rest["item"][1:] != rest["item"][:-1])
    return least, rest[new]


def dealt(kind: int, rows: np.ndarray, n: int) -> pa.RecordBatch:
    """rows, in the order of their key, by bucket; each field by itself and the keys as differences, so that they compress."""
    bucket = buckets_of(rows["key"], n)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs = []
    for part in np.split(rows, at[1:]) if len(rows) else []:
        blobs.append(b"".join((np.diff(part[f], prepend=part[f].dtype.type(0)) if f == "key" else part[f]).tobytes() for f in part.dtype.names))
    return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], schema=PACKED_ARROW)


def undealt(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    parts = []
    for k, blob in zip(table["kind"].to_pylist(), table["blob"], strict=True):
        if k == kind:
            raw = blob.as_py()
            part = np.empty(len(raw) // dtype.itemsize, dtype)
            at = 0
            for f in dtype.names:
                got = np.frombuffer(raw, dtype[f], len(part), at)
                part[f] = np.cumsum(got) if f == "key" else got
                at += len(part) * dtype[f].itemsize
            parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def passed(kind: int, rows: np.ndarray, bucket: int) -> pa.RecordBatch:
    """rows, packed as they are: the bucket stage hands them on."""
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([rows.tobytes()], pa.binary())], schema=PACKED_ARROW)


def unpack(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    blobs = [b.as_py() for k, b in zip(table["kind"].to_pylist(), table["blob"], strict=True) if k == kind]
    return np.frombuffer(b"".join(blobs), dtype)


def components(edges: DataFrame, tasks: int) -> DataFrame:
    """edges: a, b. node and root (the least node it reaches) of every node of an edge between different nodes.

    Large and small stars in turn (Kiveris et al., 2014) until only stars are left; every round is written to the shared
    folder, and the one before goes. ``tasks`` bounds the tasks of a stage; the caller lets it grow with the table.
    """
    now = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().coalesce(tasks))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks))
        drop(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = save(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        drop(large)
        # Stars only: no node is below one node and above another, or below two.
        roles = now.select(F.col("u").alias("n"), F.lit(1).alias("low")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("low")))
        if roles.groupBy("n").agg(F.sum("low").alias("s"), F.min("low").alias("m")).coalesce(tasks).where("s > 1 or (s = 1 and m = 0)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Items that one block holds on either side.
BLOCK = 2048


def blocked(items: DataFrame, tasks: int) -> DataFrame:
    """items: item, root, family (what is compared within itself), parts. Each row once for each block of its family: bucket, block, first, last, item, root.

    A family is cut by a hash into ``parts`` of about BLOCK items, and every two parts (and each by itself) make a block, so a
    family of any size is spread over many tasks of bounded memory.
    """
    cut = items.withColumn("_own", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    both = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    block = F.xxhash64("family", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return both.select(F.pmod(block, F.lit(4 * tasks)).cast("int").alias("bucket"), block.alias("block"), (F.col("_own") <= F.col("_other")).alias("first"), (F.col("_own") >= F.col("_other")).alias("last"), "item", "root")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of different sets, by products of incidence matrices a few thousand elements at a time."""
    sizes = [len(x) for x in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[element] > 1
    place = np.cumsum(count > 1)[element[shared]] - 1
    owner = owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    columns = int(place[-1]) + 1 if len(place) else 0
    width = max(1, min(columns, max(256, 4_000_000 // max(1, len(sets)))))
    for lo in range(0, columns, width):
        a, b = np.searchsorted(place, (lo, lo + width))
        tile = np.zeros((len(sets), width), np.float32)
        tile[owner[a:b], place[a:b] - lo] = 1
        out += tile @ tile.T
    return out


def block_links(table: pa.Table, column: str, sets_of: Callable[[list], list[np.ndarray]], percent: int) -> pa.Table:
    """The links of different roots within each block of a bucket, exactly; of those only a spanning forest.

    column: what ``sets_of`` turns into the items' sets.
    """
    block = table["block"].to_numpy()
    first, last = (np.array(table[c].to_pylist(), bool) for c in ("first", "last"))
    root, item, raw = table["root"].to_numpy(), table["item"].to_numpy(), table[column].to_pylist()
    order = np.argsort(block, kind="stable")
    found: list[tuple[int, int]] = []
    for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
        sets = sets_of([raw[i] for i in rows])
        n = np.array([len(x) for x in sets])
        both = intersections(sets)
        near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        near &= first[rows][:, None] & last[rows][None, :] & (root[rows][:, None] != root[rows][None, :])
        top: dict[int, int] = {}

        def lead(x: int, top=top) -> int:
            while top.get(x, x) != x:
                top[x] = top.get(top[x], top[x])
                x = top[x]
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = lead(int(root[rows[i]])), lead(int(root[rows[j]]))
            if x != y:
                top[x] = y
                found.append((int(item[rows[i]]), int(item[rows[j]])))
    return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})


def open_sets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members: STAR rows; labels: item, root. item, root, key and n (its items) of the buckets that hold unchecked pairs of different classes.

    Each star's centre was checked against all its items, so a bucket is open only where its other items lie in two classes or
    more. Of buckets with the same items one stays: they are told by their number and two sums of hashes of the items.
    """
    own = members.select("key", "item").join(labels, "item", "left").select("key", "item", F.coalesce("root", "item").alias("root"))
    sums = [F.sum(F.xxhash64(F.lit(i), "item").cast("decimal(20,0)")).alias(f"_s{i}") for i in (1, 2)]
    seen = own.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("n"), *sums).where("_lo <> _hi")
    return save(own.join(save(seen.groupBy("n", "_s1", "_s2").agg(F.min("key").alias("key")).select("key", "n")), "key"))


def families(sets: DataFrame, tasks: int) -> DataFrame:
    """sets: item, root, key, n. item, root, family and parts: what has to be compared with each other.

    Buckets that share items form one family, so that an item is compared once and not for each of its buckets. A family of
    more than BLOCK items is a square of blocks; where its buckets, each by itself, send fewer rows than that square, it is
    taken apart into them. So a chain of buckets never makes a square of its length, and items that share many buckets are not
    sent once for each. Either way all pairs of a bucket meet. Families are told by one row a bucket and one an item.
    """
    buckets = save(sets.groupBy("key").agg(F.min("item").alias("a"), F.first("n").alias("n")))
    joined = save(components(sets.join(buckets.select("key", "a"), "key").select("a", F.col("item").alias("b")), tasks))
    size = joined.groupBy("root").agg(F.count("*").alias("_m"))
    apart = buckets.join(joined.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK)).alias("_apart"))
    parts = F.ceil(F.col("_m") / BLOCK)
    plan = save(size.join(apart, "root").select("root", parts.cast("int").alias("parts"), ((parts > 1) & (F.col("_apart") < F.col("_m") * parts)).alias("_split")))
    labels = sets.groupBy("item").agg(F.first("root").alias("_class"))  # an item has one class
    named = joined.join(plan, "root").select(F.col("node").alias("item"), F.col("root").alias("family"), "parts", "_split")
    whole = named.where("not _split").join(labels, "item").select("item", F.col("_class").alias("root"), "family", "parts")
    if plan.where("_split").isEmpty():
        return whole
    split = buckets.join(named.where("_split").select(F.col("item").alias("a")), "a").select("key")
    return whole.unionByName(sets.join(split, "key").select("item", "root", F.col("key").alias("family"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))


def link(members: DataFrame, same: DataFrame | None, verify: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame], tasks: int) -> DataFrame:
    """members: key, centre, item (STAR rows); same: a, b known to be linked; verify: pairs a, b to those that are linked;
    compare: blocked() rows to links a, b between different roots, enough of them to join all that are linked.

    node and root of every node that is linked. The stars come first. What a bucket then still holds of different classes
    is compared pair by pair (open_sets, families).
    """
    pairs = members.select(F.least("centre", "item").alias("a"), F.greatest("centre", "item").alias("b")).distinct().coalesce(tasks)
    found = verify(save(pairs))
    found = save(found.unionByName(same.select("a", "b")).coalesce(tasks)) if same is not None else found
    roots = save(components(found, tasks).coalesce(tasks))
    sets = open_sets(members, roots.withColumnRenamed("node", "item"))
    if sets.isEmpty():
        return roots
    more = save(compare(blocked(families(sets, tasks), tasks).repartition(4 * tasks, "bucket")))
    return roots if more.isEmpty() else components(save(found.unionByName(more).coalesce(tasks)), tasks)


def grouped(packed: DataFrame, extra: Callable[[pa.Table], Iterator[pa.Table]] | None, schema: str, band_schema: pa.Schema) -> DataFrame:
    """The bucket stage: MEMBER rows (kind, a = key, b = centre, c = item) of the task's own stars and of those across tasks."""

    def run(table: pa.Table) -> pa.Table:
        own = unpack(table, MEMBER, STAR)
        keyed = undealt(table, BAND, KEYED)
        _, star = stars(keyed["key"], keyed["item"])
        rows = np.concatenate([own, star])
        out = [pa.table({"kind": pa.array(np.full(len(rows), MEMBER), pa.int32()), "a": rows["key"].view(np.int64), "b": rows["centre"], "c": rows["item"]})]
        out += list(extra(table)) if extra else []
        for name in band_schema.names:
            out = [t if name in t.column_names else t.append_column(name, pa.nulls(len(t), band_schema.field(name).type)) for t in out]
        return pa.concat_tables([t.select(band_schema.names).cast(band_schema) for t in out])

    return packed.groupBy("bucket").applyInArrow(run, schema)
