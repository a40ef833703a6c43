"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words, in lower case, have 64-bit hashes, and k words in a row the rolling hash of a cyclic polynomial: each word's
hash, turned by one bit for every word that follows it, all joined by exclusive or. It is built by doubling (1, 2, 4, then 5
words), so each part serves all grams that share it. In every window of w grams the least hash is chosen, of hashes whose
upper 34 bits are equal the rightmost, and kept with its place. Two texts that share w + k - 1 words in a row share a chosen
gram. A text shorter than a window keeps all its grams, so that short texts have likenesses between 0 and 1 too. The
fingerprint as a string is a digest of the chosen hashes and places.

Defined cases: a null text is empty; a text without words has an empty fingerprint; one of fewer than k words has one gram of
all its words, one of fewer than w grams keeps them all; rows that repeat a doc_id count as the one of the smallest text; rows
with a null doc_id are left out where the order of documents matters; extra columns are ignored; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallygrove.llm.common import SPACE_CLASS, digest, save, unique_docs

#: Words in a gram, and grams in a window (both fixed by the doublings below): 20 shared words in a row are always noticed.
GRAM, WINDOW = 5, 16
#: Bits of a packed gram that hold its place; the others hold the top of its hash.
PLACE_BITS = 30
_PLACES = (1 << PLACE_BITS) - 1


def _rolled(n: int) -> Callable[[Column, Column], Column]:
    """The hash of a part followed by another of ``n`` words."""
    return lambda a, b: F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(a, 64 - n)).bitwiseXOR(b)


def _lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _joined(a: str, step: int, by: Callable[[Column, Column], Column], b: str | None = None) -> Column:
    """Each element of ``a`` with the one ``step`` further on in ``b`` (or ``a``)."""
    b = b or a
    n = F.greatest(F.size(b) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(step + 1), n), by)


def fingerprint(df: DataFrame, text: str, hashes: str, places: str) -> DataFrame:
    """Adds arrays: the chosen grams' hashes and their places (in words from 0), by place."""
    keep = df.columns
    words = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), SPACE_CLASS)
    df = df.select(*keep, words.alias("_w"))
    df = df.select(*keep, F.transform("_w", lambda x: F.xxhash64(x)).alias("_w"), (F.element_at("_w", 1) == "").alias("_none"))
    df = df.select(*keep, "_w", "_none", _joined("_w", 1, _rolled(1)).alias("_g2"))
    df = df.select(*keep, "_w", "_none", _joined("_g2", 2, _rolled(2)).alias("_g4"))
    df = df.select(*keep, "_none", "_w", _joined("_g4", 4, _rolled(1), "_w").alias("_g"))
    df = df.select(*keep, F.when(F.col("_none"), F.array().cast("array<bigint>")).when(F.size("_g") == 0, F.array(F.xxhash64("_w"))).otherwise(F.col("_g")).alias("_g"))
    # The least packed value has the least hash and, of equal ones, the greatest place.
    packed = F.transform("_g", lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(F.lit(_PLACES) - i.cast("long")))
    df = df.select(*keep, "_g", packed.alias("_m1"))
    df = df.select(*keep, "_g", "_m1", _joined("_m1", 1, _lesser).alias("_m2"))
    for step in (2, 4, 8):
        df = df.select(*keep, "_g", "_m1", _joined(f"_m{step}", step, _lesser).alias(f"_m{2 * step}"))
    chosen = F.when(F.size("_m16") > 0, F.array_distinct("_m16")).otherwise(F.col("_m1"))
    df = df.select(*keep, "_g", F.transform(chosen, lambda m: (F.lit(_PLACES) - m.bitwiseAND(F.lit(_PLACES))).cast("int")).alias(places))
    return df.select(*keep, F.transform(places, lambda i: F.get("_g", i)).alias(hashes), places)


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints' hashes; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both).cast("double")


def name(hashes: str, places: str) -> Column:
    """A fingerprint as a short string: 128 bits over its hashes and places."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), hashes, places)), 16, "0") for i in (1, 2))))


def neighbours(ids: DataFrame) -> DataFrame:
    """ids (doc_id unique and not null) with next_id: the following doc_id in ascending order, after the last the first.

    Ids are dealt out by range; only each range's first id, one row a range, comes together in one task.
    """
    parts = max(1, -(-ids.count() // 200_000))
    dealt = save(ids.repartitionByRange(parts, "doc_id").withColumn("_p", F.spark_partition_id()))
    firsts = dealt.groupBy("_p").agg(F.min("doc_id").alias("_first"))
    after = firsts.select("_p", F.coalesce(F.lead("_first").over(Window.orderBy("_p")), F.min("_first").over(Window.partitionBy())).alias("_after"))
    following = F.lead("doc_id").over(Window.partitionBy("_p").orderBy("doc_id"))
    return dealt.withColumn("_n", following).join(after, "_p").select(*ids.columns, F.coalesce("_n", "_after").alias("next_id"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """The contract's rows: each document against its edited text and the next document."""
    docs = unique_docs(docs)
    own = save(fingerprint(docs, "text", "h", "p").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "h", name("h", "p").alias("fingerprint"), F.size("h").alias("n_chosen")))
    order = save(neighbours(own.select("doc_id", "n_chars")))
    whole = docs.join(own, "doc_id")
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("_for"), F.floor(F.col("n_chars") / 4).cast("int").alias("_n"))
    sent = whole.select("doc_id", "text", "h").join(wanted, "doc_id").select(F.col("_for").alias("doc_id"), F.expr("left(text, _n)").alias("_head"), F.col("h").alias("_next"))
    rows = whole.join(sent, "doc_id").withColumn("_edited", F.expr("concat(left(text, cast(n_chars - floor(n_chars / 4) as int)), _head)"))
    rows = rows.select("doc_id", "n_chars", "h", "fingerprint", "n_chosen", "_next", "_edited")
    rows = fingerprint(rows, "_edited", "_eh", "_ep")
    return rows.select("doc_id", "n_chars", digest(F.col("_edited")).alias("edited_sha256"), "fingerprint", name("_eh", "_ep").alias("edited_fingerprint"), likeness("h", "_eh").alias("near_edited"), likeness("h", "_next").alias("near_next"), "n_chosen")
