"""The training-data pipeline: five stages over ``documents``, each a table that the next one reads.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``docs`` (the last one its own). It works on all rows that
the stage before kept, and what it decides takes effect: rejected, duplicate and contaminated documents are gone from then on,
removed lines are gone from the texts.

- quality: documents that the line CRF scores below its threshold go. It is fitted on labelled rows of the stage's input.
- lines: of each class of similar lines one stays in the corpus. A document that loses lines goes if no content is left, or
  less than a fifth of its characters: what remains of a near copy are the lines that were edited, which no later stage
  could link with the document that they come from. One that had no content before stays. ``n_chars`` follows the text.
- neardup: five-word shingles, similarity 0.8; of each class the document of the smallest id stays.
- decontaminate: documents that hold a passage of ``benchmark`` within the edit budget go.
- bpe: doc_id, n_tokens, ids, and the digest of the decoded text.

SQL cannot express the first three stages, so there is no ORACLE_SQL; tests hold run() against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import bpe, decontaminate, lines, neardup, quality
from tallygrove.llm.common import drop, free, settled, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


#: Share of a document's characters that must be left after its repeated lines went.
LEFT = 0.2


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = free("_chars", docs.columns)
    out = lines.dedup(docs.withColumn(before, F.char_length("text")))
    removed = F.col(out.columns[-1])
    out = out.where((removed == 0) | ((F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "") & (F.char_length("text") >= LEFT * F.col(before))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.classes(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("neardup", neardup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again, and what it worked with goes."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
