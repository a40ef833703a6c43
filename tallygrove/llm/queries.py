"""The driver's queries for the training-data operators, one for each: ``op<N>_<name>``.

Every query gets its rows through its operator, over the whole table, and derives the contract's columns from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import audit, bpe, chat, decontaminate, lexical, lines, links, neardup, quality, sharding, spans, vafile, winnow
from tallygrove.llm.common import digest, table


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its lines, how many went, and what is left."""
    out = lines.dedup(table(spark, sf_dir, "documents"))
    total, removed = out.columns[-2:]
    return out.select("doc_id", F.col(total).alias("n_lines"), F.col(removed).alias("n_removed"), digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op2_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), size=4).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.judge(table(spark, sf_dir, "pages"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each maximal conversation."""
    return chat.render(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "n_copies", "chat", digest(F.col("chat")).alias("chat_sha256"))


OP6_SQL = """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (w ROWS UNBOUNDED PRECEDING) AS chat
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), whole AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, chat FROM placed WHERE place = n_turns GROUP BY n_turns, chat
)
SELECT conv_id, n_turns, n_copies, chat, sha256(chat) AS chat_sha256 FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.place < p.n_turns AND p.place = w.n_turns AND p.chat = w.chat)
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part, order of the filters and step."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH judged AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sha256(coalesce(text, '')), coalesce(source, '')) = 1
), words AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM judged
), marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN marks USING (doc_id)
), cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, CAST(i AS INT) AS step, filter_order[i] AS filter, filter_order[:i - 1] AS before FROM orders, range(1, 6) r(i)
), long AS (
  SELECT *, contains(fails, filter) AS hit, fails <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM long GROUP BY ALL)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counted
"""


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item's ten best documents."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


OP12_SQL = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM (SELECT doc_id, coalesce(min(text), '') AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
), whole AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM found WHERE len(terms) > 0
), wanted AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)) GROUP BY ALL
), held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM found) SEMI JOIN wanted USING (term) GROUP BY ALL
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, whole GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM held JOIN weights USING (term) JOIN wanted USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


def op13_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of each fiftieth vector."""
    return vafile.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP13_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), one AS (SELECT vec_id, min(v) AS v FROM sound GROUP BY vec_id
), scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM one q JOIN one c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""


def queries() -> dict:
    return {"op1_lines": op1_lines, "op2_winnow": op2_winnow, "op3_neardup": op3_neardup, "op4_links": op4_links, "op5_substrings": op5_substrings, "op6_chat": op6_chat, "op7_decontaminate": op7_decontaminate, "op8_bpe": op8_bpe, "op9_quality": op9_quality, "op10_sharding": op10_sharding, "op11_audit": op11_audit, "op12_lexical": op12_lexical, "op13_vafile": op13_vafile}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": OP6_SQL, "op11_audit": OP11_SQL, "op12_lexical": OP12_SQL, "op13_vafile": OP13_SQL}
