import math
import random
import re
import string
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import audit, lexical, queries, vafile

from .helpers import documents, empty, sentence, texts

LABELS = "doc_id bigint, quality int, toxic int, part string, mask int"


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql).to_arrow_table().to_pylist()


def ordered(rows):
    return sorted((tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows))


# Filter interaction audit


def plain_failures(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    out = {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * sum(c in string.ascii_uppercase for c in text) > 5 * len(text) else set()
    return out | ({"D"} if set(text) & set("#$%&*|") else set())


def plain_audit(rows, labels):
    """rows: (doc_id, text, source), each id once."""
    first = {}
    for i, t, _ in sorted(rows):
        first.setdefault(t, i)
    fails = {i: plain_failures(t) | ({"E"} if first[t] != i else set()) for i, t, _ in rows}
    out = {}
    for part in {s for _, _, s in rows}:
        own = [i for i, _, s in rows if s == part]
        for order in permutations("ABCDE"):
            left = set(own)
            for k, f in enumerate(order):
                hit = {i for i in own if f in fails[i]}
                gone = left & hit
                out[part, "".join(order), k + 1] = [len(left - hit), len(gone), len(hit - left), sum(fails[i] == {f} for i in own), sum(labels.get(i, (0, 0))[0] for i in gone), sum(labels.get(i, (0, 0))[1] for i in gone)]
                left -= gone
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(sum(out[part, "".join(o), o.index(f) + 1][1] for o in permutations("ABCDE")))
    return out


def test_audit_equals_one_document_at_a_time(spark):
    rng = random.Random(5)
    plain = [(i, t or "", rng.choice(["a", "b", ""])) for i, t in enumerate([*texts(), sentence(rng, 80) + " 100%", "AB cd " * 60, sentence(rng, 60), *texts()[6:20]])]
    rows = [(i, t or None, s or None, "k", 7) for i, t, s in plain]
    rows += rows[3:9] + [(None, "no id", "a", "k", 7)]  # repeated rows, a row without an id
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, part string, n int").repartition(3)
    marks = {i: (i % 2, int(i % 5 == 0)) for i, _, _ in plain if i % 3}
    labels = spark.createDataFrame([(i, q, t, "x", 1) for i, (q, t) in marks.items()] + [(1, None, None, "x", 1), (None, 1, 1, "x", 1)], LABELS)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in audit.audit(docs, labels).collect()}
    assert got == plain_audit(plain, marks)
    assert audit.audit(empty(spark), labels).count() == 0
    alone = audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(alone) == (0, 0)


def test_audit_sql(spark):
    docs = documents(spark, repeat=True, null_id=True).withColumn("source", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("s"), F.col("doc_id") % 3)))
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0), "x", 1) for i in range(0, 90, 2)], LABELS)
    got = [r.asDict() for r in audit.audit(docs, labels).collect()]
    assert ordered(got) == ordered(duck(queries.OP11_SQL, documents=docs, labels=labels))


# Ranked lexical search


def plain_ranking(docs, items, k):
    found = {i: Counter(lexical.terms_of(t)) for i, t in docs if lexical.terms_of(t)}
    n_docs, n_terms = len(found), sum(c.total() for c in found.values())
    df = Counter(t for c in found.values() for t in c)
    out = []
    for item, text in items:
        scores = {}
        for i, c in found.items():
            m = 25 + 75 * c.total() * n_docs // n_terms
            scores[i] = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in lexical.terms_of(text) if c[t])
        best = sorted((-s, i) for i, s in scores.items() if s > 0)[:k]
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def lexical_items():
    plain = [t or "" for t in texts()]
    return [(0, plain[6]), (1, plain[13].upper() + " " + plain[30]), (2, "zzzz unknown"), (3, None), (4, " ... \n"), (5, "one one Two"), (6, "ÜNÏ çödé 日本語"), (7, " ".join(plain[20].split()[:20])), (8, "a")]


@pytest.mark.parametrize("most", [40, lexical.BLOCK_TERMS])
def test_ranking_equals_brute_force(spark, most):
    items = lexical_items()
    rows = spark.createDataFrame([(i, t, 1, "k") for i, t in [*items, items[0], (None, "one")]], "item_id bigint, text string, doc_id int, term string")
    got = lexical.search(documents(spark, repeat=True, null_id=True), rows, 10, most).collect()
    assert sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got) == plain_ranking(list(enumerate(texts())), items, 10)


def test_ranking_ties_by_id_and_bounds(spark):
    rng = random.Random(2)
    common = sentence(rng, 12)
    docs = [(i, common if i % 3 else f"{common} {sentence(rng, 3)}") for i in range(400)]
    items = [(1, common), (2, common.split()[0] + " " + sentence(rng, 2))]
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string"), 7).collect()
    assert sorted(tuple(r) for r in got) == plain_ranking(docs, items, 7)


def test_ranking_of_a_very_long_text_and_of_nothing(spark):
    rng = random.Random(3)
    long = sentence(rng, 400_000)
    docs = [(1, long), (2, " ".join(long.split()[:50])), (3, "x" * 3_000_000), (4, None)]
    rows, items = spark.createDataFrame(docs, "doc_id bigint, text string"), [(1, " ".join(long.split()[5:20])), (2, "x" * 3_000_000)]
    wanted = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(tuple(r) for r in lexical.search(rows, wanted).collect()) == plain_ranking(docs, items, 10)
    assert lexical.search(empty(spark), wanted).count() == 0 and lexical.search(rows, wanted.limit(0)).count() == 0


def test_ranking_sql(spark):
    docs = documents(spark, repeat=False, null_id=True)
    items = spark.createDataFrame(lexical_items(), "item_id bigint, text string")
    got = [r.asDict() for r in lexical.search(docs, items).collect()]
    assert ordered(got) == ordered(duck(queries.OP12_SQL, documents=docs, benchmark=items))


# Exact top-k search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, query bigint, entry string").repartition(4)


def plain_top(rows, wanted, k):
    whole = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v = [math.floor(256 * float(np.float32(c))) for c in x]
            whole[i] = min(v, whole.get(i, v))
    out = []
    for q in filter(wanted, whole):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, 16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # a vector that many rows share, queries among them
    rows += [(i, [0.0] * 16) for i in range(5000, 5060)] + [(6000, rows[3][1][:9]), (6010, rows[4][1][:9]), (6020, [1.0])]
    rows += [(7000, None), (7010, []), (7020, [*rows[0][1][:15], None]), (7030, [*rows[0][1][:15], float("nan")]), (7040, [*rows[0][1][:15], float("-inf")]), (None, rows[0][1]), rows[1], (1, rows[2][1])]
    return rows


@pytest.mark.parametrize(("cells", "block"), [(64, vafile.BLOCK), (2, 16 * 90)])
def test_nearest_equal_brute_force(spark, cells, block):
    rows = vector_rows()
    got = vafile.search(vectors(spark, [(i, x, 1, 2, "e") for i, x in rows]), F.col("vec_id") % 10 == 0, 5, cells=cells, block=block).collect()
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in got) == plain_top(rows, lambda i: i % 10 == 0, 5)


def test_cells_hold_every_value(spark):
    rng = np.random.default_rng(1)
    values = np.floor(rng.normal(0, 40, (3000, 5))).astype(np.int64)
    values[0, 0], values[1, 1], values[:, 2] = 10**6, -(10**6), 3
    grid = vafile.Cells(values[10:200], values.min(0), values.max(0), 16)
    centre, half = grid.bounds(grid.codes(values))
    assert (np.abs(values - centre) <= half).all() and grid.codes(values).max() < 16


def test_nearest_of_few_none_and_too_large(spark):
    few = vectors(spark, [(0, [1.0, 2.0], 1, 1, ""), (50, [0.5, -2.0], 1, 1, "")])
    assert [tuple(r) for r in vafile.search(few, F.col("vec_id") % 50 == 0).orderBy("query_id").collect()] == [(0, 1, 50, 256 * 128 - 512 * 512), (50, 1, 0, 256 * 128 - 512 * 512)]
    assert vafile.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vafile.search(few, F.col("vec_id") == 3).count() == 0
    with pytest.raises(ValueError, match="62 bits"):
        vafile.search(vectors(spark, [(0, [1e12, 2.0], 1, 1, "")]), F.col("vec_id") == 0)
    wide = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(0, 1e5, 8)]) for i in range(200)]
    got = vafile.search(vectors(spark, [(i, x, 1, 1, "") for i, x in wide]), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == plain_top(wide, lambda i: i % 50 == 0, 5)


def test_nearest_sql(spark):
    rows = vectors(spark, [(i, x, 1, 2, "e") for i, x in vector_rows() if i != 1])
    got = [r.asDict() for r in vafile.search(rows, F.col("vec_id") % 50 == 0).collect()]
    assert ordered(got) == ordered(duck(queries.OP13_SQL, embeddings=rows))
