import os
import random

import pytest

import corpus_pipeline
from tallygrove.llm import decontaminate, quality

from .helpers import DOCS, documents, empty, sentence, texts
from .test_lines_neardup_spans import brute_classes, brute_lines


@pytest.fixture()
def tables(spark, tmp_path):
    base = [t for t in texts() if t and len(t) > 100]
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, base[4]), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(6, 95)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_equal_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    rows = {i: t for i, t in rows.items() if model.score([t or ""])[0] >= quality.THRESHOLD}
    steps = [rows]
    order = sorted(rows)
    kept = brute_lines([rows[i] for i in order])
    rows = {i: kept[k] for k, i in enumerate(order) if kept[k] == rows[i] or (kept[k] or "").strip() and len(kept[k]) >= 0.2 * len(rows[i])}
    steps.append(rows)
    order = sorted(rows)
    roots = brute_classes([rows[i] for i in order], 5, 80)
    rows = {i: rows[i] for k, i in enumerate(order) if roots[k][1] == k}
    steps.append(rows)
    bench = decontaminate.Items([(r["item_id"], decontaminate.normal(r["text"])) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() if r["text"]])
    rows = {i: t for i, t in rows.items() if not list(bench.matches(decontaminate.normal(t)))}
    steps.append(rows)
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert got == want
        docs = spark.createDataFrame(out.collect(), docs.schema)
    out = corpus_pipeline.run(spark, tables)
    assert {r["doc_id"] for r in out.collect()} == set(rows)


def test_stages_bear_an_empty_table(spark, tables):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0


def test_stages_keep_rows_without_ids(spark, tables):
    docs = documents(spark, repeat=True, null_id=True)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, tables)
        assert docs.where("doc_id is null").count() == 1, name
    good = quality.LineCrf(None, None, None, None, 1.0)
    assert quality.keep_good(documents(spark, null_id=True), good).where("doc_id is null").count() == 1
    assert corpus_pipeline.STAGES[4][1](spark, documents(spark, null_id=True), tables).where("doc_id is null").count() == 1


def test_scratch_lies_in_the_shared_folder(spark):
    from tallygrove.llm.common import save, scratch_dir

    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    where = save(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(where)


def test_what_is_left_of_a_near_copy_goes(spark, tables):
    rng = random.Random(3)
    own = [sentence(rng, 12) for _ in range(12)]
    near = [*own[:5], sentence(rng, 12), *own[6:]]
    half = [*own[:6], *(sentence(rng, 12) for _ in range(6))]
    rows = [(i, "\n".join(t), "en", "s", 1, "k", 1, 2) for i, t in enumerate((own, near, half))]
    out = corpus_pipeline.lines_stage(spark, spark.createDataFrame(rows, DOCS), tables)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "\n".join(own), 2: "\n".join(half[6:])}
