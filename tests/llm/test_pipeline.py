"""The corpus pipeline stage by stage, each against its operator's own rules."""

import inspect

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm import nasty

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/{name}"
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def test_columns_and_ids(stages):
    assert [n for n, _, _ in stages] == ["quality", "line_dedup", "near_dedup", "decontamination", "tokens"]
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        assert 0 < after.count() < before.count() or name in ("line_dedup", "near_dedup")
    last = stages[-1]
    assert last[2].count() == last[1].count()


def test_labelled_good_documents_stay(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id")
    assert good.join(after.select("doc_id"), "doc_id").count() / good.count() > 0.9


def test_decisions_hold(spark, stages):
    from loomlight.llm import decontaminate
    from tests.llm.test_copies import kept

    _, before, after = stages[2]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert sorted((str(r.doc_id), str(r.text)) for r in after.collect()) == kept(rows)
    _, before, after = stages[3]
    marks = decontaminate.digests(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated")
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(r.doc_id for r in marks.collect())


def test_edge_rows_of_every_stage(spark, sf):
    """Nulls, repeats, long texts, clashing columns and no rows at all; the columns stay."""
    rows = [*nasty.rows(15), (900, "word " * 60_000), (901, None), (901, None), (None, None)]
    docs = nasty.extra(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r[0] for r in rows} and out.count() <= len(rows), name
        assert stage(spark, docs.limit(0), sf).collect() == [], name
    stage = dict(corpus_pipeline.STAGES)["tokens"]
    out = stage(spark, docs, sf).collect()
    assert len(out) == len(rows) and all(len(r.ids) == r.n_tokens for r in out) and all(r.n_tokens == 0 for r in out if r.doc_id == 901)
    assert stage(spark, docs.limit(0), sf).collect() == []


def test_run_equals_its_stages(spark, stages):
    last = stages[-1][2]
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = corpus_pipeline.run(spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, last.select(*columns).collect()))


def test_run_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert list(inspect.signature(corpus_pipeline.run).parameters) == ["spark", "sf_dir"]
