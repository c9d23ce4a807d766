"""Labels of documents that aren't there, and none at all."""

from loomlight.llm import quality

DOCS = [(k, f"some words of text {k}") for k in range(40)]
LABELS = "doc_id long, quality int"


def test_absent_labels_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 20)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(k, 0) for k in range(1000, 9000)], LABELS)
    assert quality.train(docs, labels).intercept == 5.0


def test_all_stay_without_a_model(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for rows in ([], [(9000, 1), (9001, 0)]):
        assert quality.keep_good(docs, spark.createDataFrame(rows, LABELS)).count() == len(DOCS)
