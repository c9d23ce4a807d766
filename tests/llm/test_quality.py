"""The rule classifier: held-out accuracy, rules as expressions, edge cases."""

import zlib

from pyspark.sql import functions as F

from loomlight.llm import quality
from tests.llm import nasty

BIG = "/root/testdata/sf0.1"


def auc(scored):
    good, bad = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    assert len(rows) > 500 and auc([(r.score, r.quality) for r in rows]) > 0.9
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.85
    assert 1 <= len(model.rules) < 300


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, turned)


def test_edges(spark):
    rows = nasty.rows(30)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    df = nasty.extra(spark, rows)
    model = quality.train(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    none = quality.train(df, labels.limit(0))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    assert quality.score(spark.createDataFrame([], nasty.SCHEMA), model).collect() == []
    assert quality.keep_good(df, labels).columns == df.columns


def test_paths_of_a_tree():
    printed = "RandomForest (uid=x)\n  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0E-4)\n    Predict: 0.0\n   Else (feature 1 <= 2.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    a, b = quality.FEATURES[:2]
    assert quality.paths(printed) == [((a, "<=", 1.5),), ((a, "<=", 1.5), (b, ">", 2e-4)), ((a, "<=", 1.5), (b, "<=", 2e-4)), ((a, ">", 1.5),)]


def test_scores_against_plain_python(spark, sf):
    """Statistics and rules worked out without Spark."""
    import math

    import regex

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.rules
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for d, text in docs.select("doc_id", "text").collect():
        text = text or ""
        words = [w for w in regex.split(r"[ \n\t]+", text) if w]
        lines = [s for s in text.split("\n") if s]
        n, chars = max(1, len(words)), max(1, len(text))
        count = lambda p: len(regex.findall(p, text)) / chars  # noqa: E731, B023
        x = {
            "log_words": math.log1p(len(words)), "word_length": len(text) / n, "distinct_words": len(set(words)) / n, "repeated_neighbours": sum(a == b for a, b in zip(words, words[1:])) / n,
            "short_words": sum(len(w) <= 3 for w in words) / n, "distinct_lines": len(set(lines)) / max(1, len(lines)), "capitals": count(r"\p{Lu}"), "digits": count("[0-9]"),
            "symbols": count(r"[#$%&*!|<>{}\[\]^~@=_+\\]"), "stops": count("[.,;:?]"),
        }
        total = model.intercept + sum(w for rule, w in model.rules if all(x[f] <= v if sign == "<=" else x[f] > v for f, sign, v in rule))
        assert abs(got[d].score - 1 / (1 + math.exp(-total))) < 1e-9, d
        assert got[d].predicted == (got[d].score >= 0.7)
