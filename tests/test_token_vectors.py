"""Token vectors: encoding, replacement of whole documents, healing."""

import math

from loomlight.sources import token_vectors as T

DOCS = "doc_id long, text string"


def model():
    def encode(texts):
        assert len(texts) <= 2
        return [[[float(len(w)), 1.0] for w in t.split()] for t in texts]

    return encode


def table(spark, path):
    return sorted((r.doc_id, r.tok, [round(x, 5) for x in r.vec]) for r in T.vectors(spark, path).collect())


def want(docs):
    unit = lambda n: [round(x / math.hypot(n, 1), 5) for x in (n, 1)]
    return sorted((d, k, unit(len(w))) for d, t in docs for k, w in enumerate(t.split()))


def ingest(spark, rows, path):
    T.ingest(spark.createDataFrame(rows, DOCS), path, model, 2, 4)


def test_documents_are_replaced_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = {k: f"w{'x' * k} b c" for k in range(12)}
    ingest(spark, list(rows.items()), path)
    assert table(spark, path) == want(rows.items())
    rows |= {3: "one", 20: "new words"}
    ingest(spark, [(3, "one"), (20, "new words"), (None, "lost")], path)
    assert table(spark, path) == want(rows.items())
    # the same again changes nothing; blank texts lose their tokens, and the greatest of several texts counts
    ingest(spark, [(3, "one"), (3, "a"), (3, "one"), (4, " \n"), (5, None)], path)
    assert table(spark, path) == want((d, t) for d, t in rows.items() if d not in (4, 5))


def test_a_bucket_may_become_empty(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    ingest(spark, [(1, "a b"), (2, "c")], path)
    ingest(spark, [(1, ""), (2, None)], path)
    assert table(spark, path) == []
    ingest(spark, [(2, "c d")], path)
    assert table(spark, path) == want([(2, "c d")])


def test_heal(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [(1, "a"), (2, "b bb"), (3, ""), (4, None), (5, "e"), (5, "e ee"), (6, "f")]
    docs = spark.createDataFrame(rows, DOCS)
    heal = lambda d, **x: tuple(T.heal(d, path, model, batch_size=2, buckets=4, **x).first())
    assert heal(docs.where("doc_id < 0")) == ("no_documents", 0, 0, 0)
    assert heal(docs.where("doc_id in (3, 4)")) == ("no_valid_content", 0, 2, 0)
    assert heal(docs, first=2) == ("complete", 2, 0, 0)
    assert table(spark, path) == want(rows[:2])
    assert heal(docs) == ("complete", 2, 2, 0)
    whole = want([(1, "a"), (2, "b bb"), (5, "e ee"), (6, "f")])
    assert table(spark, path) == whole
    assert sorted(r.doc_id for r in T.missing(docs, T.vectors(spark, path)).collect()) == [3, 4]
    assert heal(docs) == ("no_valid_content", 0, 2, 0)
    assert heal(docs.withColumn("other", docs.text), force=True) == ("complete", 4, 2, 0)
    assert table(spark, path) == whole
