"""The quantised index: codes, estimates, recall with few exact scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlight import plans
from loomlight.operators import quantised, search


def test_codes_are_the_nearest_prototypes_and_estimates_follow_them(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    encoded, book = quantised.index(v, cells=5, parts=8)
    rows = {r.vec_id: np.array(r.embedding, np.float64) / np.linalg.norm(r.embedding) for r in v.collect()}
    assert encoded.count() == len(rows)
    q = rows[0]
    exact, estimate = [], []
    for r in encoded.collect():
        x = rows[r.vec_id]
        assert r.cell == ((book.centroids - x) ** 2).sum(axis=1).argmin()
        left = (x - book.centroids[r.cell]).reshape(8, -1)
        assert [((w - part) ** 2).sum(axis=1).argmin() for w, part in zip(book.prototypes, left)] == list(bytes(r.codes))
        near, table = book.tables(q[None])
        exact.append(x @ q)
        estimate.append(near[0][r.cell] + sum(table[0][p][c] for p, c in enumerate(bytes(r.codes))))
    assert np.corrcoef(exact, estimate)[0, 1] > 0.95
    asked = search.query_of(v, F.col("vec_id") == 0)
    best = {r.vec_id for r in quantised.shortlisted(encoded, book, asked, 20, 5).collect()}
    ids = [r.vec_id for r in encoded.collect()]
    assert len(best) == 20 and best == {ids[k] for k in np.argsort(-np.array(estimate))[:20]}


def test_blocks_of_queries_and_pruned_cells(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    encoded, book = quantised.index(v, cells=5, parts=8)
    asked = search.query_of(v, F.col("vec_id") < 7)
    whole = sorted(map(tuple, quantised.shortlisted(encoded, book, asked, 15, 2).collect()))
    monkeypatch.setattr(quantised, "QUERY_ROWS", 3)
    assert sorted(map(tuple, quantised.shortlisted(encoded, book, asked, 15, 2).collect())) == whole
    cell = {r.vec_id: r.cell for r in encoded.collect()}
    near = {r.query_id: set(np.argsort(-(book.centroids @ np.array(r["query"])))[:2].tolist()) for r in asked.collect()}
    assert all(cell[v] in near[q] for q, v in whole)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    encoded, book = quantised.index(df, cells=4, parts=2)
    asked = search.query_of(df, F.col("vec_id") == 1)
    assert [(r.vec_id, r.rank) for r in quantised.search(df, encoded, book, asked, 5, 5, 4).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert quantised.search(df, encoded, book, asked.limit(0), 5, 5, 4).collect() == []
    with pytest.raises(ValueError):
        quantised.fit(df.limit(0))
    with pytest.raises(ValueError):
        quantised.fit(df, parts=3)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_search(spark, size):
    sf = f"/root/testdata/{size}"
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = search.nearest(v, search.query_of(v, F.col("vec_id") % 50 == 0), 5)
    assert 60 < v.count() / 5
    assert search.recall(exact, plans.queries()["ivf_pq"](spark, sf)).agg(F.avg("recall")).first()[0] >= 0.9
