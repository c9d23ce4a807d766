"""Recall of the registered approximate query without SQL, at all sizes."""

import pytest
from pyspark.sql import functions as F

from loomlight import plans
from loomlight.operators import search


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_kmeans(spark, size):
    sf = f"/root/testdata/{size}"
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = search.nearest(v, search.query_of(v, F.col("vec_id") % 50 == 0), 5)
    assert search.recall(exact, plans.queries()["ivf_kmeans"](spark, sf)).agg(F.avg("recall")).first()[0] >= 0.9
