"""Neighbours by blocks within cells: the same rows and scores as a join of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomlight.functions import vectors as V
from loomlight.operators import search
from loomlight.operators.common import top_k_per

ROWS, ASKED = "cell int, vec_id long, embedding array<double>", "cell int, query_id long, query array<double>"


def by_pairs(rows, asked, k):
    both = rows.where("embedding is not null").join(asked.where("query is not null"), "cell").select("query_id", "vec_id", V.cosine("embedding", "query").alias("score"))
    return top_k_per(both, "query_id", k, F.desc("score"), "vec_id")


def shown(df):
    return sorted((r.query_id, r["rank"], r.vec_id, repr(r.score)) for r in df.collect())


def same(spark, rows, asked, k, side):
    rows, asked = spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, ASKED)
    got = search.best_in_cells(rows, asked, k, side=side)
    assert got.columns == ["query_id", "vec_id", "score", "rank"]
    assert shown(got) == shown(by_pairs(rows, asked, k))


def vector(rng, dim=7):
    return [rng.gauss(0, 1) for _ in range(dim)]


@pytest.mark.parametrize("seed", range(2))
def test_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    some = [vector(rng) for _ in range(12)]
    # copies, copies of other lengths, near copies and zeros: ties and scores that differ in their last digits
    made = [rng.choice((vector(rng), rng.choice(some), [x * 3.7 for x in rng.choice(some)], [x + 1e-15 for x in rng.choice(some)], [0.0] * 7, [-0.0] * 7)) for _ in range(300)]
    rows = [(rng.randrange(3), n, v) for n, v in enumerate(made)] + [(None, 900, some[0]), (7, 901, some[0]), (1, 5, some[1])]
    asked = [(c, 10 * n, v) for n, v in enumerate([*some, [0.0] * 7, made[0], made[1]]) for c in range(3)] + [(8, 999, some[0])]
    for k, side in ((5, 8192), (3, 20), (1000, 50)):
        same(spark, rows, asked, k, side)


def test_vectors_that_a_product_may_not_tell(spark):
    rng = random.Random(3)
    nan, inf = math.nan, math.inf
    strange = [None, [], [1.0], [1.0, None, 2.0], [nan, 1.0, 2.0], [inf, 0.0, 1.0], [-inf, 1.0, 1.0], [1e200, 1e200, 1.0], [1e-180, 1e-180, 0.0], [1e-300, 0.0, 0.0], [1e-160, 1e-162, 3e-161], [1.0, 2.0, 3.0, 4.0], [1e150, 1.0, 1.0]]
    plain = [vector(rng, 3) for _ in range(20)]
    rows = [(n % 2, n, v) for n, v in enumerate(plain + strange)]
    for asked in (plain[:3] + strange, [[], None]):
        same(spark, rows, [(c, n, v) for n, v in enumerate(asked) for c in range(2)], 6, 5)
    same(spark, rows, [], 6, 5)
    same(spark, [], [(0, 1, plain[0])], 6, 5)


def test_equal_vectors_stay_few(spark):
    """Work on one vector that most rows hold doesn't grow with its copies times its queries."""
    import numpy as np
    import pyarrow as pa

    n = 20000
    rows = pa.table({"key": np.arange(n)[::-1], "vec": [[1.0, 2.0]] * n})
    asked = pa.table({"query_id": np.arange(2000), "query": [[2.0, 4.0]] * 2000})
    found = search._best_of_blocks(3)(None, rows, asked)
    assert found.num_rows == 6000 and set(found["key"].to_pylist()) == {0, 1, 2}


def test_recall_query_meets_blocks(spark, sf, monkeypatch):
    """No row of the corpus is joined to each query."""
    from loomlight import plans

    monkeypatch.setattr(search, "scored", None)
    df = plans.queries()["recall_at_k"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and df.count() == 5
