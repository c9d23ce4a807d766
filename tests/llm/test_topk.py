"""Top-k against full inner products."""

import math
import random

from pyspark.sql import functions as F

from loomlight.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k):
    usable = [(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(usable):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(usable) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k).collect())


def test_ties_nulls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    rng = random.Random(1)
    grid = [-1.0, -0.5, 0.0, 0.0, 0.25, 1.0]
    rows = [(i, [rng.choice(grid) for _ in range(6)]) for i in range(0, 900, 2)]
    rows += [(1, None), (None, [1.0] * 6), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (200, rows[100][1]), (5, [math.nan] * 6), (7, [math.inf] * 6), (9, []), (11, [0.5])]
    rows += [rows[7], rows[7], rows[50], rows[100]]
    assert run(spark, rows) == brute(rows, 10)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 0.0])]) == []
    assert run(spark, [(0, [1.0]), (0, [1.0])]) == [(0, 1, 0, 1024 * 1024)] * 2
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.3, 0.1])]) == [(0, 1, 1, 1024 * 307)]
