"""Clusters against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from loomlight.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, ids int, points string"


def brute(rows, clusters=40, rounds=5, size=64):
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    where = [v for _, v in first[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(where))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(where)):
            own = [v for (_, v), c in zip(kept, of) if c == k]
            if own:
                where[k] = tuple(sum(x) // len(own) for x in zip(*own))
    last = [(i, *nearest(v)) for i, v in kept]
    fits = lambda x: x if x < 1 << 63 else None
    return sorted((str(i), k, d, fits(sum(e for _, e, c in last if c == k)), fits(sum(e for _, e, _ in last)), hashlib.sha256(",".join(map(str, where[k])).encode()).hexdigest()) for i, d, k in last)



def run(spark, rows):
    df = spark.createDataFrame([(*r, "z", "z", 1, "z") for r in rows], SCHEMA).repartition(3)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.digests(df).collect())


@pytest.mark.parametrize("rows, leaf", [(4096, 16), (37, 2)])
def test_random(spark, monkeypatch, rows, leaf):
    monkeypatch.setattr(centroids, "TREE_ROWS", rows)
    monkeypatch.setattr(centroids, "LEAF", leaf)
    rng = random.Random(rows)
    hubs = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(25)]
    data = [(k, [x + rng.gauss(0, 0.05) for x in rng.choice(hubs)]) for k in range(250)]
    data += [(k, [rng.choice([-0.25, 0.0, 0.25]) for _ in range(2)] + [0.0] * 62) for k in range(300, 360)]  # ties
    data += [(3, data[3][1])] * 30 + [(None, data[5][1]), (3, data[9][1]), (400, None), (401, [1.0]), (402, []), (403, [math.nan] * 64), (404, [1.0] * 63 + [None]), (405, [math.inf] + [0.0] * 63), (406, [1.0] * 65)]
    assert run(spark, data) == brute(data)


def test_few(spark):
    assert run(spark, []) == []
    data = [(k, [float(k % 5)] * 64) for k in range(12)] + [(None, [9.0] * 64)]
    assert run(spark, data) == brute(data)


def test_large_components(spark):
    rng = random.Random(3)
    data = [(k, [rng.choice([-741_000.0, 741_000.0, 0.5]) for _ in range(64)]) for k in range(90)]
    assert run(spark, data) == brute(data)
    assert run(spark, [(1, [1e30] + [0.0] * 63), (2, [1.0] * 64)]) == brute([(2, [1.0] * 64)])


def test_filtering_prunes_and_assigns_whole_nodes():
    rng = np.random.default_rng(1)
    hubs = rng.integers(-2000, 2000, (6, 64))
    points = np.concatenate([h + rng.integers(-9, 9, (100, 64)) for h in hubs])
    tree = centroids.Tree(points)
    points = points[tree.order]
    whole = sum(int(tree.levels[h][0][which].sum()) for h, which, _ in centroids.walk(len(points), tree.levels, points, hubs) if h is not None)
    assert whole > 300
    counts, low, high, total = tree.levels[0]
    assert counts[0] == 600 and (low[0] == points.min(axis=0)).all() and (high[0] == points.max(axis=0)).all() and (total[0] == points.sum(axis=0)).all()


def test_a_tie_on_the_boundary_is_kept():
    low, high = np.zeros((1, 2), np.int64), np.array([[4, 4]])
    where = np.array([[0, 2], [8, 2], [9, 2]])
    assert centroids.undominated(low, high, np.ones((1, 3), bool), where).tolist() == [[True, True, False]]
