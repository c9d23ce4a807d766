"""The balanced forest: bounds of its nodes, placement of rows, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlight.operators import forest, search


def vectors(spark, n, seed=1, dim=16):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(n, None)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("local", [1 << 17, 300])
def test_nodes_and_leaves(spark, monkeypatch, local):
    monkeypatch.setattr(forest, "LOCAL_ROWS", local)
    v = vectors(spark, 2000)
    nodes, leaves = forest.build(v, trees=2)
    rows = {(r.tree, r.node): r for r in nodes.collect()}
    held = {(r.tree, r.node): r.n for r in leaves.groupBy("tree", "node").agg(F.count("*").alias("n")).collect()}
    for (tree, node), r in rows.items():
        if r.plane is None:
            assert r.size <= forest.LEAF and held[tree, node] == r.size
        else:
            sides = [rows[tree, 2 * node + k].size for k in (0, 1)]
            assert sum(sides) == r.size and min(sides) >= int(r.size * forest.SHARE) + 1
    assert all(sum(n for (t, _), n in held.items() if t == tree) == 2000 for tree in (0, 1))
    # a row falls to the leaf that holds it
    asked = v.where("vec_id < 200").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    fell = {(r.query_id, r.tree, r.node) for r in forest.placed_leaves(nodes, asked, 1).collect()}
    assert fell == {(r.vec_id, r.tree, r.node) for r in leaves.where("vec_id < 200").collect()}
    again = forest.insert(nodes, leaves, v.where("vec_id < 3").withColumn("vec_id", F.col("vec_id") + 10_000))
    assert {(r.vec_id - 10_000, r.tree, r.node) for r in again.where("vec_id >= 10000").collect()} == {x for x in fell if x[0] < 3}


def test_nearest_leaves_are_those_of_the_narrowest_margins(spark):
    v = vectors(spark, 600, 3)
    nodes, _ = forest.build(v, trees=1)
    tree = {r.node: r.plane for r in nodes.collect()}
    asked = v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for r in asked.collect():
        q = np.array(r["query"]) / np.linalg.norm(r["query"])
        todo, every = [(1, 0.0)], []
        while todo:
            node, margin = todo.pop()
            if tree[node] is None:
                every.append((margin, node))
                continue
            d = float(np.dot(tree[node], q))
            todo += [(2 * node + side, margin if (d >= 0) == bool(side) else max(margin, abs(d))) for side in (0, 1)]
        margins = sorted(m for m, _ in every)[:4]
        found = [x.node for x in forest.placed_leaves(nodes, asked.where(F.col("query_id") == r.query_id), 4).collect()]
        assert sorted(m for m, node in every if node in found) == pytest.approx(margins)


def test_equal_vectors_and_empty_tables(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(120)], "vec_id long, embedding array<double>")
    nodes, leaves = forest.build(same, trees=1)
    assert [(r.node, r.size) for r in nodes.collect()] == [(1, 120)] and leaves.count() == 120
    nodes, leaves = forest.build(same.limit(0), trees=2)
    asked = same.limit(1).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert forest.search(same, nodes, leaves, asked, 3).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_search(spark, size):
    from loomlight import plans

    sf = f"/root/testdata/{size}"
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = search.nearest(v, search.query_of(v, F.col("vec_id") % 50 == 0), 5)
    assert search.recall(exact, plans.queries()["forest_topk"](spark, sf)).agg(F.avg("recall")).first()[0] >= 0.9
