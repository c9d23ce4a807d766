"""A forest of balanced projection trees over vectors, kept as tables of nodes and leaves.

A node of more than LEAF rows is split by a plane through the origin, whose normal is the
difference of two of its own vectors: of TRIES pairs the one that splits it most evenly, if each side
keeps a tenth. Nodes too large for one task are grown level by level: a pass draws pairs for every
open node, another counts the sides of their planes. Once a node has at most LOCAL_ROWS rows its
whole subtree is grown in one task. The node with number i has the children 2 i and 2 i + 1, on the
negative and the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlight.functions import vectors as V
from loomlight.operators.common import cut, sized, stored, top_k_per

LEAF, TRIES, SHARE = 50, 10, 0.1
#: Rows whose subtree one task grows. Planes of larger nodes travel to all tasks: TRIES for each of them, a small part of the vectors.
LOCAL_ROWS = 1 << 17
#: Levels at most: a split keeps nine tenths at worst, but node numbers are 64 bits.
DEEPEST = 60


def _best(sides: np.ndarray, n: int) -> int:
    """Of columns of counts on the right side the place of the most even split, -1 if each leaves a side less than its share."""
    smaller = np.minimum(sides, n - sides)
    k = int(smaller.argmax()) if len(smaller) else -1
    return k if k >= 0 and smaller[k] >= int(n * SHARE) + 1 else -1


def _pairs(rng: np.random.Generator, n: int) -> np.ndarray:
    a = rng.integers(0, n, TRIES)
    return np.stack([a, (a + rng.integers(1, n, TRIES)) % n], axis=1)


def _grow(unit: np.ndarray, root: int, seed: int):
    """Yields (node, plane or None, rows) of the subtree over the rows of unit, which are in a fixed order."""
    todo = [(root, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        plane = None
        if len(rows) > LEAF and node < 1 << DEEPEST:
            pair = _pairs(np.random.default_rng([seed, node]), len(rows))
            planes = unit[rows[pair[:, 0]]] - unit[rows[pair[:, 1]]]
            right = unit[rows] @ planes.T >= 0
            best = _best(right.sum(axis=0), len(rows))
            if best >= 0:
                plane = planes[best]
                todo += [(2 * node, rows[~right[:, best]]), (2 * node + 1, rows[right[:, best]])]
        yield node, plane, rows


def _down(unit: np.ndarray, planes: dict[int, np.ndarray], nodes: np.ndarray) -> np.ndarray:
    """The open nodes that rows at these nodes fall to."""
    moving = np.ones(len(nodes), bool)
    while moving.any():
        moving &= np.isin(nodes, list(planes))
        for node in np.unique(nodes[moving]).tolist():
            rows = np.flatnonzero(moving & (nodes == node))
            nodes[rows] = 2 * node + (unit[rows] @ planes[node] >= 0)
    return nodes


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _placed(rows: DataFrame, planes: dict[int, np.ndarray]) -> DataFrame:
    """rows (key, unit) with the node that the planes lead to from the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = _down(_matrix(batch.column("unit")), planes, np.ones(batch.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes)], names=[*batch.schema.names, "node"])

    return rows.mapInArrow(run, rows.withColumn("node", F.lit(0).cast("long")).schema)


def _upper(rows: DataFrame, tree: int, seed: int) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """The planes of nodes of more than LOCAL_ROWS rows, and their sizes."""
    planes: dict[int, np.ndarray] = {}
    sizes, hopeless = {1: rows.count()}, set()
    while large := [node for node, n in sizes.items() if n > LOCAL_ROWS and node not in planes and node not in hopeless]:
        placed = _placed(rows, planes).where(F.col("node").isin(large))
        drawn = top_k_per(placed.withColumn("_h", F.xxhash64(F.lit(seed + tree), "node", "key")), "node", 2 * TRIES, "_h", "key", rank="_r")
        tried: dict[int, list] = {}
        for r in drawn.select("node", "_r", "unit").orderBy("node", "_r").collect():
            tried.setdefault(r.node, []).append(np.array(r.unit))
        normals = {node: np.array([a - b for a, b in zip(v[::2], v[1::2])]) for node, v in tried.items()}

        def sides(batches: Iterator[pa.RecordBatch], normals=normals) -> Iterator[pa.RecordBatch]:
            counts: dict[int, np.ndarray] = {}
            for batch in batches:
                nodes, unit = batch.column("node").to_numpy(), _matrix(batch.column("unit")) if batch.num_rows else None
                for node in np.unique(nodes).tolist():
                    right = unit[nodes == node] @ normals[node].T >= 0
                    counts[node] = counts.get(node, 0) + np.append(right.sum(axis=0), len(right))
            out = [(node, k, int(c)) for node, v in counts.items() for k, c in enumerate(v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["node", "k", "c"])

        found: dict[int, dict[int, int]] = {}
        for r in placed.mapInArrow(sides, "node long, k long, c long").groupBy("node", "k").agg(F.sum("c").alias("c")).collect():
            found.setdefault(r.node, {})[r.k] = r.c
        for node in large:
            counts = found[node]
            n = counts[len(counts) - 1]
            right = np.array([counts[k] for k in range(len(counts) - 1)])
            best = _best(right, n)
            if best < 0:
                hopeless.add(node)
                continue
            planes[node] = normals[node][best]
            sizes |= {2 * node: n - int(right[best]), 2 * node + 1: int(right[best])}
    return planes, {node: sizes[node] for node in planes}


def _grower(tree: int, seed: int):
    """A function that grows the subtree of the rows (key, unit, node) of one node."""

    def grow(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"tree": pa.array([], pa.int32()), "node": pa.array([], pa.int64()), "plane": pa.array([], pa.list_(pa.float64())), "size": pa.array([], pa.int64()), "keys": pa.array([], pa.list_(pa.int64()))})
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, unit = keys[order], _matrix(table.column("unit").combine_chunks())[order]
        root = table.column("node")[0].as_py()
        made = list(_grow(unit, root, seed * 1000 + tree)) if len(unit) <= LOCAL_ROWS else [(root, None, np.arange(len(unit)))]
        columns = {
            "tree": pa.array([tree] * len(made), pa.int32()),
            "node": pa.array([node for node, _, _ in made], pa.int64()),
            "plane": pa.array([p if p is None else p.tolist() for _, p, _ in made], pa.list_(pa.float64())),
            "size": pa.array([len(r) for _, _, r in made], pa.int64()),
            "keys": pa.array([keys[r].tolist() if p is None else None for _, p, r in made], pa.list_(pa.int64())),
        }
        return pa.table(columns)

    return grow


def build(corpus: DataFrame, trees: int = 4, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Two stored tables: nodes (tree, node, plane, null for leaves, size) and leaves (tree, node, key).

    Null vectors take no part; the others need one size. A node that no pair splits well enough, as
    of equal vectors, stays a leaf however large. The same rows give the same forest.
    """
    rows = stored(corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), V.normalise(vector).alias("unit")), "forest-rows")
    schema = "tree int, node long, plane array<double>, size long, keys array<long>"
    parts = []
    for tree in range(trees):
        planes, sizes = _upper(rows, tree, seed)
        parts.append(_placed(rows, planes).groupBy("node").applyInArrow(_grower(tree, seed), schema))
        if planes:
            top = [(tree, node, p.tolist(), sizes[node], None) for node, p in planes.items()]
            parts.append(corpus.sparkSession.createDataFrame(top, schema))
    made = parts[0]
    for more in parts[1:]:
        made = made.unionByName(more)
    made = stored(made, "forest")
    nodes = made.select("tree", "node", "plane", "size")
    return nodes, made.where(F.col("plane").isNull()).select("tree", "node", F.explode("keys").alias(key))


def placed_leaves(nodes: DataFrame, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, tree, node: in each tree the `probes` leaves nearest to a query, by the widest margin that a path crosses. Level by level, only so many nodes of a query stay in sight: a node's nearer child has its margin, so no leaf is lost."""
    deepest = nodes.agg(F.max("node").alias("n")).first().n
    if deepest is None:
        return queries.select("query_id", F.lit(0).alias("tree"), F.lit(0).cast("long").alias("node")).limit(0)
    known = sized(nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "plane"), 1024)
    roots = nodes.select("tree").distinct()
    sight = queries.select("query_id", V.normalise("query").alias("q")).crossJoin(F.broadcast(roots)).select("query_id", "q", "tree", F.lit(1).cast("long").alias("node"), F.lit(0.0).alias("margin"), F.lit(True).alias("open"))  # as many roots as trees
    for _ in range(deepest.bit_length()):
        met = sight.join(known, F.col("open") & (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n")), "left").withColumn("_d", V.dot("plane", "q"))
        child = lambda right, near: F.struct((2 * F.col("node") + right).alias("node"), F.when(near, F.col("margin")).otherwise(F.greatest("margin", F.abs("_d"))).alias("margin"), F.lit(True).alias("open"))
        same = F.array(F.struct("node", "margin", F.lit(False).alias("open")))
        split = F.array(child(0, F.col("_d") < 0), child(1, F.col("_d") >= 0))
        moved = met.select("query_id", "q", "tree", F.explode(F.when(F.col("plane").isNull(), same).otherwise(split)).alias("c")).select("query_id", "q", "tree", "c.*")
        w = Window.partitionBy("query_id", "tree").orderBy("margin", "node")
        sight = moved.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= probes).drop("_r")
    return sight.select("query_id", "tree", "node")


def search(corpus: DataFrame, nodes: DataFrame, leaves: DataFrame, queries: DataFrame, k: int, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank: for each query the k best by cosine among the rows of its leaves; ties go to the smaller key."""
    visited = cut(placed_leaves(nodes, queries, probes))
    candidates = leaves.join(sized(visited, 32), ["tree", "node"]).select("query_id", key).distinct()
    found = candidates.join(corpus.select(key, vector), key).join(sized(queries, 4096), "query_id").withColumn("score", V.cosine(vector, "query")).drop(vector, "query")
    return top_k_per(found, "query_id", k, F.desc("score"), key)


def insert(nodes: DataFrame, leaves: DataFrame, rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """leaves with new rows, each in the leaf it falls to in every tree."""
    asked = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).alias("query"))
    return leaves.unionByName(placed_leaves(nodes, asked, 1).select("tree", "node", F.col("query_id").alias(key)))
