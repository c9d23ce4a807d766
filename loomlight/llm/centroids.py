"""Exact k-means by kd-tree filtering.

Every task packs its vectors into kd-trees of at most TREE_ROWS vectors, whose nodes hold count,
sums of integers and bounding box. The trees are written once. In each round the centroids, a
few numbers, go to the trees: a node takes over from its parent the centroids that may be nearest to
one of its vectors, and drops those that another one beats strictly all over its box. Where one is
left, the node's sums go to it whole; leaves with several are resolved vector by vector. Tasks send
on a row of sums for each centroid. All arithmetic is in integers, so the result doesn't depend on how
vectors are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.shared import cut, scratch

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of a tree, and of its leaves at most.
TREE_ROWS, LEAF = 4096, 16
#: Scaled components beyond this have no exact distance in 64 bits: 64 squares of twice as much stay below 2 ** 63.
LARGEST = 189_812_531
#: Up to this, products of integers are exact in floating point.
_SMALL = 1 << 20


def usable(vector, size: int = SIZE):
    """Whether a vector has the size and only finite components, small enough for exact distances."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x.cast("double") * SCALE)) <= LARGEST)
    return F.coalesce((F.size(vector) == size) & F.forall(vector, fits), F.lit(False))


class Tree:
    """A kd-tree over the rows of points: level h has 2 ** h nodes, the same number of points in each but for one."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.height = max(0, int(np.ceil(np.log2(n / LEAF)))) if n > LEAF else 0
        self.order, self.levels = np.arange(n), []
        for h in range(self.height + 1):
            begins = self.begins(n, h)
            held = points[self.order]
            low, high = np.minimum.reduceat(held, begins), np.maximum.reduceat(held, begins)
            self.levels.append((np.diff(np.append(begins, n)), low, high, np.add.reduceat(held, begins)))
            if h < self.height:
                node = np.repeat(np.arange(len(begins)), self.levels[-1][0])
                widest = (high - low).argmax(axis=1)
                self.order = self.order[np.lexsort((held[np.arange(n), widest[node]], node))]

    @staticmethod
    def begins(n: int, level: int) -> np.ndarray:
        return (np.arange(1 << level) * n) >> level


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= _SMALL:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each centroid. Sums may wrap on the way, the result fits."""
    return (points * points).sum(axis=1)[:, None] - 2 * _product(points, centroids) + (centroids * centroids).sum(axis=1)[None, :]


def undominated(low: np.ndarray, high: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """alive (nodes by centroids) without those that the centroid nearest to the box's middle beats strictly at each point of the box."""
    twice = 2 * centroids
    middle = np.where(alive, distances(low + high, twice), np.iinfo(np.int64).max).argmin(axis=1)
    squares, out = (centroids * centroids).sum(axis=1), alive.copy()
    for best in np.unique(middle).tolist():
        nodes = np.flatnonzero(middle == best)
        towards = centroids - centroids[best]
        # at the corner that lies furthest towards the other centroid
        reach = _product(high[nodes], np.maximum(towards, 0)) + _product(low[nodes], np.minimum(towards, 0))
        lead = squares[None, :] - squares[best] - 2 * reach
        out[nodes] &= lead <= 0
        out[nodes, best] = True
    return out


def walk(n: int, levels: list, points: np.ndarray, centroids: np.ndarray):
    """Yields whole nodes with their centroid (level, nodes, centroids) and, with level None, points of leaves with theirs. points lie in the tree's order."""
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    for h, (_, low, high, _) in enumerate(levels):
        alive = undominated(low[nodes], high[nodes], alive, centroids)
        single = alive.sum(axis=1) == 1
        if single.any():
            yield h, nodes[single], alive[single].argmax(axis=1)
        nodes, alive = nodes[~single], alive[~single]
        if h + 1 < len(levels):
            nodes, alive = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([alive, alive])
    if len(nodes):
        begins = np.append(Tree.begins(n, len(levels) - 1), n)
        size = begins[nodes + 1] - begins[nodes]
        places = np.repeat(begins[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        rest = np.where(np.repeat(alive, size, axis=0), distances(points[places], centroids), np.iinfo(np.int64).max)
        yield None, places, rest.argmin(axis=1)


def _trees(vectors: DataFrame) -> DataFrame:
    """Rows (ids, points, levels) of the trees of vectors (vec_id, ints)."""
    ids = vectors.schema["vec_id"].dataType
    schema = vectors.select(F.array("vec_id").alias("ids"), F.lit(b"").alias("points"), F.array(F.lit(b"")).alias("levels")).schema

    def tree(rows: pa.Table) -> pa.RecordBatch:
        points = rows.column("ints").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        made = Tree(points)
        held = rows.column("vec_id").combine_chunks().take(pa.array(made.order))
        listed = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        levels = [np.concatenate([c[:, None], low, high, total], axis=1).astype("<i8").tobytes() for c, low, high, total in made.levels]
        return pa.RecordBatch.from_arrays([listed, pa.array([points[made.order].astype("<i4").tobytes()], pa.binary()), pa.array([levels], pa.list_(pa.binary()))], names=["ids", "points", "levels"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, TREE_ROWS - rows))
                rows += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if rows == TREE_ROWS:
                    yield tree(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield tree(pa.Table.from_batches(held))

    assert ids == schema["ids"].dataType.elementType
    return vectors.mapInArrow(run, schema)


def _opened(batch: pa.RecordBatch, size: int):
    """Each tree of a batch: its points in order, its levels, its ids."""
    ids = batch.column("ids")
    for k, (points, levels) in enumerate(zip(batch.column("points").to_pylist(), batch.column("levels").to_pylist())):
        held = np.frombuffer(points, "<i4").astype(np.int64).reshape(-1, size)
        parts = [np.frombuffer(x, "<i8").astype(np.int64).reshape(-1, 1 + 3 * size) for x in levels]
        yield held, [(x[:, 0], x[:, 1 : 1 + size], x[:, 1 + size : 1 + 2 * size], x[:, 1 + 2 * size :]) for x in parts], ids[k].values


def _sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each centroid's vectors."""
    k, size = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            for points, levels, _ in _opened(batch, size):
                for h, which, to in walk(len(points), levels, points, centroids):
                    np.add.at(counts, to, 1 if h is None else levels[h][0][which])
                    np.add.at(sums, to, points[which] if h is None else levels[h][3][which])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(run, "cluster int, n long, sums array<long>")
    # at most clusters * size rows, from each task and in all
    added = parts.select("cluster", "n", F.posexplode("sums").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(added.collect(), key=lambda r: (r["cluster"], r.d)):
        out.setdefault(r["cluster"], (r.n, []))[1].append(int(r.x))
    return out


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    size = centroids.shape[1]
    schema = trees.select(F.col("ids")[0].alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema

    def run(batches):
        for batch in batches:
            for points, levels, ids in _opened(batch, size):
                cluster = np.zeros(len(points), np.int64)
                for h, which, to in walk(len(points), levels, points, centroids):
                    if h is None:
                        cluster[which] = to
                    else:
                        begins = np.append(Tree.begins(len(points), h), len(points))
                        for a, b, c in zip(begins[which].tolist(), begins[which + 1].tolist(), to.tolist()):
                            cluster[a:b] = c
                apart = points - centroids[cluster]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array((apart * apart).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, schema)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every kept vector after so many rounds, and the final centroids.

    Kept are vectors with size components, none null or non-finite; scaled components are
    floor(256 * x). Components beyond LARGEST (x beyond 741,455) would have no exact distance in
    64 bits: such vectors are not kept either. Repeated rows are vectors of their own. Rows without
    an id are assigned like others, and are first centroids only if there are too few with one; of
    equal ids the smaller vector comes first. Fewer vectors than clusters make fewer clusters, and
    an empty table gives no rows.
    """
    ints = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    kept = vectors.where(usable(F.col(embedding), size)).select(F.col(vec_id).alias("vec_id"), ints.alias("ints"))
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "ints").limit(clusters).select("ints").collect()
    centroids = np.array([r.ints for r in first], np.int64).reshape(-1, size)
    path = scratch(vectors.sparkSession, "kd-trees")
    _trees(kept).write.parquet(path)
    trees = vectors.sparkSession.read.parquet(path)
    for _ in range(rounds if len(centroids) else 0):
        after = centroids.copy()
        for k, (n, sums) in _sums(trees, centroids).items():
            after[k] = [x // n for x in sums]
        if (after == centroids).all():
            break  # a fixed point
        centroids = after
    if not len(centroids):
        return trees.select(F.col("ids")[0].alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    return _assigned(trees, centroids), centroids


def digests(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the centroid's sha256 of every kept vector; see cluster. Inertia beyond 64 bits is null. Other columns are ignored."""
    found, centroids = cluster(vectors, vec_id=vec_id, embedding=embedding)
    found = cut(found)
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    # at most one row for each centroid
    totals = {r["cluster"]: int(r.part) for r in inertia.collect()}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(k, fits(v), fits(sum(totals.values())), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, v in totals.items()]
    known = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
