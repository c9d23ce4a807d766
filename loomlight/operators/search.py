"""Nearest neighbours: exact, in batches, by inverted cells and by random projections.

Corpora are DataFrames with an id and a vector (array of numbers); a query is a DataFrame with an id
and a vector, of few rows. Rows whose vector is null take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import vectors as V
from loomlight.operators.common import cut, sized, top_k, top_k_per


def query_of(corpus: DataFrame, ids: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Stored vectors as queries: query_id, query."""
    return corpus.where(ids & F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).alias("query"))


def scored(corpus: DataFrame, queries: DataFrame, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """Every row of the corpus with every query, its distance and score. The queries are the small side: broadcast if their size is proven small, met in blocks otherwise."""
    both = corpus.where(F.col(vector).isNotNull()).crossJoin(sized(queries, 4096))
    return both.withColumns({"distance": V.distance(vector, "query", metric), "score": V.similarity(vector, "query", metric)}).drop("query")


def nearest(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows for each query, filtered first: the corpus's columns but the vector, query_id, distance, score and rank; ties go to the smaller id."""
    pool = corpus if where is None else corpus.where(where)
    return top_k_per(scored(pool, queries, metric, vector).drop(vector), "query_id", k, F.desc("score"), key)


def nearest_then_filter(corpus: DataFrame, query: DataFrame, k: int, where: Column, factor: int = 5, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best of those among the factor * k best that pass a filter; may give fewer than k."""
    wide = top_k(scored(corpus, query, metric, vector).drop(vector), factor * k, F.desc("score"), key)
    return top_k(wide.where(where), k, F.desc("score"), key)


def nearest_batched(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """Cosine neighbours for many queries: query_id, key, score, rank.

    Each Arrow batch of the corpus meets each block of queries in one matrix product, and only its
    k best for each query leave the task. Queries travel in blocks of a fixed number of rows.
    """
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), vector)
    parts, held = [], []
    schema = "query_id long, key long, score double"
    spark = corpus.sparkSession

    def part(block_rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in block_rows]), _unit(np.array([r[1] for r in block_rows], np.float64))))

        def run(batches):
            ids, q = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = batch.column(1)
                v = _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))
                keys, scores = batch.column(0).to_numpy(), q @ v.T
                least = np.partition(scores, -min(k, len(keys)), axis=1)[:, -min(k, len(keys))][:, None]
                a, b = np.nonzero(scores >= least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(keys[b]), pa.array(scores[a, b])], names=["query_id", "key", "score"])

        return rows.mapInArrow(run, schema)

    for row in queries.select(F.col("query_id").cast("long"), "query").toLocalIterator():
        held.append(row)
        if len(held) == block:
            parts.append(part(held))
            held = []
    if held or not parts:
        parts.append(part(held) if held else spark.createDataFrame([], schema))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return top_k_per(found, "query_id", k, F.desc("score"), "key").withColumnRenamed("key", key)


def best_in_cells(rows: DataFrame, asked: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", side: int = 8192) -> DataFrame:
    """For each query of asked (cell, query_id, query) the k best by cosine of the rows (cell, key, vector) that share a cell with it: query_id, key, score, rank.

    The same as a join on the cell, V.cosine of every pair and a rank, to the last digit; ids are longs and ties go to the smaller one. Rows and queries of a cell are
    dealt to blocks of about `side` each (32 MB of components at most), and every two blocks meet in a group of their own: a matrix product proposes, sums in the order
    of the components decide, and k rows of each query leave the group. Vectors that a product may not tell (another size, null or not finite components, squares that leave the range) are joined as pairs.
    """
    rows = rows.where(F.col(vector).isNotNull()).select("cell", F.col(key).cast("long").alias("key"), F.col(vector).alias("vec"))
    asked = asked.where(F.col("query").isNotNull()).select("cell", F.col("query_id").cast("long").alias("query_id"), "query")
    size = F.size("query").alias("n")
    usual = asked.groupBy(size).count().orderBy(F.desc("count"), F.desc("n")).first()

    def plain(v: str) -> Column:
        squares = V.dot(v, v)
        return F.coalesce((F.size(v) > 0) & (F.size(v) == F.lit(usual and usual.n)) & ((squares == 0) | squares.between(1e-200, 1e200)), F.lit(False))

    odd = []
    if not (left := asked.where(~plain("query"))).isEmpty():
        odd.append((rows, left))
        asked = asked.where(plain("query"))
    if not (left := rows.where(~plain("vec"))).isEmpty():
        odd.append((left, asked))
        rows = rows.where(plain("vec"))
    side = min(side, (4 << 20) // max(usual.n, 1) + 1) if usual else side
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / side).alias(name))
    cells = cut(blocks(rows, "n_rows").join(blocks(asked, "n_asked"), "cell"))
    group, few = ["cell", "row_block", "asked_block"], sized(cells, 32)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), n)
    a = rows.join(few, "cell").select("cell", dealt("n_rows", "key", "vec").alias("row_block"), each("n_asked").alias("asked_block"), "key", "vec")
    b = asked.join(few, "cell").select("cell", each("n_rows").alias("row_block"), dealt("n_asked", "query_id", "query").alias("asked_block"), "query_id", "query")
    # so many tasks that none holds many groups: their work goes by pairs, not by the bytes that Spark would put together
    tasks = min(cells.agg(F.sum(F.col("n_rows") * F.col("n_asked"))).first()[0] or 1, 2000)
    a, b = (df.repartition(tasks, *group).groupBy(*group) for df in (a, b))
    found = a.cogroup(b).applyInArrow(_best_of_blocks(k), "query_id long, key long, score double")
    for x, y in odd:
        found = found.unionByName(x.join(sized(y, 4096), "cell").select("query_id", "key", V.cosine("vec", "query").alias("score")))
    return top_k_per(found, "query_id", k, F.desc("score"), "key").withColumnRenamed("key", key)


def _best_of_blocks(k: int, step: int = 512, pairs: int = 1 << 16, margin: float = 1e-9):
    """A function of two Arrow tables, rows (key, vec) and queries (query_id, query): the k best rows of each query. margin is far more than a product's error in cosines."""

    def components(column: pa.ChunkedArray) -> np.ndarray:
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64)
        return np.ascontiguousarray(values.reshape(len(column), -1).T)

    def dots(x: np.ndarray, y: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
        total = x[0][i] * y[0][j]
        for d in range(1, len(x)):
            total += x[d][i] * y[d][j]
        return total

    def run(_, rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asked.num_rows:
            ids, q = asked["query_id"].to_numpy(), components(asked["query"])
            keys, v = rows["key"].to_numpy(), components(rows["vec"])
            # of equal vectors only the k smallest ids can be among the best
            _, same = np.unique(np.ascontiguousarray(v.T).view(f"V{v.itemsize * len(v)}").ravel(), return_inverse=True)
            order = np.lexsort((keys, same))
            keep = order[_place(same[order]) < k]
            keys, v = keys[keep], v[:, keep]
            long_q, long_v = np.sqrt(dots(q, q)), np.sqrt(dots(v, v))
            unit_q, unit_v = (x / np.where(n == 0, 1, n) for x, n in ((q, long_q), (v, long_v)))
            m = min(k, len(keys))
            for start in range(0, len(ids), step):
                near = unit_q[:, start : start + step].T @ unit_v
                i, j = np.nonzero(near >= np.partition(near, -m, axis=1)[:, -m, None] - margin)
                i += start
                score = np.empty(len(i))
                for p in range(0, len(i), pairs):
                    at = slice(p, p + pairs)
                    scale = long_v[j[at]] * long_q[i[at]]
                    score[at] = np.where(scale == 0, 0.0, dots(v, q, j[at], i[at]) / np.where(scale == 0, 1, scale))
                order = np.lexsort((keys[j], -score, i))
                best = order[_place(i[order]) < k]
                found.append((ids[i[best]], keys[j[best]], score[best]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(columns, names=["query_id", "key", "score"])

    return run


def _place(x: np.ndarray) -> np.ndarray:
    """The place of each value among its equals, from 0; x is sorted."""
    return np.arange(len(x)) - np.searchsorted(x, x)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def mean_centroids(corpus: DataFrame, cell: str, vector: str = "embedding") -> DataFrame:
    """A centroid for each cell from known assignments: cell, centroid. Means are taken component by component, so no cell is gathered."""
    parts = corpus.select(F.col(cell).alias("cell"), F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy("cell", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = means.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    return ordered.select("cell", F.col("c.m").alias("centroid"))


def kmeans_cells(corpus: DataFrame, cells: int, seed: int = 7, sample: int = 200_000, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The corpus with a column cell, and the centroids (cell, centroid). Fitted on about `sample` rows, every row is assigned."""
    rows = corpus.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(V.doubles(vector)))
    n = rows.count()
    fitted = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(rows if n <= sample else rows.sample(sample / n, seed))
    centres = [(i, c.tolist()) for i, c in enumerate(fitted.clusterCenters())]
    return fitted.transform(rows).drop("_v"), corpus.sparkSession.createDataFrame(centres, "cell int, centroid array<double>")


def probed_cells(centroids: DataFrame, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, query, cell: each query with its `probes` nearest cells, computed once."""
    near = queries.crossJoin(sized(centroids, 4096)).withColumn("_c", V.cosine("query", "centroid"))
    return cut(top_k_per(near, "query_id", probes, F.desc("_c"), "cell").select("query_id", "query", "cell"))


def ivf_search(listed: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, probes: int, cell: str = "cell", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query the k best by cosine within its `probes` nearest cells. Written partitioned by cell, only those cells are read."""
    probed = probed_cells(centroids, queries, probes).withColumnRenamed("cell", "_cell")
    pool = listed.join(sized(probed, 4096), F.col(cell) == F.col("_cell"))
    best = pool.withColumn("score", V.cosine(vector, "query")).drop("query", "_cell", vector)
    return top_k_per(best, "query_id", k, F.desc("score"), key)


def lsh_search(corpus: DataFrame, queries: DataFrame, k: int, bucket: float = 1.0, tables: int = 8, reach: float = 1.3, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate neighbours: candidates share a bucket of random projections with the query, then are ranked by cosine."""
    unit = corpus.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(V.normalise(vector)))
    asked = queries.withColumn("_v", array_to_vector(V.normalise("query")))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    pairs = model.approxSimilarityJoin(unit, asked, reach, "_d")
    found = pairs.select(F.col(f"datasetA.{key}").alias(key), F.col("datasetB.query_id").alias("query_id"), V.cosine(f"datasetA.{vector}", "datasetB.query").alias("score"))
    return top_k_per(found.dropDuplicates(["query_id", key]), "query_id", k, F.desc("score"), key)


def projection_planes(dim: int, depth: int, trees: int, seed: int = 7) -> np.ndarray:
    """Random unit planes: trees x depth x dim."""
    planes = np.random.default_rng(seed).standard_normal((trees, depth, dim))
    return planes / np.linalg.norm(planes, axis=2, keepdims=True)


def projection_leaves(corpus: DataFrame, planes: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, tree, leaf: for each tree the sides of its planes that a vector is on, as a number. New rows are assigned alike, so an index grows by a union."""
    trees, depth, dim = planes.shape
    sides = F.array(*(
        F.struct(F.lit(t).alias("tree"), sum((F.when(V.dot(vector, F.lit(planes[t, d].tolist())) > 0, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(depth)), F.lit(0)).alias("leaf"))
        for t in range(trees)
    ))
    return corpus.where(F.size(vector) == dim).select(key, F.explode(sides).alias("s")).select(key, "s.*")


def forest_search(corpus: DataFrame, leaves: DataFrame, queries: DataFrame, planes: np.ndarray, k: int, flips: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Neighbours by cosine among the rows that share a leaf with the query in some tree, leaves that differ in one plane included if flips is 1."""
    depth = planes.shape[1]
    asked = projection_leaves(queries, planes, "query_id", "query")
    masks = [0, *(1 << d for d in range(depth))] if flips else [0]
    visited = asked.select("query_id", "tree", F.explode(F.transform(F.lit(masks), lambda m: F.col("leaf").bitwiseXOR(m))).alias("leaf"))
    candidates = leaves.join(sized(cut(visited), 32), ["tree", "leaf"]).select("query_id", key).distinct()
    found = candidates.join(corpus.select(key, vector), key).join(sized(queries, 4096), "query_id").withColumn("score", V.cosine(vector, "query")).drop(vector, "query")
    return top_k_per(found, "query_id", k, F.desc("score"), key)


def dimension(corpus: DataFrame, vector: str = "embedding") -> int | None:
    """The size of the first vector that isn't null, None without any."""
    row = corpus.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    return row.n if row else None


def check_dimension(corpus: DataFrame, queries: DataFrame, vector: str = "embedding") -> None:
    """Raises ValueError where queries and corpus differ in size."""
    have, want = dimension(corpus, vector), dimension(queries, "query")
    if have is not None and want is not None and have != want:
        raise ValueError(f"queries have {want} components, the corpus has {have}")


def index_info(corpus: DataFrame, vector: str = "embedding", cell: str | None = None) -> DataFrame:
    """One row: rows, indexed, dim and, if cells are named, cells."""
    more = (F.countDistinct(cell).alias("cells"),) if cell else ()
    return corpus.agg(F.count(F.lit(1)).alias("rows"), F.count(vector).alias("indexed"), F.max(F.size(vector)).cast("long").alias("dim"), *more)


def recall(exact: DataFrame, found: DataFrame, key: str = "vec_id") -> DataFrame:
    """Of each query the share of its exact neighbours that were found: query_id, recall."""
    a = exact.groupBy("query_id").agg(F.collect_set(key).alias("a"))
    b = found.groupBy("query_id").agg(F.collect_set(key).alias("b"))
    share = F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<bigint>")))) / F.size("a")
    return a.join(b, "query_id", "left").select("query_id", share.alias("recall"))


def with_fallback(corpus: DataFrame, queries: DataFrame, k: int, recent: Column, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best by dot; if no row has a vector, the k most recent with score 0.5."""
    if corpus.where(F.col(vector).isNotNull()).isEmpty():
        pool = corpus if where is None else corpus.where(where)
        return top_k(pool.withColumn("score", F.lit(0.5)), k, recent.desc(), key)
    return nearest(corpus, queries, k, "dot", where, key, vector)


def by_text(corpus: DataFrame, texts: DataFrame, k: int, embed, key: str = "vec_id", vector: str = "embedding", query_id: str = "item_id", text: str = "text") -> DataFrame:
    """Neighbours of texts: embed(column) gives their vectors, a built-in expression or a pandas UDF around a model."""
    return nearest(corpus, texts.select(F.col(query_id).alias("query_id"), embed(F.col(text)).alias("query")), k, key=key, vector=vector)
