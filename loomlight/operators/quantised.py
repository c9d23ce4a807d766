"""An index of product-quantised residuals: a byte for each part of a vector, exact scores for a short list only.

A unit vector belongs to the nearest of `cells` centroids; what is left of it is cut into parts, and each part
becomes the number of the nearest of 256 prototypes. A search looks at the cells nearest to the query,
estimates scores there from the codes by adding up table entries, and reads the vectors
themselves only for the `shortlist` rows of each query with the best estimates. Centroids and prototypes are fitted on a
bounded sample; every row is encoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.functions import vectors as V
from loomlight.operators.common import cut, sized, stored, top_k_per

#: Rows that a fit uses at most, rounds of it, and prototypes of a part.
FIT_ROWS, ROUNDS, PROTOTYPES = 20_000, 12, 256
#: Queries that travel to the tasks at once.
QUERY_ROWS = 1024


@dataclass(frozen=True)
class Codebook:
    """centroids: cells by dim; prototypes: parts by prototypes by dim / parts."""

    centroids: np.ndarray
    prototypes: np.ndarray

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its codes, a byte for each part."""
        cell = _nearest(unit, self.centroids)
        left = (unit - self.centroids[cell]).reshape(len(unit), len(self.prototypes), -1)
        return cell, np.stack([_nearest(left[:, p], w) for p, w in enumerate(self.prototypes)], axis=1).astype(np.uint8)

    def tables(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries: products with the centroids, and with the prototypes of each part."""
        parts = unit.reshape(len(unit), len(self.prototypes), -1)
        return unit @ self.centroids.T, np.einsum("qpd,pkd->qpk", parts, self.prototypes)


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return ((to * to).sum(axis=1)[None, :] - 2 * x @ to.T).argmin(axis=1)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k means of the rows of x, from rows drawn at random; empty ones stay where they are."""
    at = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        of = _nearest(x, at)
        count = np.bincount(of, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, of, x)
        at[count > 0] = total[count > 0] / count[count > 0, None]
    return at


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(corpus: DataFrame, cells: int = 16, parts: int = 16, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> Codebook:
    """Fitted on the FIT_ROWS rows whose ids have the least hashes. The vectors' size must be a multiple of parts; raises ValueError otherwise, or without vectors."""
    rows = corpus.where(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), key, V.normalise(vector).alias("unit"))
    x = np.array([r.unit for r in rows.orderBy("h", key).limit(FIT_ROWS).collect()], np.float64)
    if not len(x) or x.shape[1] % parts:
        raise ValueError(f"vectors of a multiple of {parts} components are needed")
    rng = np.random.default_rng(seed)
    centroids = _means(x, cells, rng)
    left = (x - centroids[_nearest(x, centroids)]).reshape(len(x), parts, -1)
    held = [_means(left[:, p], PROTOTYPES, rng) for p in range(parts)]
    return Codebook(centroids, np.stack(held))


def encode(corpus: DataFrame, book: Codebook, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cell, codes of each row with a vector. Written partitioned by cell, a search reads only its cells; new rows are encoded alike and added by a union."""
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key), V.normalise(vector).alias("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = book.encode(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=[key, "cell", "codes"])

    return rows.mapInArrow(run, rows.select(key, F.lit(0).alias("cell"), F.lit(b"").alias("codes")).schema)


def shortlisted(encoded: DataFrame, book: Codebook, queries: DataFrame, shortlist: int, probes: int, key: str = "vec_id") -> DataFrame:
    """query_id and key of the `shortlist` rows with the best estimates in the `probes` cells nearest to each query. A task sends on so many rows of a query at most."""
    asked = queries.select(F.col("query_id").cast("long"), V.normalise("query").alias("unit"))
    schema = encoded.select(F.lit(0).cast("long").alias("query_id"), F.col(key), F.lit(0.0).alias("estimate")).schema

    def estimated(ids: np.ndarray, unit: np.ndarray) -> DataFrame:
        near, table = book.tables(unit)
        visited = np.zeros(near.shape, bool)
        np.put_along_axis(visited, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell = batch.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                rows_of = np.arange(codes.shape[1])
                q_out, row_out, e_out = [], [], []
                for q in range(len(ids)):
                    rows = np.flatnonzero(visited[q][cell])
                    e = near[q][cell[rows]] + table[q][rows_of, codes[rows]].sum(axis=1)
                    if len(rows) > shortlist:
                        least = np.partition(e, -shortlist)[-shortlist]
                        rows, e = rows[e >= least], e[e >= least]
                    q_out.append(np.full(len(rows), ids[q]))
                    row_out.append(rows)
                    e_out.append(e)
                keys = batch.column(key).take(pa.array(np.concatenate(row_out)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q_out)), keys, pa.array(np.concatenate(e_out))], names=["query_id", key, "estimate"])

        wanted = np.flatnonzero(visited.any(axis=0)).tolist()
        return encoded.where(F.col("cell").isin(wanted)).select(key, "cell", "codes").mapInArrow(run, schema)

    found, held = None, []
    for row in asked.toLocalIterator():  # as blocks of QUERY_ROWS
        held.append(row)
        if len(held) == QUERY_ROWS:
            part = estimated(np.array([r[0] for r in held]), np.array([r[1] for r in held]))
            found, held = part if found is None else found.unionByName(part), []
    if held:
        part = estimated(np.array([r[0] for r in held]), np.array([r[1] for r in held]))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], schema).select("query_id", key)
    return top_k_per(found, "query_id", shortlist, F.desc("estimate"), key, rank="_r").select("query_id", key)


def search(corpus: DataFrame, encoded: DataFrame, book: Codebook, queries: DataFrame, k: int, shortlist: int, probes: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank: the k best by exact cosine among the short list of each query; ties go to the smaller key."""
    near = cut(shortlisted(encoded, book, queries, shortlist, probes, key))
    rows = corpus.select(key, vector).join(sized(near, 32), key).join(sized(queries, 4096), "query_id")
    return top_k_per(rows.withColumn("score", V.cosine(vector, "query")).drop(vector, "query"), "query_id", k, F.desc("score"), key)


def index(corpus: DataFrame, cells: int = 16, parts: int = 16, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Codebook]:
    """The encoded table, stored, and its codebook."""
    book = fit(corpus, cells, parts, seed, key, vector)
    return stored(encode(corpus, book, key, vector), "codes"), book
