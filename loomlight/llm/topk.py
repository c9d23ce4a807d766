"""Exact top-k inner products by term-at-a-time accumulation.

Rows are sparse: a row's terms are its components that aren't zero. Queries and candidates are
dealt into blocks of bounded size and every block of queries meets every block of candidates once.
There, the candidates' terms become posting lists; each query scatters its weighted postings into
one dense array of scores, a partition of the array gives its best k, and the blocks' best k merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlight.llm.shared import cut

QUERY_ROWS, CANDIDATE_ROWS = 1024, 4096
#: Components are scaled by this and rounded down.
SCALE = 1024


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones those of smaller ids; ids are in ascending order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Ids in ascending order, the rows' numbers, and for each row its terms and weights."""
    ids, numbers = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
    order = np.lexsort((numbers, ids))
    column = table.column("ints").combine_chunks()
    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    rows = []
    for k in order.tolist():
        x = flat[ends[k - 1] if k else 0 : ends[k]]
        terms = np.flatnonzero(x)
        rows.append((terms, x[terms]))
    return ids[order], numbers[order], rows


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row that is_query marks, its k best other rows: query_id, rank (from 1), vec_id, score.

    Scores are inner products of floor(1024 * x), equal scores go to the smaller vec_id. Vectors
    that are null or hold a null or non-finite component, and rows without a vec_id, take no part.
    Components that a shorter vector lacks are zero. Each repeat of a row is a row of its own: as a
    query it has its own list, and it is a candidate for the others, those of its vec_id too. An
    empty table gives no rows. Products and sums wrap beyond 64 bits.
    """
    scaled = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * SCALE))
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("ints"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = cut(rows)
    n = rows.agg(F.count(F.lit(1)).alias("c"), F.count_if("is_query").alias("q")).first()
    q_blocks, c_blocks = max(1, -(-n.q // QUERY_ROWS)), max(1, -(-n.c // CANDIDATE_ROWS))
    dealt = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.where("is_query").select("row", "vec_id", "ints", dealt(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    fresh = [F.col(c).alias(c) for c in ("row", "vec_id", "ints")]  # cogroup mistakes columns that both sides share
    candidates = rows.select(*fresh, dealt(c_blocks).alias("cb"), every(q_blocks).alias("qb"))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out_r, out_q, out_c, out_s = [], [], [], []
        if left.num_rows and right.num_rows:
            ids, numbers, held = matrix(right)
            postings: dict[int, tuple[list, list]] = {}
            lengths = np.fromiter((len(t) for t, _ in held), np.int64, len(held))
            terms, weights = np.concatenate([t for t, _ in held]), np.concatenate([w for _, w in held])
            owner = np.repeat(np.arange(len(held)), lengths)
            order = np.argsort(terms, kind="stable")
            terms, owner, weights = terms[order], owner[order], weights[order]
            cuts = np.flatnonzero(np.diff(terms)) + 1
            if len(terms):
                postings = dict(zip(terms[np.concatenate([[0], cuts])].tolist(), zip(np.split(owner, cuts), np.split(weights, cuts))))
            for q, own, (q_terms, q_weights) in zip(*matrix(left)):
                scores = np.zeros(len(ids), np.int64)
                for term, weight in zip(q_terms.tolist(), q_weights.tolist()):
                    if term in postings:
                        at, w = postings[term]
                        scores[at] += weight * w
                others = np.flatnonzero(numbers != own)
                kept = others[best(scores[others], ids[others], k)]
                out_r.append(np.full(len(kept), own))
                out_q.append(np.full(len(kept), q))
                out_c.append(ids[kept])
                out_s.append(scores[kept])
        join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table({"row": join(out_r), "query_id": join(out_q), "vec_id": join(out_c), "score": join(out_s)})

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(block, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
