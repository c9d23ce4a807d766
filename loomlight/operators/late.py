"""Late interaction: documents of token vectors scored by the best token for each token of a query.

Tokens are rows (doc, tok, vec), query tokens rows (q, qvec), few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import vectors as V
from loomlight.operators.common import cut, sized, top_k, top_k_per


def similarities(tokens: DataFrame, query: DataFrame) -> DataFrame:
    """doc, tok, q, dot for every token and every query token."""
    return tokens.crossJoin(sized(query, 4096)).select("doc", "tok", "q", V.dot("vec", "qvec").alias("dot"))


def _sum_of_best(dots: DataFrame) -> DataFrame:
    return dots.groupBy("doc", "q").agg(F.max("dot").alias("best")).groupBy("doc").agg(F.sum("best").alias("score"))


def maxsim(tokens: DataFrame, query: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """doc, score: exact sums of best dots, over all documents or those of candidates (doc)."""
    pool = tokens if candidates is None else tokens.join(sized(candidates, 24), "doc", "left_semi")
    return top_k(_sum_of_best(similarities(pool, query)), k, F.desc("score"), "doc")


def maxsim_of_nearest(tokens: DataFrame, query: DataFrame, k: int, per_token: int = 50) -> DataFrame:
    """As maxsim, but each query token sees its per_token nearest tokens only; a document without one of them gets 0 for that token."""
    near = top_k_per(similarities(tokens, query), "q", per_token, F.desc("dot"), "tok")
    return top_k(_sum_of_best(near), k, F.desc("score"), "doc")


def recommended_cells(n: Column) -> Column:
    """How many centroids n tokens deserve: a power of two near n / 400 within 16 to 4096, at most a quarter of n."""
    power = F.pow(F.lit(2.0), F.bround(F.log2(F.greatest(F.lit(16.0), F.floor(n / 400).cast("double"))), 0))
    return F.greatest(F.lit(1), F.least(F.least(F.greatest(power, F.lit(16.0)), F.lit(4096.0)), F.floor(n / 4).cast("double"))).cast("long")


def assign(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """tokens with their nearest centroid by dot (cell), ties to the smaller cell. New tokens join an index by the same step."""
    best = F.max_by("cell", F.struct(V.dot("vec", "centroid"), -F.col("cell")))
    pairs = tokens.crossJoin(sized(centroids, 4096))
    return pairs.groupBy("doc", "tok").agg(best.alias("cell"))


def probed_documents(assigned: DataFrame, centroids: DataFrame, query: DataFrame, probes: int, per_token: bool = False) -> DataFrame:
    """doc: the documents with a token in one of the nearest cells; nearest by the sum over the query's tokens, or for each token on its own."""
    dots = centroids.crossJoin(sized(query, 4096)).select("cell", "q", V.dot("centroid", "qvec").alias("dot"))
    if per_token:
        cells = top_k_per(dots, "q", probes, F.desc("dot"), "cell").select("cell").distinct()
    else:
        cells = top_k(dots.groupBy("cell").agg(F.sum("dot").alias("s")), probes, F.desc("s"), "cell").select("cell")
    return assigned.join(sized(cut(cells), 16), "cell", "left_semi").select("doc").distinct()


def plaid(tokens: DataFrame, assigned: DataFrame, centroids: DataFrame, query: DataFrame, k: int, probes: int = 4, per_token: bool = False) -> DataFrame:
    """Two stages: candidate documents from cells, exact maxsim on them."""
    return maxsim(tokens, query, k, cut(probed_documents(assigned, centroids, query, probes, per_token)))


def normalised(tokens: DataFrame) -> DataFrame:
    """Tokens with unit vectors, as an ingest stores them."""
    return tokens.withColumn("vec", V.normalise("vec"))


def maxsim_of_hits(tokens: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """maxsim over hits (q, tok, dot) of an approximate index."""
    return top_k(_sum_of_best(hits.join(tokens.select("doc", "tok"), "tok")), k, F.desc("score"), "doc")


def two_step(tokens: DataFrame, query: DataFrame, k: int, per_token: int = 50, factor: int = 2) -> DataFrame:
    """min(factor * k, 100) documents by their nearest tokens, rescored exactly and cut to k."""
    wide = cut(maxsim_of_nearest(tokens, query, min(factor * k, 100), per_token))
    return maxsim(tokens, query, k, wide.select("doc"))
