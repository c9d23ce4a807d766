"""Fusion of ranked lists, reranking and duplicates among results.

A ranked list is rows (source, id, rank[, score]) for one query; for many, add their column to `by`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.operators import models
from loomlight.operators.common import top_k, top_k_per

RRF_K = 60


def ranked(df: DataFrame, source: str, k: int, *order: Column | str, key: str) -> DataFrame:
    """The first k rows as a list: source, id, rank, score."""
    first = top_k(df, k, *order)
    w = Window.orderBy(*order)  # over k rows
    return first.select(F.lit(source).alias("source"), F.col(key).alias("id"), F.row_number().over(w).alias("rank"), F.col("score").cast("double").alias("score"))


def reciprocal(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """id and rrf, the sum of weight / (k + rank) over the lists; hits, and sources in order of name; where lists have scores, a map of them by source too. Lists without a weight count 1."""
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("source")), F.lit(1.0))
    part = weight / (k + F.col("rank"))
    # a source lists an id once; of repeats the best score stays
    scores = lambda x: F.map_from_entries(F.transform(F.col("sources"), lambda s: F.struct(s, F.array_max(F.transform(F.filter(x, lambda e: e["source"] == s), lambda e: e["score"])))))
    kept = ["_scores"] if "score" in lists.columns else []
    held = [F.collect_list(F.struct("source", F.col("score").cast("double").alias("score"))).alias("_scores")] if kept else []
    out = lists.groupBy(*by, "id").agg(F.sum(part).alias("rrf"), F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("source")).alias("sources"), *held)
    return out.withColumn("scores", scores("_scores")).drop("_scores") if kept else out


def by_rank(lists: DataFrame, weights: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """id and fused, the sum of weight * (1 - (rank - 1) / n) over the lists, n the list's length: the last row still counts 1 / n."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "source"))
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("source"))
    return lists.withColumn("_p", weight * (1 - (F.col("rank") - 1) / n)).groupBy(*by, "id").agg(F.sum("_p").alias("fused"))


def linear(a: DataFrame, b: DataFrame, wa: float, wb: float) -> DataFrame:
    """id, score_a, score_b, fused of two scored lists (id, score); a score that is missing counts 0."""
    left, right = a.select("id", F.col("score").alias("score_a")), b.select("id", F.col("score").alias("score_b"))
    both = left.join(right, "id", "full").na.fill(0.0, ["score_a", "score_b"])
    return both.withColumn("fused", wa * F.col("score_a") + wb * F.col("score_b"))


def merge(lists: DataFrame, k: int, text: str = "text", chars: int = 200, order: tuple[str, ...] = ("priority", "rank", "id")) -> DataFrame:
    """The first k rows in an order, of rows that agree in their first characters only the first."""
    first = top_k_per(lists.withColumn("_head", F.left(text, F.lit(chars))), "_head", 1, *order, rank="_n").drop("_head", "_n")
    return top_k(first, k, *order)


def keyword_boost(results: DataFrame, query: str, boost: float, k: int, text: str = "text") -> DataFrame:
    """Reranks by 1 + overlap * boost / words of the query, then by rank."""
    asked = F.array_distinct(X.tokens(F.lit(query)))
    shared = F.size(F.array_intersect(asked, X.tokens(text)))
    return top_k(results.withColumn("boosted", 1 + shared * boost / F.greatest(F.size(asked), F.lit(1))), k, F.desc("boosted"), "rank")


def rerank(results: DataFrame, model: Callable[[], Callable[[list[str], list[str]], list[float]]], k: int, query: str = "query", text: str = "text", key: str = "id", factor: int = 2, most: int = 100) -> DataFrame:
    """The first min(factor * k, most) results by rank, rescored by a model and cut to k, best first.

    model() is called once in each task and gives a function from queries and texts to scores. If it
    raises anywhere, all results stay in their order with rerank_score null, and degraded is true.
    """
    wide = results.orderBy("rank", key).limit(min(factor * k, most))
    ways = {
        "model": lambda: wide.withColumn("rerank_score", models.scores(model, F.col(query), F.col(text))),
        "order": lambda: wide.withColumn("rerank_score", F.lit(None).cast("double")),
    }
    return top_k(models.first_whole(ways), k, F.desc_nulls_last("rerank_score"), "rank", key)
