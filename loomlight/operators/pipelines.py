"""Composite retrieval: each function joins operators into one plan and returns documents with their scores.

docs has doc_id, text and attributes; vectors has doc_id and embedding (and attributes to filter by);
a query is a one-row DataFrame (query_id, query) as search.query_of gives it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.operators import fusion, graph as G, lexical, postings, search, terms
from loomlight.operators.common import cut, rounded, sized, top_k

MODES = ("vector", "text", "hybrid", "rrf", "kg")


def check(query: str, k: int, mode: str | None = None, weights: tuple[float, ...] | None = None) -> None:
    """Raises ValueError for an empty query, k outside 1 to 100, an unknown mode, or weights where no lists are fused."""
    if not query or not query.strip():
        raise ValueError("a query is needed")
    if not 1 <= k <= 100:
        raise ValueError(f"k is {k}; 1 to 100 is allowed")
    if mode is not None and mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {', '.join(MODES)}")
    if weights and mode not in (None, "hybrid", "rrf"):
        raise ValueError("weights go with hybrid and rrf only")


def basic(docs: DataFrame, vectors: DataFrame, query: DataFrame, k: int, where: Column | None = None, least: float | None = None) -> DataFrame:
    """The k nearest documents by cosine among those that pass `where`; below `least` they go. Attributes are fetched for the winners only."""
    found = search.nearest(vectors, query, k, where=where, key="doc_id")
    found = found if least is None else found.where(F.col("score") >= least)
    return docs.join(sized(cut(found.select("doc_id", "score", "rank")), 32), "doc_id")


def reranked(docs: DataFrame, vectors: DataFrame, query: DataFrame, text: str, model: Callable, k: int) -> DataFrame:
    """basic over twice as many, rescored by a model of (query, text) and cut to k."""
    wide = basic(docs, vectors, query, min(2 * k, 100)).withColumn("query", F.lit(text))
    return fusion.rerank(wide, model, k, key="doc_id")


def evaluated(scores: DataFrame) -> DataFrame:
    """One row with the state that scores of results suggest: confident, ambiguous or disoriented."""
    most, mean = F.max("score"), F.avg("score")
    state = F.when(F.count("score") == 0, "disoriented").when((most > 0.8) & (mean > 0.6), "confident").when((most > 0.6) | (mean > 0.4), "ambiguous").otherwise("disoriented")
    return scores.agg(state.alias("state"))


def corrective(docs: DataFrame, vectors: DataFrame, query: DataFrame, k: int, chunks: DataFrame | None = None) -> DataFrame:
    """Retrieval that looks at its own scores: confident results stay; ambiguous ones are joined by the k best chunks (doc_id, embedding, text; sentences' vectors, or the documents' own) without equal beginnings; otherwise the search is widened to 2k and cut to k."""
    wide = cut(basic(docs, vectors, query, 2 * k))
    first = wide.where(F.col("rank") <= k)
    state = cut(evaluated(first))
    names = ["doc_id", "text", "score", "source"]
    as_is = first.crossJoin(F.broadcast(state.where("state = 'confident'"))).select(*names[:3], F.lit("first").alias("source"), "state")  # one row
    pool = first.select(*names[:3], F.lit("first").alias("source"), F.lit(0).alias("priority"), "rank")
    extra = search.nearest(chunks, query, k, key="doc_id") if chunks is not None else wide
    pool = pool.unionByName(extra.select(*names[:3], F.lit("chunk").alias("source"), F.lit(1).alias("priority"), "rank"))
    joined = fusion.merge(pool, 2 * k, chars=100, order=("priority", "rank", "doc_id")).crossJoin(F.broadcast(state.where("state = 'ambiguous'")))
    widened = top_k(wide, k, "rank").crossJoin(F.broadcast(state.where("state = 'disoriented'"))).select(*names[:3], F.lit("wide").alias("source"), "state")
    return as_is.unionByName(joined.select(*names, "state")).unionByName(widened)


def graph(entities: DataFrame, edges: DataFrame, query: str, depth: int, k: int, vectors: DataFrame | None = None, near_query: DataFrame | None = None) -> DataFrame:
    """Documents of the entities (entity, name, doc_id) that a query names or that lie within `depth` steps of those: doc_id, entities; the first k by id.

    With vectors and the query's own (near_query), a query that names no entity falls back to the k
    nearest documents, with entities 0.
    """
    seeds = entities.where(F.contains(F.lower(F.lit(query)), F.lower("name"))).select(F.col("entity").alias("node"))
    if vectors is not None and near_query is not None:
        seeds = cut(seeds)
        if seeds.isEmpty():
            return search.nearest(vectors, near_query, k, key="doc_id").select("doc_id", F.lit(0).cast("long").alias("entities"))
    near = G.neighbourhood(edges, seeds, depth).select("node")
    return G.documents_of(entities, near, k)


def hybrid(docs: DataFrame, vectors: DataFrame, query: DataFrame, wanted: DataFrame, k: int, wide: int = 20, found: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """BM25 and cosine lists of `wide` rows each, and if given one of graph retrieval (doc_id, entities: more first), fused by reciprocal ranks; the k best with their documents. BM25 reads the texts, or the index (see postings) of a folder."""
    texts = _texts(docs, wanted, wide, index).select(F.lit("text").alias("source"), F.col("key").alias("id"), "rank")
    near = search.nearest(vectors, query, wide, key="doc_id").select(F.lit("vector").alias("source"), F.col("doc_id").alias("id"), "rank")
    lists = texts.unionByName(near)
    if found is not None:
        of_graph = fusion.ranked(found.withColumn("score", F.col("entities").cast("double")), "graph", wide, F.desc("entities"), "doc_id", key="doc_id")
        lists = lists.unionByName(of_graph.select("source", "id", "rank"))
    fused = cut(fusion.ranked(fusion.reciprocal(lists).withColumn("score", F.col("rrf")), "rrf", k, F.desc(rounded("score", 9)), "id", key="id"))
    return docs.join(sized(fused.select(F.col("id").alias("doc_id"), F.col("score").alias("rrf"), "rank"), 32), "doc_id")


def _texts(docs: DataFrame, wanted: DataFrame, wide: int, index: str | None) -> DataFrame:
    return postings.search(docs.sparkSession, index, wanted, wide) if index else lexical.search(lexical.bags(docs), wanted, wide)


def multi_query(docs: DataFrame, query: DataFrame, k: int, variants: int = 4, wide: int = 20, index: str | None = None) -> DataFrame:
    """Variants of a query (one row: text), a BM25 list for each, from the texts or an index of a folder, fused by reciprocal ranks: doc_id, rrf, hits."""
    forms = query.select(F.posexplode(X.query_variants("text", variants)).alias("n", "q"))
    found = _texts(docs, lexical.asked(forms, "n", "q"), wide, index)
    fused = fusion.reciprocal(found.select(F.col("query_id").cast("string").alias("source"), F.col("key").alias("id"), "rank"))
    return top_k(fused, k, F.desc(rounded("rrf", 9)), "id").withColumnRenamed("id", "doc_id")


def dispatch(mode: str, backends: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The result of the backend of a mode. An unknown mode, or one without a backend here, raises ValueError; nothing falls back silently."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {', '.join(MODES)}")
    if mode not in backends:
        raise ValueError(f"mode {mode!r} has no backend here")
    return backends[mode]()


def reasoned(entities: DataFrame, edges: DataFrame, expanded: DataFrame, query: str, depth: int, k: int) -> DataFrame:
    """graph for a query and the terms it expands to (term): doc_id, entities. Expansions are few."""
    asked = expanded.select(F.col("term").alias("_asked")).union(expanded.sparkSession.createDataFrame([(query,)], "term string")).distinct()
    seeds = terms.holding(asked, entities.select("entity", "name"), "_asked", "name").select(F.col("entity").alias("node")).distinct()
    return G.documents_of(entities, G.neighbourhood(edges, seeds, depth).select("node"), k)


def insights(concepts: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, id, score: concepts of a query, 1 if it holds the label, 0.5 if only a synonym."""
    from loomlight.operators import ontology

    found = ontology.matched(concepts, queries, key, text).join(concepts.select("id", "label"), "id")
    return found.groupBy(key, "id").agg(F.max(F.when(F.col("term") == F.col("label"), 1.0).otherwise(0.5)).alias("score"))
