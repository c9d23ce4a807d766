"""Queries over embeddings: exact and approximate neighbours, late interaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlight.functions import vectors as V
from loomlight.operators import forest as forests
from loomlight.operators import late, quantised, search
from loomlight.operators.common import rounded, top_k_per
from loomlight.sources.tables import table


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def _query(spark, sf, ids=(0,)):
    return search.query_of(_vectors(spark, sf), F.col("vec_id").isin(*ids))


def _top(metric):
    def query(spark, sf):
        found = search.nearest(_vectors(spark, sf), _query(spark, sf), 10, metric)
        return found.select("vec_id", "label", rounded("score").alias("score"), rounded("distance").alias("distance"), "rank")

    return query


def mahalanobis(spark, sf):
    """With the inverse of a diagonal covariance: the variance of each component."""
    rows = _vectors(spark, sf)
    spread = rows.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.var_samp(F.col("x").cast("double")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    n = F.size("c")
    row = lambda e, i: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(i == j, 1 / e["v"]).otherwise(F.lit(0.0)))
    inverse = spread.agg(ordered.alias("c")).select(F.transform("c", row).alias("inverse"))
    both = rows.crossJoin(F.broadcast(inverse)).crossJoin(F.broadcast(_query(spark, sf)))  # one row each
    d = V.mahalanobis("embedding", "query", F.col("inverse"))
    return both.select("vec_id", rounded(d).alias("distance")).orderBy("distance", "vec_id").limit(10)


def multi_query(spark, sf):
    return search.nearest(_vectors(spark, sf), _query(spark, sf, range(5)), 5).select("query_id", "vec_id", "rank", rounded("score").alias("score"))


def batched(spark, sf):
    rows = _vectors(spark, sf)
    found = search.nearest_batched(rows, search.query_of(rows, F.col("vec_id") % 10 == 0), 5)
    return found.select("query_id", "vec_id", "rank", rounded("score").alias("score"))


def label_filter(spark, sf):
    return search.nearest(_vectors(spark, sf), _query(spark, sf), 5, where=F.col("label") == 3).select("vec_id", "label", rounded("score").alias("score"), "rank")


def seed_expand(spark, sf):
    return search.nearest(_vectors(spark, sf), _query(spark, sf, (7,)), 8).select("vec_id", rounded("score").alias("score"), "rank")


def post_filter(spark, sf):
    found = search.nearest_then_filter(_vectors(spark, sf), _query(spark, sf), 10, F.col("label") == 3)
    return found.select("vec_id", "label", rounded("score").alias("score"))


def threshold(spark, sf):
    found = search.nearest(_vectors(spark, sf), _query(spark, sf), 20)
    return found.where(F.col("score") >= 0.2).select("vec_id", rounded("score").alias("score"))


def l2_normalise(spark, sf):
    unit = V.normalise("embedding")
    return _vectors(spark, sf).select("vec_id", rounded(V.norm("embedding")).alias("norm_before"), rounded(V.norm(unit)).alias("norm_after"), rounded(F.get(unit, F.lit(0))).alias("first"))


def index_info(spark, sf):
    return search.index_info(_vectors(spark, sf), cell="label")


def ivf_fixed(spark, sf):
    rows = _vectors(spark, sf)
    found = search.ivf_search(rows, search.mean_centroids(rows, "label"), search.query_of(rows, F.col("vec_id") % 100 == 0), 5, 3, cell="label")
    return found.select("query_id", "vec_id", "rank", rounded("score").alias("score"))


def ivf_kmeans(spark, sf):
    rows = _vectors(spark, sf)
    listed, centroids = search.kmeans_cells(rows, 16)
    return search.ivf_search(listed, centroids, search.query_of(rows, F.col("vec_id") % 50 == 0), 5, 13).select("query_id", "vec_id", "rank", rounded("score").alias("score"))


def ivf_pq(spark, sf):
    """Estimates from codes in all cells, exact scores for 60 rows of each query."""
    rows = _vectors(spark, sf)
    encoded, book = quantised.index(rows)
    found = quantised.search(rows, encoded, book, search.query_of(rows, F.col("vec_id") % 50 == 0), 5, shortlist=60, probes=16)
    return found.select("query_id", "vec_id", "rank", rounded("score").alias("score"))


def lsh(spark, sf):
    rows = _vectors(spark, sf)
    return search.lsh_search(rows, search.query_of(rows, F.col("vec_id") % 100 == 0), 5).select("query_id", "vec_id", "rank", rounded("score").alias("score"))


def forest(spark, sf):
    rows = _vectors(spark, sf)
    nodes, leaves = forests.build(rows, trees=8)
    found = forests.search(rows, nodes, leaves, search.query_of(rows, F.col("vec_id") % 50 == 0), 5, probes=16)
    return found.select("query_id", "vec_id", "rank", rounded("score").alias("score"))


def ivf_recall(spark, sf):
    rows = _vectors(spark, sf)
    asked = search.query_of(rows, F.col("vec_id") % 100 == 0)
    found = search.best_in_cells(rows.withColumnRenamed("label", "cell"), search.probed_cells(search.mean_centroids(rows, "label"), asked, 3), 5)
    exact = search.best_in_cells(rows.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0)), 5)
    return search.recall(exact, found).select("query_id", rounded("recall").alias("recall"))


def _tokens(spark, sf):
    return _vectors(spark, sf).select(F.col("label").alias("doc"), F.col("vec_id").alias("tok"), F.col("embedding").alias("vec"))


def _query_tokens(spark, sf):
    return _vectors(spark, sf).where("vec_id in (0, 1, 2, 3)").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qvec"))


def _centroids(spark, sf):
    return search.mean_centroids(_vectors(spark, sf), "label")


def _docs(df):
    return df.select("doc", rounded("score").alias("score"))


def maxsim_exact(spark, sf):
    return _docs(late.maxsim(_tokens(spark, sf), _query_tokens(spark, sf), 5))


def maxsim_pertoken(spark, sf):
    return _docs(late.maxsim_of_nearest(_tokens(spark, sf), _query_tokens(spark, sf), 5, 50))


def _plaid(per_token):
    def query(spark, sf):
        tokens, cells = _tokens(spark, sf), _centroids(spark, sf)
        return _docs(late.plaid(tokens, late.assign(tokens, cells), cells, _query_tokens(spark, sf), 5, 1, per_token))

    return query


def plaid_k_rule(spark, sf):
    return _vectors(spark, sf).select("vec_id", late.recommended_cells((F.col("vec_id") + 1) * 400).alias("cells"))


def plaid_assign(spark, sf):
    return late.assign(_tokens(spark, sf), _centroids(spark, sf)).select("doc", "tok", "cell")


QUERIES = {
    **{f"vec_topk_{m}": _top(m) for m in V.METRICS},
    "vec_mahalanobis": mahalanobis,
    "vec_multi_query": multi_query,
    "vec_batched": batched,
    "vec_label_filter": label_filter,
    "vec_seed_expand": seed_expand,
    "vec_post_filter": post_filter,
    "vec_threshold": threshold,
    "vec_l2_normalise": l2_normalise,
    "vec_index_info": index_info,
    "ivf_fixed_centroids": ivf_fixed,
    "ivf_kmeans": ivf_kmeans,
    "ivf_pq": ivf_pq,
    "lsh_topk": lsh,
    "forest_topk": forest,
    "recall_at_k": ivf_recall,
    "maxsim_exact": maxsim_exact,
    "maxsim_pertoken": maxsim_pertoken,
    "plaid_global": _plaid(False),
    "plaid_per_token": _plaid(True),
    "plaid_k_rule": plaid_k_rule,
    "plaid_assign": plaid_assign,
}


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _gaps(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))"


def _cosine(a: str, b: str) -> str:
    return f"CASE WHEN {_dot(a, a)} = 0 OR {_dot(b, b)} = 0 THEN 0.0 ELSE {_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})) END"


_V, _Q = "e.embedding", "q.embedding"
_DISTANCE = {
    "cosine": f"1 - {_cosine(_V, _Q)}",
    "dot": f"-{_dot(_V, _Q)}",
    "l2": f"sqrt(list_sum(list_transform({_gaps(_V, _Q)}, lambda g: g * g)))",
    "l1": f"list_sum({_gaps(_V, _Q)})",
    "chebyshev": f"list_max({_gaps(_V, _Q)})",
}
_SCORE = {m: f"1 / (1 + {_DISTANCE[m]})" for m in ("l2", "l1", "chebyshev")} | {"cosine": _cosine(_V, _Q), "dot": _dot(_V, _Q)}


def _nearest_sql(k: int, ids: str, metric: str = "cosine", where: str = "true") -> str:
    return f"""SELECT q.vec_id AS query_id, e.vec_id, e.label, {_SCORE[metric]} AS score, {_DISTANCE[metric]} AS distance,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SCORE[metric]} DESC, e.vec_id) AS INTEGER) AS rank
FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE {ids}) q WHERE {where} QUALIFY rank <= {k}"""


_MEANS = """SELECT cell, list(m ORDER BY i) AS centroid FROM (
  SELECT label AS cell, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY label, i) GROUP BY cell"""
_IVF = f"""cents AS ({_MEANS}),
probed AS (SELECT q.vec_id AS query_id, q.embedding AS query, c.cell FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q CROSS JOIN cents c
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cosine('q.embedding', 'c.centroid')} DESC, c.cell) <= 3),
found AS (SELECT p.query_id, e.vec_id, {_cosine('e.embedding', 'p.query')} AS score,
  CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY {_cosine('e.embedding', 'p.query')} DESC, e.vec_id) AS INTEGER) AS rank
  FROM embeddings e JOIN probed p ON e.label = p.cell QUALIFY rank <= 5)"""
_TOKENS = f"""dots AS (SELECT t.label AS doc, t.vec_id AS tok, q.vec_id AS q, {_dot('t.embedding', 'q.embedding')} AS dot
  FROM embeddings t CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2, 3)) q)"""


def _maxsim_sql(source: str, where: str = "true") -> str:
    return f"""SELECT doc, round(sum(best), 6) AS score FROM (SELECT doc, q, max(dot) AS best FROM {source} WHERE {where} GROUP BY doc, q)
GROUP BY doc ORDER BY sum(best) DESC, doc LIMIT 5"""


_ASSIGNED = f"""cents AS ({_MEANS}),
assigned AS (SELECT t.label AS doc, t.vec_id AS tok, c.cell FROM embeddings t CROSS JOIN cents c
  QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY {_dot('t.embedding', 'c.centroid')} DESC, c.cell) = 1),
cdots AS (SELECT c.cell, q.vec_id AS q, {_dot('c.centroid', 'q.embedding')} AS dot FROM cents c CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2, 3)) q)"""

ORACLE_SQL = {
    **{f"vec_topk_{m}": f"SELECT vec_id, label, round(score, 6) AS score, round(distance, 6) AS distance, rank FROM ({_nearest_sql(10, 'vec_id = 0', m)})" for m in V.METRICS},
    "vec_mahalanobis": f"""WITH s AS (SELECT list(1 / v ORDER BY i) AS inv FROM (
  SELECT i, var_samp(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY i))
SELECT e.vec_id, round(sqrt(list_sum(list_transform(list_zip({_gaps(_V, _Q)}, s.inv), lambda p: p[1] * p[1] * p[2]))), 6) AS distance
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q, s ORDER BY distance, vec_id LIMIT 10""",
    "vec_multi_query": f"SELECT query_id, vec_id, rank, round(score, 6) AS score FROM ({_nearest_sql(5, 'vec_id < 5')})",
    "vec_batched": f"SELECT query_id, vec_id, rank, round(score, 6) AS score FROM ({_nearest_sql(5, 'vec_id % 10 = 0')})",
    "vec_label_filter": f"SELECT vec_id, label, round(score, 6) AS score, rank FROM ({_nearest_sql(5, 'vec_id = 0', where='e.label = 3')})",
    "vec_seed_expand": f"SELECT vec_id, round(score, 6) AS score, rank FROM ({_nearest_sql(8, 'vec_id = 7')})",
    "vec_post_filter": f"SELECT vec_id, label, round(score, 6) AS score FROM ({_nearest_sql(50, 'vec_id = 0')}) WHERE label = 3 ORDER BY rank LIMIT 10",
    "vec_threshold": f"SELECT vec_id, round(score, 6) AS score FROM ({_nearest_sql(20, 'vec_id = 0')}) WHERE score >= 0.2",
    "vec_l2_normalise": f"""SELECT vec_id, round(sqrt(n2), 6) AS norm_before, CAST(CASE WHEN n2 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS norm_after,
  round(CAST(embedding[1] AS DOUBLE) / CASE WHEN n2 = 0 THEN 1 ELSE sqrt(n2) END, 6) AS first FROM (SELECT *, {_dot('embedding', 'embedding')} AS n2 FROM embeddings)""",
    "vec_index_info": "SELECT count(*) AS rows, count(embedding) AS indexed, max(len(embedding)) AS dim, count(DISTINCT label) AS cells FROM embeddings",
    "ivf_fixed_centroids": f"WITH {_IVF} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM found",
    "recall_at_k": f"""WITH {_IVF}, exact AS ({_nearest_sql(5, 'vec_id % 100 = 0')})
SELECT x.query_id, round(count(f.vec_id) / count(*), 6) AS recall FROM exact x LEFT JOIN found f ON x.query_id = f.query_id AND x.vec_id = f.vec_id GROUP BY x.query_id""",
    "maxsim_exact": f"WITH {_TOKENS} {_maxsim_sql('dots')}",
    "maxsim_pertoken": f"WITH {_TOKENS}, near AS (SELECT * FROM dots QUALIFY row_number() OVER (PARTITION BY q ORDER BY dot DESC, tok) <= 50) {_maxsim_sql('near')}",
    "plaid_global": f"""WITH {_TOKENS}, {_ASSIGNED}, probed AS (SELECT cell FROM cdots GROUP BY cell ORDER BY sum(dot) DESC, cell LIMIT 1)
{_maxsim_sql('dots', 'doc IN (SELECT doc FROM assigned WHERE cell IN (SELECT cell FROM probed))')}""",
    "plaid_per_token": f"""WITH {_TOKENS}, {_ASSIGNED}, probed AS (SELECT cell FROM cdots QUALIFY row_number() OVER (PARTITION BY q ORDER BY dot DESC, cell) <= 1)
{_maxsim_sql('dots', 'doc IN (SELECT doc FROM assigned WHERE cell IN (SELECT cell FROM probed))')}""",
    "plaid_k_rule": """SELECT vec_id, CAST(greatest(1, least(least(greatest(pow(2, round_even(log2(greatest(16, vec_id + 1)), 0)), 16), 4096), (vec_id + 1) * 100)) AS BIGINT) AS cells FROM embeddings""",
    "plaid_assign": f"WITH {_ASSIGNED} SELECT doc, tok, cell FROM assigned",
}
