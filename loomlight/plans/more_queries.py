"""Further queries: filters, searches from text, functions in SQL, rank tests, changes of a graph, reasoning."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.functions import sql
from loomlight.functions import text as X
from loomlight.functions import vectors as V
from loomlight.operators import evaluation, graph, late, pipelines, search
from loomlight.operators.common import rounded
from loomlight.plans.text_queries import _concepts, _is_a
from loomlight.plans.vector_queries import _query_tokens, _tokens
from loomlight.sources.tables import STAR_EDGES_SQL, events, star_edges, table


def name_match(spark, sf):
    """Two keywords, and a type that binds both."""
    low = F.lower("p_name")
    return table(spark, sf, "part").where((F.contains(low, F.lit("ring")) | F.contains(low, F.lit("bolt"))) & F.col("p_type").isin("ECONOMY", "SMALL")).select("p_partkey", "p_name", "p_type")


def time_range_status(spark, sf):
    e = events(spark, sf).where(F.col("ts").between("2024-01-05 00:00:00", "2024-01-06 12:00:00") & (F.col("event_type") == "error"))
    return e.select("event_id", "user_id")


def entity_filter(spark, sf):
    p = table(spark, sf, "part").where(F.upper("p_type").isin("ECONOMY", "LARGE") & (F.col("p_size") >= 40))
    return p.select("p_partkey", "p_type", "p_size")


def dot_with_fallback(spark, sf):
    """No vectors are left, so the most recent rows come back with score 0.5."""
    v = table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") < 0, F.col("embedding")))
    q = search.query_of(table(spark, sf, "embeddings"), F.col("vec_id") == 0)
    return search.with_fallback(v, q, 5, F.col("vec_id"), where=F.col("label") == 2).select("vec_id", "label", "score")


def search_by_text(spark, sf):
    q = table(spark, sf, "benchmark")
    found = search.by_text(table(spark, sf, "embeddings"), q, 4, lambda t: X.hash_embedding(t, 64))
    return found.select("query_id", "vec_id", "rank", rounded("score").alias("score"))


def maxsim_forest(spark, sf):
    tokens = _tokens(spark, sf)
    corpus = tokens.select(F.col("tok").alias("vec_id"), F.col("vec").alias("embedding"))
    asked = _query_tokens(spark, sf).select(F.col("q").alias("query_id"), F.col("qvec").alias("query"))
    planes = search.projection_planes(64, 3, 8)
    hits = search.forest_search(corpus, search.projection_leaves(corpus, planes), asked, planes, 50)
    return late.maxsim_of_hits(tokens, hits.select(F.col("query_id").alias("q"), F.col("vec_id").alias("tok"), F.col("score").alias("dot")), 5).select("doc", rounded("score").alias("score"))


def colbert_two_step(spark, sf):
    return late.two_step(late.normalised(_tokens(spark, sf)), _query_tokens(spark, sf), 5).select("doc", rounded("score").alias("score"))


def sql_functions(spark, sf):
    """The library's functions used from SQL."""
    sql.register(spark)
    table(spark, sf, "embeddings").createOrReplaceTempView("loomlight_vectors")
    return spark.sql("""
        WITH v AS (SELECT vec_id, cast(embedding AS ARRAY<DOUBLE>) AS x FROM loomlight_vectors)
        SELECT a.vec_id, round(vec_dot(a.x, b.x), 6) AS dot, round(vec_cosine(a.x, b.x), 6) AS cosine, round(vec_l2(a.x, b.x), 6) AS l2, round(vec_norm(a.x), 6) AS norm,
               round(place_disc(a.x, 0.5), 6) AS middle, size(text_tokens('A b, É9')) AS tokens
        FROM v a CROSS JOIN (SELECT x FROM v WHERE vec_id = 1) b""")


def kruskal_h(spark, sf):
    return evaluation.kruskal(events(spark, sf), "event_type", "value", with_p=False).select(rounded("h", 4).alias("h"), "df")


def wilcoxon_w(spark, sf):
    return evaluation.wilcoxon(table(spark, sf, "lineitem"), "l_discount", "l_tax", with_p=False)


def friedman_chi(spark, sf):
    e = events(spark, sf).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("value"))
    whole = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n = 5")
    return evaluation.friedman(e.join(whole, "user_id", "left_semi"), "user_id", "event_type", "value", with_p=False).select(rounded("chi").alias("chi"), "df", "blocks")


def p_values(spark, sf):
    """A row for each test of the events' values: its statistic and p."""
    e, items = events(spark, sf), table(spark, sf, "lineitem")
    found = [
        evaluation.compare_two(e, "event_type", "value", "view", "purchase").select(F.lit("t").alias("test"), F.col("t").alias("statistic"), "p"),
        evaluation.paired_t(items, "l_discount", "l_tax").select(F.lit("paired t"), "t", "p"),
        evaluation.mann_whitney(e, "event_type", "value", "view", "click").select(F.lit("mann-whitney"), "u", "p"),
        evaluation.wilcoxon(items, "l_discount", "l_tax").select(F.lit("wilcoxon"), "w", "p"),
        evaluation.anova(e, "event_type", "value").select(F.lit("anova"), "f", "p"),
        evaluation.kruskal(e, "event_type", "value").select(F.lit("kruskal-wallis"), "h", "p"),
        evaluation.levene(e, "event_type", "value").select(F.lit("levene"), "w", "p"),
    ]
    return functools.reduce(DataFrame.union, found)


def test_choice(spark, sf):
    return evaluation.chosen_test(events(spark, sf), "event_type", "value")


def kg_adjacency_seed(spark, sf):
    return graph.adjacency_from(star_edges(spark, sf), spark.createDataFrame([("c1",), ("s3",)], "node string"), 2)


def kg_edge_changes(spark, sf):
    e = star_edges(spark, sf)
    new = spark.createDataFrame([("c1", "likes", "c2", 2.0), ("n0", "in_region", "r0", 9.0)], "src string, pred string, dst string, w double")
    return graph.without_edges(graph.with_edges(e, new), e.where("src like 'c%' and pred = 'in_nation'"))


def pipe_reasoned(spark, sf):
    n = table(spark, sf, "nation")
    entities = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("doc_id"))
    edges = star_edges(spark, sf).where("pred = 'in_region'")
    wider = spark.createDataFrame([("about NATION_5",)], "term string")
    return pipelines.reasoned(entities, edges, wider, "what of nation_11", 1, 50)


def query_insights(spark, sf):
    q = spark.createDataFrame([(0, "trade of NATION_3 and land 21"), (1, "a continent")], "item_id long, text string")
    return pipelines.insights(_concepts(spark, sf), q)


def mode_dispatch(spark, sf):
    """One retrieval behind a mode: the nearest vectors; of the other modes' backends none is run."""
    v = table(spark, sf, "embeddings")
    near = lambda: search.nearest(v, search.query_of(v, F.col("vec_id") == 0), 3).select("vec_id", "rank")
    return pipelines.dispatch("vector", {"vector": near, "kg": lambda: star_edges(spark, sf)})


def answer_similarity(spark, sf):
    """Vectors of answers against those of their references: here each vector against the next."""
    v = table(spark, sf, "embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("reference"))
    return v.join(other, "vec_id").select("vec_id", rounded(V.cosine("embedding", "reference")).alias("similarity"))


def onto_common(spark, sf):
    from loomlight.operators import ontology

    pairs = spark.createDataFrame([("n22", "n2"), ("n1", "n6"), ("r1", "world")], "a string, b string")
    return ontology.common_ancestors(ontology.ancestors(_is_a(spark, sf)), pairs)


QUERIES = {
    f.__name__: f
    for f in (
        name_match, time_range_status, entity_filter, dot_with_fallback, search_by_text, maxsim_forest, colbert_two_step, sql_functions, kruskal_h, wilcoxon_w, friedman_chi, p_values, test_choice, kg_adjacency_seed, kg_edge_changes,
        pipe_reasoned, query_insights, mode_dispatch, answer_similarity, onto_common,
    )
}

_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = lambda a, b: f"{_DOT(a, b)} / (sqrt({_DOT(a, a)}) * sqrt({_DOT(b, b)}))"
_L2 = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"

ORACLE_SQL = {
    "name_match": "SELECT p_partkey, p_name, p_type FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')) AND p_type IN ('ECONOMY', 'SMALL')",
    "time_range_status": "SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00' AND event_type = 'error'",
    "entity_filter": "SELECT p_partkey, p_type, p_size FROM part WHERE upper(p_type) IN ('ECONOMY', 'LARGE') AND p_size >= 40",
    "dot_with_fallback": "SELECT vec_id, label, CAST(0.5 AS DOUBLE) AS score FROM embeddings WHERE label = 2 ORDER BY vec_id DESC LIMIT 5",
    "search_by_text": f"""WITH h AS (SELECT item_id, md5(text) AS h FROM benchmark), q AS (SELECT item_id AS query_id, list_transform(range(0, 64), lambda i: (CAST('0x' || substr(h, CAST((i % 16) * 2 + 1 AS BIGINT), 2) AS INTEGER) - 127.5) / 127.5) AS v FROM h)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_COS('e.embedding', 'q.v')} DESC, vec_id) AS INTEGER) AS rank, round({_COS('e.embedding', 'q.v')}, 6) AS score FROM embeddings e, q QUALIFY rank <= 4""",
    "sql_functions": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT a.vec_id, round({_DOT('a.x', 'b.x')}, 6) AS dot, round({_COS('a.x', 'b.x')}, 6) AS cosine, round({_L2}, 6) AS l2, round(sqrt({_DOT('a.x', 'a.x')}), 6) AS norm, round(list_sort(a.x)[33], 6) AS middle, 3 AS tokens FROM v a, (SELECT x FROM v WHERE vec_id = 1) b""",
    "kruskal_h": """WITH c AS (SELECT event_type AS g, value AS v, count(*) AS c FROM events GROUP BY 1, 2), t AS (SELECT v, sum(c) AS t FROM c GROUP BY v), r AS (SELECT v, t, sum(t) OVER (ORDER BY v) - (t - 1) / 2 AS rank FROM t),
s AS (SELECT g, sum(c * rank) AS r, sum(c) AS n FROM c JOIN r USING (v) GROUP BY g), k AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS s, count(*) AS k FROM s), e AS (SELECT sum(pow(CAST(t AS DOUBLE), 3) - t) AS e FROM t)
SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - e / (n * n * n - n)), 4) AS h, k - 1 AS df FROM k, e""",
    "wilcoxon_w": """WITH c AS (SELECT abs(d) AS v, count(*) AS t, count(*) FILTER (d > 0) AS up FROM (SELECT round(l_discount - l_tax, 9) AS d FROM lineitem) WHERE d <> 0 GROUP BY 1), r AS (SELECT *, sum(t) OVER (ORDER BY v) - (t - 1) / 2 AS rank FROM c)
SELECT least(sum(rank * up), sum(rank * (t - up))) AS w, CAST(sum(t) AS BIGINT) AS n FROM r""",
    "friedman_chi": """WITH e AS (SELECT user_id, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), w AS (SELECT * FROM e WHERE user_id IN (SELECT user_id FROM e GROUP BY 1 HAVING count(*) = 5)),
r AS (SELECT event_type, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2 AS r FROM w), s AS (SELECT event_type, sum(r) AS r, count(*) AS n FROM r GROUP BY 1)
SELECT round(12 / (max(n) * count(*) * (count(*) + 1)) * sum(r * r) - 3 * max(n) * (count(*) + 1), 6) AS chi, count(*) - 1 AS df, max(n) AS blocks FROM s""",
    "kg_adjacency_seed": f"""WITH RECURSIVE edges AS ({STAR_EDGES_SQL}), reach AS (SELECT unnest(['c1', 's3']) AS node, 0 AS hop UNION SELECT e.dst, hop + 1 FROM reach JOIN edges e ON e.src = node WHERE hop < 2)
SELECT src, pred, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM edges WHERE src IN (SELECT node FROM reach) GROUP BY src, pred""",
    "kg_edge_changes": f"""WITH edges AS ({STAR_EDGES_SQL}) SELECT src, pred, dst, w FROM edges WHERE NOT (src LIKE 'c%' AND pred = 'in_nation') AND NOT (src = 'n0' AND pred = 'in_region' AND dst = 'r0')
UNION ALL SELECT 'c1', 'likes', 'c2', 2.0 UNION ALL SELECT 'n0', 'in_region', 'r0', 9.0""",
    "pipe_reasoned": """WITH seeds AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE contains('about nation_5', lower(n_name)) OR contains('what of nation_11', lower(n_name)))
SELECT CAST(k AS BIGINT) AS doc_id, CAST(1 AS BIGINT) AS entities FROM seeds""",
    "query_insights": """WITH c AS (SELECT 'n' || n_nationkey AS id, n_name AS label, ['land ' || n_nationkey, 'state'] AS synonyms FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, ['continent'] FROM region),
q AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'trade of nation_3 and land 21'), (1, 'a continent')) AS t(item_id, q))
SELECT item_id, id, CAST(CASE WHEN contains(q, lower(label)) THEN 1 ELSE 0.5 END AS DOUBLE) AS score FROM c, q WHERE contains(q, lower(label)) OR len(list_filter(synonyms, lambda s: contains(q, lower(s)))) > 0""",
    "mode_dispatch": f"SELECT e.vec_id, CAST(row_number() OVER (ORDER BY {_COS('e.embedding', 'q.v')} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q QUALIFY rank <= 3",
    "answer_similarity": f"SELECT a.vec_id, round({_COS('a.embedding', 'b.embedding')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "onto_common": """WITH RECURSIVE isa AS (SELECT 'n' || n_nationkey AS c, 'r' || n_regionkey AS p FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey - 20) FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
up AS (SELECT c AS node, p AS ancestor FROM isa UNION SELECT up.node, isa.p FROM up JOIN isa ON isa.c = up.ancestor)
SELECT x.a, x.b, u.ancestor FROM (VALUES ('n22', 'n2'), ('n1', 'n6'), ('r1', 'world')) AS x(a, b) JOIN up u ON u.node = x.a JOIN up v ON v.node = x.b AND v.ancestor = u.ancestor""",
}
