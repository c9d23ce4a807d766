"""Queries over texts: BM25, fusion of rankings, composite retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.operators import fusion, lexical, pipelines, postings, search, sql_tables
from loomlight.operators.common import cut, rounded, shared_folder, top_k
from loomlight.plans.vector_queries import _IVF
from loomlight.sources.tables import STAR_EDGES_SQL, spread_documents, table


def _docs(spark, sf):
    return spread_documents(spark, sf)


def _asked(spark, sf, items=(0,)):
    return lexical.asked(table(spark, sf, "benchmark").where(F.col("item_id").isin(*items)), "item_id", "text", 8)


_INDEXES: dict[tuple, str] = {}


def _index(spark, sf):
    """The BM25 index of the documents, built once for each application and table (as the files are), in the shared folder."""
    docs = _docs(spark, sf)
    name = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if name not in _INDEXES:
        _INDEXES[name] = postings.build(docs, f"{shared_folder(spark).rstrip('/')}/bm25-{uuid.uuid4().hex}", buckets=16)
    return _INDEXES[name]


def tokenise(spark, sf):
    terms = _docs(spark, sf).select(F.explode(X.tokens("text")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def stats(spark, sf):
    bag = lexical.bags(_docs(spark, sf))
    vocabulary = lexical.postings(bag).agg(F.countDistinct("term").alias("vocabulary"), F.count(F.lit(1)).alias("postings"))
    return lexical.statistics(bag).crossJoin(F.broadcast(vocabulary)).select("n", rounded("mean_length").alias("mean_length"), "vocabulary", "postings")


def bm25_search(spark, sf):
    found = postings.search(spark, _index(spark, sf), _asked(spark, sf, range(3)), 10)
    return found.select("query_id", F.col("key").alias("doc_id"), rounded("score").alias("score"), "rank")


def bm25_truncated(spark, sf):
    """The first 8,000 characters of each text count; from the texts, without an index."""
    found = lexical.search(lexical.bags(_docs(spark, sf), first=8000), _asked(spark, sf, range(3)), 10)
    return found.select("query_id", F.col("key").alias("doc_id"), rounded("score").alias("score"), "rank")


def bm25_upsert(spark, sf):
    """Ten documents take the texts of others and these go: one more segment for each, every idf counted anew."""
    docs = _docs(spark, sf).select("doc_id", "text")
    path = postings.build(docs.where("doc_id > 9"), f"{shared_folder(spark).rstrip('/')}/bm25-{uuid.uuid4().hex}", buckets=16)
    postings.upsert(docs.where("doc_id between 10 and 19").select((F.col("doc_id") - 10).alias("doc_id"), "text"), path)
    found = postings.search(spark, path, _asked(spark, sf), 10)
    return found.select(F.col("key").alias("doc_id"), rounded("score").alias("score"), "rank")


def sql_bm25(spark, sf):
    """The index as a table function: documents for the first eight words of an item."""
    sql_tables.register_bm25(spark, _index(spark, sf))
    words = table(spark, sf, "benchmark").where("item_id = 0").select(F.array_join(F.slice(X.tokens("text"), 1, 8), " ")).first()[0]
    return spark.sql("SELECT doc_id, round(score, 6) AS score, rank FROM kg_bm25(:words, 10)", args={"words": words})


def sql_ivf(spark, sf):
    """The label cells as a table function, for the first vector: 3 of 10 cells."""
    rows = table(spark, sf, "embeddings")
    sql_tables.register_ivf(spark, rows, search.mean_centroids(rows, "label"), cell="label")
    wanted = rows.where("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()[0]
    return spark.sql(f"SELECT id AS vec_id, round(score, 6) AS score, rank FROM kg_ivf(array({', '.join(f'{x!r}D' for x in wanted)}), 5, 3)")


def sql_edges(spark, sf):
    from loomlight.sources.tables import star_edges

    sql_tables.register_edges(spark, star_edges(spark, sf))
    return spark.sql("SELECT e.src, e.pred, e.dst, e.w, n.node AS beside FROM kg_edges(NULL, 'in_region') e, LATERAL kg_neighbours(e.dst) n")


def entity_text(spark, sf):
    """BM25 over names."""
    asked = spark.createDataFrame([(0, "red widget"), (1, "small ring ring")], "item_id long, text string")
    found = lexical.search(lexical.bags(table(spark, sf, "part"), "p_partkey", "p_name"), lexical.asked(asked, "item_id", "text"), 10)
    return found.select("query_id", F.col("key").alias("p_partkey"), rounded("score").alias("score"), "rank")


def text_contains(spark, sf):
    return lexical.contains(_docs(spark, sf), F.lit("There"), 10)


def _text_list(spark, sf, k=20):
    found = postings.search(spark, _index(spark, sf), _asked(spark, sf), k)
    return cut(found.select(F.lit("text").alias("source"), F.col("key").alias("id"), "rank", "score"))


def _vector_list(spark, sf, k=20, ids=(0,)):
    rows = table(spark, sf, "embeddings")
    found = search.nearest(rows, search.query_of(rows, F.col("vec_id").isin(*ids)), k)
    return found.select(F.lit("vector").alias("source"), F.col("vec_id").alias("id"), "rank", "score")


def _lists(spark, sf):
    return _text_list(spark, sf).unionByName(_vector_list(spark, sf))


def rrf_two(spark, sf):
    fused = top_k(fusion.reciprocal(_lists(spark, sf)), 10, F.desc(rounded("rrf", 9)), "id")
    return fused.select("id", rounded("rrf").alias("rrf"), "hits", F.array_join("sources", ",").alias("sources"))


def rrf_many(spark, sf):
    """Lists of three query variants, with the variants that found a row."""
    found = postings.search(spark, _index(spark, sf), _asked(spark, sf, range(3)), 20)
    lists = found.select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("source"), F.col("key").alias("id"), "rank")
    fused = top_k(fusion.reciprocal(lists), 10, F.desc(rounded("rrf", 9)), "id")
    return fused.select("id", rounded("rrf").alias("rrf"), "hits", F.array_join("sources", ",").alias("sources"))


def rrf_weighted3(spark, sf):
    """Vector, text and graph (documents of the source and language of the best text hit, by id) with weights."""
    texts = _text_list(spark, sf)
    top = _docs(spark, sf).join(F.broadcast(texts.where("rank = 1").select(F.col("id").alias("doc_id"))), "doc_id")  # one row
    near = _docs(spark, sf).select("doc_id", "source", "lang").join(F.broadcast(top.select("source", "lang")), ["source", "lang"], "left_semi").orderBy("doc_id").limit(20)
    graph = near.select(F.lit("graph").alias("source"), F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy("doc_id")).alias("rank"), F.lit(1.0).alias("score"))
    lists = texts.unionByName(_vector_list(spark, sf)).unionByName(graph)
    fused = fusion.reciprocal(lists, {"vector": 0.5, "text": 0.3, "graph": 0.2})
    return top_k(fused, 10, F.desc(rounded("rrf", 9)), "id").select("id", rounded("rrf").alias("rrf"), "hits")


def rank_weighted(spark, sf):
    fused = fusion.by_rank(_lists(spark, sf), {"vector": 0.7, "text": 0.3})
    return top_k(fused, 10, F.desc(rounded("fused", 9)), "id").select("id", rounded("fused").alias("fused"))


def fuse_linear(spark, sf):
    texts = _text_list(spark, sf).withColumn("score", F.lit(1.0))
    fused = fusion.linear(_vector_list(spark, sf), texts, 0.7, 0.3)
    return top_k(fused, 10, F.desc(rounded("fused", 9)), "id").select("id", rounded("fused").alias("fused"), "score_b")


def _headed(spark, sf, chars):
    texts, near = _text_list(spark, sf), _vector_list(spark, sf)
    both = texts.withColumn("priority", F.lit(0)).unionByName(near.withColumn("priority", F.lit(1)))
    return both.join(_docs(spark, sf).select(F.col("doc_id").alias("id"), F.left("text", F.lit(chars)).alias("text")), "id")


def _merge(chars, k):
    def query(spark, sf):
        return fusion.merge(_headed(spark, sf, chars), k, chars=chars).select("id", "source", "rank")

    return query


def fusion_to_documents(spark, sf):
    """Fused ids with their texts, a stand-in where a text is missing."""
    fused = top_k(fusion.reciprocal(_lists(spark, sf)), 10, F.desc(rounded("rrf", 9)), "id")
    named = F.coalesce(F.left("text", F.lit(40)), F.concat(F.lit("Entity: "), F.col("id").cast("string")))
    docs = _docs(spark, sf).where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "text")
    return fused.join(docs, "id", "left").select("id", named.alias("content"))


def score_backfill(spark, sf):
    """Documents with the score of their vector, 1 where there is none."""
    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"))
    return docs.join(_vector_list(spark, sf).select("id", "score"), "id", "left").select(F.col("id").alias("doc_id"), rounded(F.coalesce("score", F.lit(1.0))).alias("score"))


def _overlap_model():
    def score(queries, texts):
        return [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split()))) for q, t in zip(queries, texts)]

    return score


def rerank_lexical(spark, sf):
    """A model that counts shared words stands in for a cross-encoder."""
    asked = table(spark, sf, "benchmark").where("item_id = 0").select(F.col("text").alias("query"))
    found = _text_list(spark, sf).join(_docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), "id").crossJoin(F.broadcast(asked))  # one row
    return fusion.rerank(found, _overlap_model, 10).select("id", "rank", rounded("rerank_score").alias("rerank_score"))


def keyword_boost(spark, sf):
    found = _text_list(spark, sf).join(_docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), "id")
    return fusion.keyword_boost(found, "the in of there", 0.5, 10).select("id", "rank", rounded("boosted").alias("boosted"))


def pipe_basic(spark, sf):
    docs, vectors = _docs(spark, sf), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    found = pipelines.basic(docs, vectors, search.query_of(vectors, F.col("doc_id") == 0, "doc_id"), 5, where=F.col("label") < 8, least=0.1)
    return found.select("doc_id", "rank", rounded("score").alias("score"), F.col("source"))


def pipe_rerank(spark, sf):
    docs, vectors = _docs(spark, sf), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    found = pipelines.reranked(docs, vectors, search.query_of(vectors, F.col("doc_id") == 0, "doc_id"), "the in of there", _overlap_model, 5)
    return found.select("doc_id", "rank", rounded("rerank_score").alias("rerank_score"))


def pipe_crag(spark, sf):
    docs, vectors = _docs(spark, sf), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    found = pipelines.corrective(docs, vectors, search.query_of(vectors, F.col("doc_id") == 0, "doc_id"), 5)
    return found.select("doc_id", "state", "source", rounded("score").alias("score"))


def pipe_graphrag(spark, sf):
    from loomlight.sources.tables import star_edges

    entities = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 3).cast("long").alias("doc_id"))
    found = pipelines.graph(entities, star_edges(spark, sf).where("pred = 'in_region'"), "which suppliers are in NATION_7 and NATION_2", 2, 20)
    return found.select("doc_id", "entities")


def pipe_hybrid(spark, sf):
    """BM25 and vector neighbours fused by reciprocal ranks, with the documents' attributes."""
    docs, vectors = _docs(spark, sf), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    found = pipelines.hybrid(docs, vectors, search.query_of(vectors, F.col("doc_id") == 0, "doc_id"), _asked(spark, sf), 10, index=_index(spark, sf))
    return found.select("doc_id", rounded("rrf").alias("rrf"), "rank", "lang", "source", "n_chars")


def pipe_multi_query(spark, sf):
    found = pipelines.multi_query(_docs(spark, sf), table(spark, sf, "benchmark").where("item_id = 1").select("item_id", F.array_join(F.slice(X.tokens("text"), 1, 5), " ").alias("text")), 10, index=_index(spark, sf))
    return found.select("doc_id", rounded("rrf").alias("rrf"), "hits")


QUERIES = {
    "bm25_tokenise": tokenise,
    "bm25_stats": stats,
    "bm25_search": bm25_search,
    "bm25_truncated": bm25_truncated,
    "bm25_upsert": bm25_upsert,
    "sql_bm25": sql_bm25,
    "sql_ivf": sql_ivf,
    "sql_edges": sql_edges,
    "entity_text_search": entity_text,
    "text_contains": text_contains,
    "rrf_two": rrf_two,
    "rrf_many": rrf_many,
    "rrf_weighted3": rrf_weighted3,
    "rank_weighted": rank_weighted,
    "fuse_linear": fuse_linear,
    "merge_dedup": _merge(200, 10),
    "crag_dedup": _merge(100, 20),
    "fusion_to_documents": fusion_to_documents,
    "score_backfill": score_backfill,
    "rerank_lexical": rerank_lexical,
    "keyword_boost": keyword_boost,
    "pipe_basic": pipe_basic,
    "pipe_rerank": pipe_rerank,
    "pipe_crag": pipe_crag,
    "pipe_graphrag": pipe_graphrag,
    "pipe_hybrid": pipe_hybrid,
    "pipe_multi_query": pipe_multi_query,
}

_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
_ONE_QUERY = f"""asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (
  SELECT item_id, unnest({_TOKENS.format('text')}[1:8]) AS term FROM benchmark WHERE item_id IN ({{items}})) GROUP BY item_id, term)"""


def _bm25_sql(k: int, items: str = "0", docs: str = "documents", text: str = "text", key: str = "doc_id", asked: str = "") -> str:
    return f"""{asked or _ONE_QUERY.replace("{items}", items)},
bag AS (SELECT * FROM (SELECT {key} AS doc_id, {_TOKENS.format(text)} AS t FROM {docs}) WHERE len(t) > 0),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM bag),
tf AS (SELECT doc_id, term, len(any_value(t)) AS dl, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM bag) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
idf AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, st GROUP BY term),
bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
  FROM tf JOIN idf USING (term) JOIN asked USING (term), st GROUP BY query_id, doc_id),
bm_top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= {k})"""


_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = f"{_DOT('e.embedding', 'q.embedding')} / (sqrt({_DOT('e.embedding', 'e.embedding')}) * sqrt({_DOT('q.embedding', 'q.embedding')}))"


def _vector_sql(k: int, where: str = "true") -> str:
    return f"""vec AS (SELECT e.vec_id AS doc_id, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE {where}),
vec_top AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM vec QUALIFY rank <= {k})"""


_LISTS = f"""WITH {_bm25_sql(20)}, {_vector_sql(20)},
lists AS (SELECT 'text' AS source, doc_id AS id, rank, score FROM bm_top UNION ALL SELECT 'vector', doc_id, rank, score FROM vec_top)"""
_FUSED = "SELECT id, sum(1.0 / (60 + rank)) AS rrf, count(*) AS hits, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM lists GROUP BY id"


def _merge_sql(chars: int, k: int) -> str:
    return f"""{_LISTS}, headed AS (SELECT l.*, CASE l.source WHEN 'text' THEN 0 ELSE 1 END AS priority, left(d.text, {chars}) AS head FROM lists l JOIN documents d ON d.doc_id = l.id),
first AS (SELECT * FROM headed QUALIFY row_number() OVER (PARTITION BY head ORDER BY priority, rank, id) = 1)
SELECT id, source, rank FROM first ORDER BY priority, rank, id LIMIT {k}"""


_VARIANTS = f"""asked AS (SELECT query_id, term, count(*) AS times FROM (
  SELECT v.n AS query_id, unnest({_TOKENS.format('v.q')}) AS term FROM (
    SELECT unnest([0, 1, 2, 3]) AS n, unnest([base, base || ' overview', base || ' details', base || ' information']) AS q FROM (
      SELECT array_to_string({_TOKENS.format('text')}[1:5], ' ') AS base FROM benchmark WHERE item_id = 1)) v) GROUP BY query_id, term)"""

ORACLE_SQL = {
    "bm25_tokenise": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
    "bm25_stats": f"""WITH bag AS (SELECT * FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents) WHERE len(t) > 0),
p AS (SELECT doc_id, unnest(t) AS term FROM bag)
SELECT count(*) AS n, round(avg(len(t)), 6) AS mean_length, (SELECT count(DISTINCT term) FROM p) AS vocabulary, (SELECT count(*) FROM (SELECT DISTINCT doc_id, term FROM p)) AS postings FROM bag""",
    "rerank_lexical": f"""WITH {_bm25_sql(20)}, w AS (SELECT doc_id AS id, rank, list_distinct(list_filter(str_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM bm_top JOIN documents USING (doc_id)),
q AS (SELECT list_distinct(list_filter(str_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS q FROM benchmark WHERE item_id = 0)
SELECT id, rank, round(len(list_intersect(q, t)) / greatest(1, len(q)), 6) AS rerank_score FROM w, q ORDER BY len(list_intersect(q, t)) DESC, rank, id LIMIT 10""",
    "sql_bm25": f"WITH {_bm25_sql(10)} SELECT doc_id, round(score, 6) AS score, rank FROM bm_top",
    "sql_ivf": f"WITH {_IVF} SELECT vec_id, round(score, 6) AS score, rank FROM found WHERE query_id = 0",
    "sql_edges": f"""WITH edges AS ({STAR_EDGES_SQL}), n AS (SELECT src AS a, dst AS node FROM edges UNION SELECT dst, src FROM edges)
SELECT e.src, e.pred, e.dst, e.w, n.node AS beside FROM edges e JOIN n ON n.a = e.dst WHERE e.pred = 'in_region'""",
    "bm25_search": f"WITH {_bm25_sql(10, '0, 1, 2')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm_top",
    "bm25_truncated": f"WITH {_bm25_sql(10, '0, 1, 2', text='left(text, 8000)')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm_top",
    "bm25_upsert": f"""WITH upserted AS (SELECT doc_id - 10 AS doc_id, text FROM documents WHERE doc_id BETWEEN 10 AND 19 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id > 9),
{_bm25_sql(10, docs='upserted')} SELECT doc_id, round(score, 6) AS score, rank FROM bm_top""",
    "entity_text_search": f"""WITH asked AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'red', 1), (0, 'widget', 1), (1, 'small', 1), (1, 'ring', 2)) AS t(query_id, term, times)),
{_bm25_sql(10, docs='part', text='p_name', key='p_partkey', asked='unused AS (SELECT 1)')} SELECT query_id, doc_id AS p_partkey, round(score, 6) AS score, rank FROM bm_top""",
    "text_contains": "SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'there') ORDER BY doc_id LIMIT 10",
    "rrf_two": f"{_LISTS} SELECT id, round(rrf, 6) AS rrf, hits, sources FROM ({_FUSED}) ORDER BY round(rrf, 9) DESC, id LIMIT 10",
    "rrf_many": f"""WITH {_bm25_sql(20, '0, 1, 2')}, lists AS (SELECT 'q' || query_id AS source, doc_id AS id, rank FROM bm_top)
SELECT id, round(rrf, 6) AS rrf, hits, sources FROM ({_FUSED}) ORDER BY round(rrf, 9) DESC, id LIMIT 10""",
    "rrf_weighted3": f"""{_LISTS}, top AS (SELECT source, lang FROM documents WHERE doc_id = (SELECT id FROM lists WHERE source = 'text' AND rank = 1)),
near AS (SELECT doc_id FROM documents WHERE (source, lang) IN (SELECT (source, lang) FROM top) ORDER BY doc_id LIMIT 20),
all_lists AS (SELECT source, id, rank FROM lists UNION ALL SELECT 'graph', doc_id, row_number() OVER (ORDER BY doc_id) FROM near),
f AS (SELECT id, sum(CASE source WHEN 'vector' THEN 0.5 WHEN 'text' THEN 0.3 ELSE 0.2 END / (60 + rank)) AS rrf, count(*) AS hits FROM all_lists GROUP BY id)
SELECT id, round(rrf, 6) AS rrf, hits FROM f ORDER BY round(rrf, 9) DESC, id LIMIT 10""",
    "rank_weighted": f"""{_LISTS}, f AS (SELECT id, sum(w * (1 - (rank - 1) / n)) AS fused FROM (
  SELECT *, CASE source WHEN 'vector' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS w, count(*) OVER (PARTITION BY source) AS n FROM lists) GROUP BY id)
SELECT id, round(fused, 6) AS fused FROM f ORDER BY round(fused, 9) DESC, id LIMIT 10""",
    "fuse_linear": f"""{_LISTS}, f AS (SELECT coalesce(a.id, b.id) AS id, CAST(CASE WHEN b.id IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS score_b, 0.7 * coalesce(a.score, 0) + 0.3 * CASE WHEN b.id IS NULL THEN 0 ELSE 1 END AS fused
  FROM (SELECT * FROM lists WHERE source = 'vector') a FULL JOIN (SELECT * FROM lists WHERE source = 'text') b ON a.id = b.id)
SELECT id, round(fused, 6) AS fused, score_b FROM f ORDER BY round(fused, 9) DESC, id LIMIT 10""",
    "merge_dedup": _merge_sql(200, 10),
    "crag_dedup": _merge_sql(100, 20),
    "fusion_to_documents": f"""{_LISTS}, top AS (SELECT id FROM ({_FUSED}) ORDER BY round(rrf, 9) DESC, id LIMIT 10)
SELECT id, coalesce(left(d.text, 40), 'Entity: ' || id) AS content FROM top LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = top.id""",
    "score_backfill": f"WITH {_vector_sql(20)} SELECT d.doc_id, round(coalesce(v.score, 1.0), 6) AS score FROM documents d LEFT JOIN vec_top v USING (doc_id)",
    "keyword_boost": f"""{_LISTS}, found AS (SELECT l.id, l.rank, 1 + len(list_intersect(['the', 'in', 'of', 'there'], {_TOKENS.format('d.text')})) * 0.5 / 4 AS boosted FROM lists l JOIN documents d ON d.doc_id = l.id WHERE l.source = 'text')
SELECT id, rank, round(boosted, 6) AS boosted FROM found ORDER BY found.boosted DESC, rank LIMIT 10""",
    "pipe_basic": f"""WITH {_vector_sql(5, 'e.label < 8')} SELECT v.doc_id, v.rank, round(v.score, 6) AS score, d.source FROM vec_top v JOIN documents d USING (doc_id) WHERE v.score >= 0.1""",
    "pipe_graphrag": """WITH RECURSIVE und AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
near AS (SELECT 'n' || n_nationkey AS node, 0 AS hop FROM nation WHERE contains('which suppliers are in nation_7 and nation_2', lower(n_name))
  UNION SELECT und.b, near.hop + 1 FROM near JOIN und ON und.a = near.node WHERE near.hop < 2)
SELECT CAST(n_nationkey * 3 AS BIGINT) AS doc_id, CAST(1 AS BIGINT) AS entities FROM nation WHERE 'n' || n_nationkey IN (SELECT node FROM near) ORDER BY doc_id LIMIT 20""",
    "pipe_hybrid": f"""{_LISTS}, top AS (SELECT id, rrf, CAST(row_number() OVER (ORDER BY round(rrf, 9) DESC, id) AS INTEGER) AS rank FROM ({_FUSED}) QUALIFY rank <= 10)
SELECT d.doc_id, round(rrf, 6) AS rrf, rank, lang, source, n_chars FROM top JOIN documents d ON d.doc_id = top.id""",
    "pipe_multi_query": f"""WITH {_bm25_sql(20, asked=_VARIANTS)}, lists AS (SELECT query_id AS source, doc_id AS id, rank FROM bm_top)
SELECT id AS doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf, count(*) AS hits FROM lists GROUP BY id ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, id LIMIT 10""",
}
