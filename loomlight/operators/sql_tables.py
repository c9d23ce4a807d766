"""Searches as table functions of SQL. Catalyst expands their bodies, so nothing runs in Python and plans stay whole.

register_bm25 gives kg_bm25(asked, k), register_ivf gives kg_ivf(wanted, k, probes), register_edges gives
kg_edges(node, pred) and kg_neighbours(node). They hold for the session, over the tables given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.functions import sql
from loomlight.operators import lexical, postings


def _create(spark: SparkSession, name: str, takes: str, gives: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE({gives}) RETURN {body}")


def register_bm25(spark: SparkSession, path: str, name: str = "kg_bm25") -> str:
    """kg_bm25(asked STRING, k INT): doc_id, score, rank of the k best documents of the index in a folder, for a text. Only the buckets of its terms are joined."""
    sql.register(spark)
    n, mean_length = postings.statistics(spark, path)
    view = f"loomlight_{name}_postings"
    rows, buckets = postings.everything(spark, path)
    rows.createOrReplaceTempView(view)
    part = f"q.times * i.idf * p.tf * {lexical.K1 + 1}D / (p.tf + {lexical.K1}D * ({1 - lexical.B}D + {lexical.B}D * p.length / {mean_length!r}D))"
    tokens = sql.FUNCTIONS["text_tokens"][2].replace("coalesce(t,", f"coalesce({name}.asked,")  # a function of SQL can't stand in a generator
    body = f"""
        WITH q AS (SELECT term, count(*) AS times, CAST(pmod(xxhash64(term), {buckets}) AS INT) AS bucket FROM (SELECT explode({tokens}) AS term) GROUP BY term),
        p AS (SELECT p.term, p.key, p.tf, p.length FROM {view} p JOIN q ON p.bucket = q.bucket AND p.term = q.term),
        i AS (SELECT term, ln(({n} - count(*) + 0.5D) / (count(*) + 0.5D) + 1) AS idf FROM p GROUP BY term),
        s AS (SELECT p.key, sum({part}) AS score FROM p JOIN q ON p.term = q.term JOIN i ON p.term = i.term GROUP BY p.key),
        r AS (SELECT key AS doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS rank FROM s)
        SELECT doc_id, score, rank FROM r WHERE rank <= {name}.k"""
    _create(spark, name, "asked STRING, k INT", "doc_id BIGINT, score DOUBLE, rank INT", body)
    return name


def register_ivf(spark: SparkSession, listed: DataFrame, centroids: DataFrame, name: str = "kg_ivf", cell: str = "cell", key: str = "vec_id", vector: str = "embedding") -> str:
    """kg_ivf(wanted ARRAY<DOUBLE>, k INT, probes INT): id, score, rank of the k nearest rows by cosine in the nearest cells. listed has a cell for each row, centroids one row for each cell."""
    sql.register(spark)
    as_double = lambda c: F.col(c).cast("array<double>")
    rows, cells = f"loomlight_{name}_rows", f"loomlight_{name}_cells"
    listed.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(cell).alias("cell"), as_double(vector).alias("x")).createOrReplaceTempView(rows)
    centroids.select(F.col("cell"), as_double("centroid").alias("c")).createOrReplaceTempView(cells)
    body = f"""
        WITH near AS (SELECT cell FROM (SELECT cell, row_number() OVER (ORDER BY vec_cosine(c, {name}.wanted) DESC, cell) AS n FROM {cells}) WHERE n <= {name}.probes),
        s AS (SELECT r.id, vec_cosine(r.x, {name}.wanted) AS score FROM {rows} r JOIN near ON r.cell = near.cell),
        r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s)
        SELECT id, score, rank FROM r WHERE rank <= {name}.k"""
    _create(spark, name, "wanted ARRAY<DOUBLE>, k INT, probes INT", "id BIGINT, score DOUBLE, rank INT", body)
    return name


def register_edges(spark: SparkSession, edges: DataFrame, name: str = "kg_edges", near: str = "kg_neighbours") -> list[str]:
    """kg_edges(node STRING, pred STRING): src, pred, dst, w of the edges out of a node (of any if null) with a predicate (with any if null). kg_neighbours(node STRING): node, outgoing of those one edge away, either way."""
    view = f"loomlight_{name}"
    edges.select("src", "pred", "dst", F.col("w").cast("double")).createOrReplaceTempView(view)
    _create(spark, name, "node STRING, wanted STRING", "src STRING, pred STRING, dst STRING, w DOUBLE", f"SELECT src, pred, dst, w FROM {view} WHERE ({name}.node IS NULL OR src = {name}.node) AND ({name}.wanted IS NULL OR pred = {name}.wanted)")
    _create(spark, near, "node STRING", "node STRING, outgoing BOOLEAN", f"SELECT dst, true FROM {view} WHERE src = {near}.node UNION SELECT src, false FROM {view} WHERE dst = {near}.node")
    return [name, near]
