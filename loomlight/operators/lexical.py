"""BM25 over an inverted index of DataFrames.

Documents without tokens don't count. k1 and b are the usual 1.5 and 0.75. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.operators.common import cut, sized, stored, top_k_per

K1, B = 1.5, 0.75


def bags(docs: DataFrame, key: str = "doc_id", text: str = "text", first: int | None = None) -> DataFrame:
    """key, tokens, length of the documents that have tokens; of their first characters only, if asked."""
    source = F.substring(text, 1, first) if first else F.col(text)
    rows = docs.select(F.col(key).alias("key"), X.tokens(source).alias("tokens"))
    return rows.select("key", "tokens", F.size("tokens").cast("long").alias("length")).where("length > 0")


def postings(bag: DataFrame) -> DataFrame:
    """term, key, tf: the index. Counting merges in each task before it shuffles, so a frequent term sends no more than its documents."""
    return bag.select("key", F.explode("tokens").alias("term")).groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf"))


def statistics(bag: DataFrame) -> DataFrame:
    """One row: documents, mean length."""
    return bag.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def asked(queries: DataFrame, query_id: str, text: str, first: int | None = None) -> DataFrame:
    """query_id, term, times: a repeated token of a query counts each time."""
    terms = X.tokens(F.col(text))
    terms = F.slice(terms, 1, first) if first else terms
    return queries.select(F.col(query_id).alias("query_id"), F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def search(bag: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The k best documents for each query: query_id, key, score, rank. Scores equal in nine places are ties, as sums differ in their last digits by the order of their parts.

    One pass over the texts counts the wanted tokens and, under no term, the documents and their
    lengths: both come from one aggregation, so a stage that runs again counts nothing twice. Only
    tokens that some query holds leave the scan: wanted terms are few and broadcast behind a check of
    their size. An index that stays is in module postings.
    """
    wanted = cut(wanted)
    terms = wanted.select("term").distinct()
    terms = sized(terms.union(terms.sparkSession.createDataFrame([(None,)], terms.schema)).withColumnRenamed("term", "_t"), 48)
    named = bag.select("key", "length", F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    hits = named.join(terms, F.col("term").eqNullSafe(F.col("_t")), "left_semi").withColumn("key", F.when(F.col("term").isNotNull(), F.col("key")))
    tf = stored(hits.groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"), F.sum("length").alias("total")), "tf")
    corpus = tf.where(F.col("term").isNull()).select("tf", "total").first()
    n, mean_length = (corpus.tf, corpus.total / corpus.tf) if corpus else (0, 1.0)
    return ranked(tf.where(F.col("term").isNotNull()).drop("total"), n, mean_length, wanted, k)


def ranked(tf: DataFrame, n: int, mean_length: float, wanted: DataFrame, k: int) -> DataFrame:
    """The k best documents for each query: from tf (term, key, tf, length) of the wanted terms (query_id, term, times), already cut, and the corpus's number of documents and mean length."""
    weights = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf(F.lit(n), F.col("df")).alias("idf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length)))
    scores = tf.join(sized(weights.join(wanted, "term"), 80), "term").groupBy("query_id", "key").agg(F.sum(part).alias("score"))
    return top_k_per(scores, "query_id", k, F.desc(F.round("score", 9)), "key")


def contains(docs: DataFrame, needle: Column, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first k documents by key that hold a string, each with score 1: what a search falls back to."""
    return docs.where(F.contains(F.lower(text), F.lower(needle))).select(key, F.lit(1.0).alias("score")).orderBy(key).limit(k)
