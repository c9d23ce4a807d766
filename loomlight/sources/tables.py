"""The tables, and the graph that they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, dealt to all cores where the files are too few or too large to split: texts take long enough for the shuffle to pay."""
    rows, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as a TIMESTAMP (files hold it without a time zone; the session's is UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def star_edges(spark: SparkSession, sf_dir: str, parts: bool = False) -> DataFrame:
    """src, pred, dst, w: customers and suppliers in nations, nations in regions; with parts, also parts and their suppliers. Ids carry a letter for their kind."""
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edge = lambda df, a, p, b, w: df.select(a.alias("src"), F.lit(p).alias("pred"), b.alias("dst"), w.cast("double").alias("w"))
    t = lambda name: table(spark, sf_dir, name)
    out = edge(t("customer"), node("c", "c_custkey"), "in_nation", node("n", "c_nationkey"), 1 + F.pmod("c_custkey", F.lit(7)))
    out = out.union(edge(t("supplier"), node("s", "s_suppkey"), "in_nation", node("n", "s_nationkey"), 1 + F.pmod("s_suppkey", F.lit(7))))
    out = out.union(edge(t("nation"), node("n", "n_nationkey"), "in_region", node("r", "n_regionkey"), 1 + F.pmod("n_nationkey", F.lit(3))))
    if parts:
        pairs = t("lineitem").select("l_partkey", "l_suppkey").distinct()
        out = out.union(edge(pairs, node("p", "l_partkey"), "supplied_by", node("s", "l_suppkey"), 1 + F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(5))))
    return out


#: The same graph in SQL, for oracles: WITH edges AS (...).
STAR_EDGES_SQL = """
  SELECT 'c' || c_custkey AS src, 'in_nation' AS pred, 'n' || c_nationkey AS dst, CAST(1 + c_custkey % 7 AS DOUBLE) AS w FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'in_nation', 'n' || s_nationkey, CAST(1 + s_suppkey % 7 AS DOUBLE) FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'in_region', 'r' || n_regionkey, CAST(1 + n_nationkey % 3 AS DOUBLE) FROM nation
"""
PART_EDGES_SQL = STAR_EDGES_SQL + """
  UNION ALL SELECT 'p' || l_partkey, 'supplied_by', 's' || l_suppkey, CAST(1 + (l_partkey + l_suppkey) % 5 AS DOUBLE)
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
"""
