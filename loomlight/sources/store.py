"""Tables that change: each function gives the new rows, which the caller writes to a new place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.operators.common import sized

# Metadata keys that filters may name.
FILTER_KEYS = (
    "doc_id", "source", "title", "author", "created_at", "updated_at", "content_type", "file_type", "page_number",
    "section", "chunk_id", "chunk_index", "language", "collection_id", "metadata_hash", "parent_doc_id", "version",
)


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id", kept_if_null: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new in place of those of the same key. Columns named in kept_if_null keep the old value where the new one is null. Of several new rows of a key the greatest stays, column by column in their order, so that runs agree."""
    last = new.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(*new.columns)).alias("_row")).select("_row.*")
    if kept_if_null:
        before = old.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in kept_if_null))
        last = last.join(before, F.col(key) == F.col("_k"), "left")
        last = last.select(*(F.coalesce(c, f"_{c}").alias(c) if c in kept_if_null else F.col(c) for c in new.columns))
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(last)


def delete(old: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return old.join(sized(ids.select(key).distinct(), 24), key, "left_anti")


def lookup(rows: DataFrame, ids: list, key: str = "doc_id") -> DataFrame:
    """Rows of the ids given; the filter reaches the files."""
    return rows.where(F.col(key).isin(ids))


def attach(spark: SparkSession, name: str, rows: DataFrame, key: str, text: str, vector: str | None = None) -> DataFrame:
    """Registers a table under a name without copying it: a view with key, text and vector as doc_id, text, embedding. Returns one row: rows, dim. Raises ValueError for missing columns."""
    wanted = {"doc_id": key, "text": text} | ({"embedding": vector} if vector else {})
    if missing := [c for c in wanted.values() if c not in rows.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    view = rows.select(*(F.col(c).alias(a) for a, c in wanted.items()), *(c for c in rows.columns if c not in wanted.values() and c not in wanted))
    view.createOrReplaceTempView(name)
    dim = F.max(F.size("embedding")).cast("long") if vector else F.lit(None).cast("long")
    return view.agg(F.count(F.lit(1)).alias("rows"), dim.alias("dim"))


def insert_counted(rows: DataFrame, path: str) -> int:
    """Appends rows to a table of files and returns how many went, counted as they are written. Raises ValueError if the files that came hold another number; those there before are not read."""
    from pyspark.sql import Observation

    spark, seen = rows.sparkSession, Observation()
    before = set(spark.read.parquet(path).inputFiles()) if _exists(spark, path) else set()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    n = seen.get["n"]
    came = [f for f in spark.read.parquet(path).inputFiles() if f not in before]
    if (spark.read.parquet(*came).count() if came else 0) != n:
        raise ValueError(f"{path} lacks rows that were written")
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def missing_vectors(docs: DataFrame, vectors: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """Documents without a vector: what a backfill has to embed."""
    have = vectors.where(F.col(vector).isNotNull()).select(key).distinct()
    return docs.join(have, key, "left_anti")


def completeness(rows: DataFrame, column: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row: total, present, share, complete (share at least `least`); 0 for no rows."""
    n, have = F.count(F.lit(1)), F.count(column)
    return rows.agg(n.alias("total"), have.alias("present"), F.coalesce(have / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("share")).withColumn("complete", F.col("share") >= least)


def metadata_filter(wanted: dict, allowed: tuple[str, ...] = FILTER_KEYS, json: str | None = None) -> Column:
    """An equality filter on metadata: columns, or paths in a JSON column. Raises ValueError for keys not allowed and values that aren't scalar."""
    out = F.lit(True)
    for k, v in wanted.items():
        if k not in allowed:
            raise ValueError(f"filters may not name {k!r}")
        if not isinstance(v, str | int | float | bool):
            raise ValueError(f"the value of {k!r} is not a scalar")
        out &= (F.get_json_object(json, f"$.{k}") == F.lit(str(v))) if json else (F.col(k) == F.lit(v))
    return out


def requirements(spark: SparkSession, tables: dict[str, int]) -> DataFrame:
    """table_name, present, rows, met (at least as many rows as asked) for tables or views of the session."""
    found = []
    for name, least in tables.items():
        there = spark.catalog.tableExists(name)
        rows = spark.table(name).count() if there else 0
        found.append((name, there, rows, there and rows >= least))
    return spark.createDataFrame(found, "table_name string, present boolean, rows long, met boolean")
