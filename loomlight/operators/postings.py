"""A BM25 index that stays: immutable segments of postings, dealt into buckets by term, merged when read.

Below the index's folder lie four Parquet tables. `postings` (term, key, tf, length) is partitioned by segment
and bucket and sorted by term, `documents` (key, length) and `gone` (key) by segment: a segment's `gone` are keys
whose versions in earlier segments no longer count. `segments` has a row for each segment with the number and total length
of the documents it adds and takes away. That row is appended last, so a segment of a job that broke off is
never read. An upsert writes one segment and touches no other; a search reads the buckets of its terms.
One writer at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.operators import lexical
from loomlight.operators.common import cut, sized

#: Buckets of a new index; a search reads those of its terms.
BUCKETS = 64
#: Documents from which on a bucket is written by several tasks.
TASK_DOCUMENTS = 1 << 20
#: Up to so many terms, files are also skipped by term.
LISTED_TERMS = 512

_SEGMENTS = "segment long, buckets int, added long, added_length long, removed long, removed_length long"
_POSTINGS = "term string, key long, tf long, length long, segment long, bucket int"
_DOCUMENTS, _GONE = "key long, length long, segment long", "key long, segment long"


def _bucket(term: str, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _segments(spark: SparkSession, path: str) -> list:
    """The committed segments, a row each."""
    return sorted(spark.read.schema(_SEGMENTS).parquet(f"{path}/segments").collect(), key=lambda r: r.segment)


def _read(spark: SparkSession, path: str, name: str, schema: str, segments: list) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("segment").isin([r.segment for r in segments]))


def _alive(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (key, segment) that no later segment takes away."""
    last = gone.groupBy(F.col("key").alias("_k")).agg(F.max("segment").alias("_s"))
    return rows.join(sized(last, 32), (F.col("key") == F.col("_k")) & (F.col("segment") < F.col("_s")), "left_anti")


def _write(path: str, number: int, buckets: int, bag: DataFrame, gone: DataFrame, removed: tuple[int, int]) -> None:
    bag = cut(bag.select(F.col("key").cast("long"), "tokens", "length"))
    added, length = bag.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    rows = bag.select("key", "length", F.explode("tokens").alias("term")).groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    rows = rows.withColumns({"bucket": _bucket("term", buckets), "segment": F.lit(number).cast("long")})
    tasks = max(1, math.ceil(added / TASK_DOCUMENTS))
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(tasks))).sortWithinPartitions("bucket", "term", "key")
    rows.write.mode("append").partitionBy("segment", "bucket").parquet(f"{path}/postings")
    own = F.lit(number).cast("long").alias("segment")
    bag.select("key", "length", own).write.mode("append").partitionBy("segment").parquet(f"{path}/documents")
    gone.select(F.col("key").cast("long"), own).write.mode("append").partitionBy("segment").parquet(f"{path}/gone")
    # from here on the segment counts
    bag.sparkSession.createDataFrame([(number, buckets, added, length, *removed)], _SEGMENTS).coalesce(1).write.mode("append").parquet(f"{path}/segments")


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> str:
    """A new index of docs in a folder that doesn't exist yet; the folder. Keys are whole numbers, one row for each; rows without one and texts without tokens are left out."""
    bag = lexical.bags(docs.where(F.col(key).isNotNull()), key, text)
    _write(path, 1, buckets, bag, docs.sparkSession.createDataFrame([], "key long"), (0, 0))
    return path


def upsert(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """One more segment: docs, instead of what their keys had. A text without tokens takes its document away."""
    docs = docs.where(F.col(key).isNotNull())
    _replace(docs.select(F.col(key).cast("long").alias("key")).distinct(), lexical.bags(docs, key, text), path)


def delete(keys: DataFrame, path: str, key: str = "doc_id") -> None:
    """One more segment that takes documents away; unknown keys are no error."""
    none = keys.sparkSession.createDataFrame([], "key long, tokens array<string>, length long")
    _replace(keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key")).distinct(), none, path)


def _replace(keys: DataFrame, bag: DataFrame, path: str) -> None:
    spark, keys = keys.sparkSession, cut(keys)
    segments = _segments(spark, path)
    old = documents(spark, path).join(sized(keys, 16), "key", "left_semi")
    removed = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    _write(path, segments[-1].segment + 1, segments[0].buckets, bag, keys, tuple(removed))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """key, length of the documents that count."""
    segments = _segments(spark, path)
    return _alive(_read(spark, path, "documents", _DOCUMENTS, segments), _read(spark, path, "gone", _GONE, segments)).select("key", "length")


def statistics(spark: SparkSession, path: str) -> tuple[int, float]:
    """Number of documents and their mean length, from the segments' rows alone."""
    segments = _segments(spark, path)
    n = sum(r.added - r.removed for r in segments)
    return n, sum(r.added_length - r.removed_length for r in segments) / n if n else 1.0


def postings(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """term, key, tf, length of the documents that count, for terms (one column, term): only their buckets are read, and of a few terms only the parts of files that may hold them."""
    segments = _segments(spark, path)
    terms = cut(terms.select("term").distinct())
    wanted = [r.b for r in terms.select(_bucket("term", segments[0].buckets).alias("b")).distinct().collect()]
    rows = _read(spark, path, "postings", _POSTINGS, segments).where(F.col("bucket").isin(wanted))
    few = [r.term for r in terms.limit(LISTED_TERMS + 1).collect()]
    rows = rows.where(F.col("term").isin(few)) if len(few) <= LISTED_TERMS else rows.join(sized(terms, 48), "term", "left_semi")
    if len(segments) > 1:
        rows = _alive(rows, _read(spark, path, "gone", _GONE, segments))
    return rows.select("term", "key", "tf", "length")


def everything(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """All postings that count, with their bucket, and the number of buckets: a bucket is pmod(xxhash64(term), buckets)."""
    segments = _segments(spark, path)
    rows = _read(spark, path, "postings", _POSTINGS, segments)
    if len(segments) > 1:
        rows = _alive(rows, _read(spark, path, "gone", _GONE, segments))
    return rows.select("term", "key", "tf", "length", "bucket"), segments[0].buckets


def search(spark: SparkSession, path: str, wanted: DataFrame, k: int) -> DataFrame:
    """The k best documents for each query of wanted (query_id, term, times): query_id, key, score, rank, as lexical.search gives them from the texts."""
    wanted = cut(wanted)
    n, mean_length = statistics(spark, path)
    return lexical.ranked(postings(spark, path, wanted), n, mean_length, wanted, k)


def compact(spark: SparkSession, path: str, target: str) -> str:
    """The same index as one segment in a new folder; the folder."""
    segments = _segments(spark, path)
    gone = _read(spark, path, "gone", _GONE, segments)
    own = F.lit(1).cast("long").alias("segment")
    n, _ = statistics(spark, path)
    rows = _alive(_read(spark, path, "postings", _POSTINGS, segments), gone).select("term", "key", "tf", "length", own, "bucket")
    tasks = max(1, math.ceil(n / TASK_DOCUMENTS))
    rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(tasks))).sortWithinPartitions("bucket", "term", "key").write.partitionBy("segment", "bucket").parquet(f"{target}/postings")
    documents(spark, path).select("key", "length", own).write.partitionBy("segment").parquet(f"{target}/documents")
    gone.limit(0).select("key", own).write.partitionBy("segment").parquet(f"{target}/gone")
    total = sum(r.added_length - r.removed_length for r in segments)
    spark.createDataFrame([(1, segments[0].buckets, n, total, 0, 0)], _SEGMENTS).coalesce(1).write.parquet(f"{target}/segments")
    return target
