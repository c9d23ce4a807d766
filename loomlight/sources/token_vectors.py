"""A table of token vectors (doc_id, tok, vec, bucket): documents are encoded, replaced as a whole, and those without vectors healed.

Files are dealt by bucket, a hash of doc_id; a change writes the buckets of its documents anew and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.functions import vectors as V
from loomlight.operators.common import cut, sized, stored
from loomlight.sources.store import _exists

Model = Callable[[], Callable[[list[str]], list]]
#: Default number of buckets. A task writes a bucket, so choose more for large tables: about one for each 256 MB of vectors.
BUCKETS = 64


def usable(text: Column | str) -> Column:
    """Whether a text has anything to encode: not null, and more than white space."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"\S")


def encoded(docs: DataFrame, model: Model, batch_size: int = 32, key: str = "doc_id", text: str = "text", content: Callable[[str], Column] = usable) -> DataFrame:
    """doc_id, tok (from 0), vec of unit length (a zero vector stays) for each token of each usable text.

    content says which texts are usable, for a model that has tokens for blank ones too. model() is opened once in each task and gives for a list of texts one list of vectors each; it sees batch_size texts at a time. Of rows that share an id
    the greatest text is taken, so that a document has one set of tokens. Rows without an id are left out.
    """

    @F.pandas_udf("array<array<float>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = None
        for batch in batches:
            encoder = encoder or model()
            texts, out = batch.tolist(), []
            for k in range(0, len(texts), batch_size):
                out += [[list(map(float, v)) for v in vectors] for vectors in encoder(texts[k : k + batch_size])]
            yield pd.Series(out, dtype="object")

    rows = docs.where(F.col(key).isNotNull() & content(text)).groupBy(F.col(key).alias("doc_id")).agg(F.max(text).alias("text"))
    tokens = rows.select("doc_id", F.posexplode(encode("text")).alias("tok", "vec"))
    return tokens.select("doc_id", "tok", V.normalise("vec").alias("vec"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace(tokens: DataFrame, path: str, ids: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Deletes the documents of ids (by default those of tokens) from the table at path and inserts tokens, in one overwrite of the buckets concerned.

    A run that fails leaves the table as it was, but for a file system that can't rename; running it again gives the same table. buckets must stay as it was at first.
    No tokens and no table leave no table.
    """
    spark = tokens.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    new = stored(tokens.select("doc_id", "tok", "vec", bucket), "token-vectors")
    out = new
    if _exists(spark, path):
        ids = cut((new if ids is None else ids).select("doc_id").distinct())
        touched = [r.bucket for r in ids.select(bucket).distinct().collect()]  # at most `buckets`
        old = read(spark, path).where(F.col("bucket").isin(touched)).select("doc_id", "tok", "vec", "bucket")
        kept = old.join(sized(ids, 24), "doc_id", "left_anti")
        # the files are read before they are replaced; a bucket of which nothing stays keeps one row without an id, as an empty one would not be written
        blank = spark.createDataFrame([(b,) for b in touched], "bucket int").join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_anti")
        blank = blank.select(F.lit(None).cast(new.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("int").alias("tok"), F.lit(None).cast(new.schema["vec"].dataType).alias("vec"), "bucket")
        out = stored(new.unionByName(kept.where("doc_id is not null")).unionByName(blank), "token-vectors")
    elif new.isEmpty():
        return
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, tok, vec of the table."""
    return read(spark, path).where("doc_id is not null").select("doc_id", "tok", "vec")


def ingest(docs: DataFrame, path: str, model: Model, batch_size: int = 32, buckets: int = BUCKETS, content: Callable[[str], Column] = usable) -> None:
    """Encodes docs and puts their tokens in place of those they had; a document whose text is blank now (or not usable by content) loses its own."""
    replace(encoded(docs, model, batch_size, content=content), path, docs.where("doc_id is not null"), buckets)


def missing(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Documents without a token vector."""
    return docs.join(tokens.select("doc_id").distinct(), "doc_id", "left_anti")


def heal(docs: DataFrame, path: str, model: Model, first: int | None = None, force: bool = False, batch_size: int = 32, buckets: int = BUCKETS, content: Callable[[str], Column] = usable) -> DataFrame:
    """Gives token vectors to the documents without any, of all or of the first so many by doc_id; with force to all of these anew. content is as for encoded.

    Returns one row: status (no_documents, no_valid_content, complete, partial), processed, blank (documents that have nothing to encode), still_missing (usable ones without vectors).
    """
    spark = docs.sparkSession
    target = docs.where("doc_id is not null").select("doc_id", "text")
    target = cut(target if first is None else target.orderBy("doc_id").limit(first))
    have = lambda: vectors(spark, path) if _exists(spark, path) else spark.createDataFrame([], target.select("doc_id").schema)
    todo = cut(target if force else missing(target, have()))
    # documents, not rows: of rows that share an id one usable text will do
    n = todo.groupBy("doc_id").agg(F.max(content("text")).alias("ok")).agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("blank")).first()
    if n.processed or force:
        ingest(todo, path, model, batch_size, buckets, content)
    left = missing(target.where(content("text")), have()).select("doc_id").distinct().count()
    status = "no_documents" if target.isEmpty() else "partial" if left else "no_valid_content" if n.blank and not n.processed else "complete"
    return spark.createDataFrame([(status, n.processed, n.blank, left)], "status string, processed long, blank long, still_missing long")
