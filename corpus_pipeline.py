"""A corpus pipeline: each stage takes the documents that the stage before kept, and is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlight.llm import bpe, copies, decontaminate, lines, quality
from loomlight.llm.queries import TOKENIZER
from loomlight.llm.shared import scratch, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rule classifier rejects. Null and empty texts are judged like any other, repeats alike; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier line equals or nearly equals, and without documents of which nothing else was left. Null and empty texts stay; rows that repeat an id and a text keep the same lines."""
    return lines.thin(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: proposed by SimHash fingerprints, decided on five-word shingles at 0.8. Of null and empty texts one stays; rows without an id stay, and rows that share one stay together."""
    return copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs. Null and empty texts stay, and so does every repeat of a clean row."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the text decoded from them, and the ids: what a model is trained on. Null and empty texts have no ids; repeats each get a row."""
    return bpe.digests(docs, TOKENIZER, keep_ids=True)


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", encode_tokens),
]
#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
