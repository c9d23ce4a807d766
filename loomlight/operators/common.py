"""Helpers of the operators: size-checked joins, lineage cuts, ranking with ties settled by id."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join up to this many bytes (rows times a stated width) may be broadcast; beyond it, joins shuffle.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df with a broadcast hint if counting proves it small; unhinted otherwise, so that Spark shuffles or meets in blocks."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset (tests). Raises RuntimeError on a cluster without one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomlight-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, so that loops keep short plans and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df computed once and kept as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # files need no look for their schema


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows in an order that ends with a unique column: a partial top-k in each task, merged."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, group: str | list[str], k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1. Spark limits ranks before it shuffles, so a hot group sends k rows from each task."""
    groups = [group] if isinstance(group, str) else group
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)
