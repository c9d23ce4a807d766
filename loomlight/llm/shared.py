"""What the operators of this subpackage share: scratch folders, lineage cuts and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to this many bytes (rows times a stated row width) may be broadcast; beyond it, joins shuffle.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
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


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df computed once and kept as a Parquet table in the shared folder: for large tables, of which a checkpoint takes several times the space."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sized(df: DataFrame, row_bytes: int, array: str | None = None, entry_bytes: int = 8) -> DataFrame:
    """df (already cut, so that counting is cheap) with a broadcast hint if its size is proven small; a column of arrays adds entry_bytes for each entry."""
    if array is None:
        return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
    rows, entries = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(array)), F.lit(0))).first()
    return F.broadcast(df) if rows * row_bytes + entries * entry_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
