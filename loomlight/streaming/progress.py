"""A stream that says how far it is: a status table, and a listener to what Spark reports of it."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

STATUS = "name string, batch long, rows long, total long, state string, message string, at timestamp"


class Progress(StreamingQueryListener):
    """Keeps what Spark reports of one query: rows of each batch, and how it ended. Driver side; a row for each batch."""

    def __init__(self, name: str):
        self.name, self.batches, self.ended, self.error = name, [], threading.Event(), None
        self._run = None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._run = event.runId

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.batches.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self._run:
            self.error = event.exception
            self.ended.set()


def status(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of STATUS so far, none where nothing ran yet."""
    try:
        return spark.read.schema(STATUS).parquet(f"{folder}/status")
    except Exception as e:  # Spark has one class for all of a plan's errors
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STATUS)


def drive(stream: DataFrame, folder: str, name: str, every: int, step: Callable[[DataFrame], DataFrame] = lambda batch: batch, before_commit: Callable[[int], None] | None = None) -> Progress:
    """Takes all that the stream's source has, batch by batch: step(batch) is written to folder/out, and a row to folder/status whenever another `every` rows are done, and at the end.

    A batch replaces its own part of folder/out, so one that broke off and runs again leaves no row
    twice. After a stop the same call goes on behind the last finished batch, with the total so far.
    Raises what stopped the stream, after a row with state failed. before_commit is called with the number of each batch that is written.
    """
    spark = stream.sparkSession
    known = status(spark, folder).where(F.col("name") == name)
    last = known.where("state <> 'failed'").agg(F.max("total").alias("total")).first()
    # batches that were written but are not in the status table yet
    totals = {"total": _written(spark, folder, name) if last.total is not None else 0}
    totals["said"] = last.total or 0

    def say(batch: int, rows: int, state: str, message: str | None = None) -> None:
        row = [(name, batch, rows, totals["total"], state, message, datetime.now(timezone.utc))]
        spark.createDataFrame(row, STATUS).coalesce(1).write.mode("append").parquet(f"{folder}/status")
        totals["said"] = totals["total"]

    def take(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{folder}/out/name={name}/batch={number}")
        if before_commit:
            before_commit(number)
        totals["total"] = _written(spark, folder, name)
        if totals["total"] // every > totals["said"] // every:
            say(number, totals["total"] - totals["said"], "running")

    listener = Progress(name)
    spark.streams.addListener(listener)
    try:
        query = stream.writeStream.queryName(name).foreachBatch(take).option("checkpointLocation", f"{folder}/log/{name}").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            say(-1, 0, "failed", str(e)[:10_000])
            raise
        listener.ended.wait(30)
        say(-1, totals["total"] - totals["said"], "complete")
    finally:
        spark.streams.removeListener(listener)
    return listener


def _written(spark: SparkSession, folder: str, name: str) -> int:
    """Rows of a stream in folder/out, from the files' footers."""
    return spark.read.parquet(f"{folder}/out/name={name}").count()


def output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What a stream has written, without the column batch."""
    return spark.read.parquet(f"{folder}/out/name={name}").drop("batch")
