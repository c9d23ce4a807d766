"""Streams of events: windows, sessions, duplicates, limits and expiring caches.

Each function takes a streaming (or plain) DataFrame and returns one; run() drives a stream over what
its source holds at the moment and returns what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int = 1000) -> DataFrame:
    """The event files of a folder as a stream, with ts as a TIMESTAMP."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """begin, keys, n, total of each window; rows later than `late` are dropped, windows go out once closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("begin"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("begin"), *keys, "n")


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id") -> DataFrame:
    """key, begin, finish, n of each run of events with less than the gap between them."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("finish"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each combination of keys within the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def admitted(events: DataFrame, limit: int, seconds: int, late: str, key: str = "user_id") -> DataFrame:
    """event_id, key, ts, admitted: at most `limit` admitted events of a key in any `seconds`; rejected ones don't count. A key's state is the times of its admitted events, dropped after the window."""
    schema = f"event_id long, {key} long, ts timestamp, admitted boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        said = []
        for t in (rows["ts"].astype("datetime64[us]").astype("int64")).tolist():
            held = [h for h in held if h > t - seconds * 1_000_000]
            said.append(len(held) < limit)
            if said[-1]:
                held.append(t)
        state.update((held,))
        if held:
            state.setTimeoutTimestamp(max(held[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], key: k[0], "ts": rows["ts"], "admitted": said})

    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, schema, "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drives a stream over all that its source has now into a new folder below the one given, exactly once, and reads the result."""
    place = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/out")


def answer_events(answers: DataFrame, size: int = 50, key: str = "id", text: str = "text") -> DataFrame:
    """key, n, kind, data: what a client is sent for each answer: start, its pieces of `size` characters, complete."""
    body = F.col(text)
    starts = F.when(F.length(body) > 0, F.sequence(F.lit(1), F.length(body), F.lit(size))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda s: F.struct(F.lit("chunk").alias("kind"), F.substring(body, s, F.lit(size)).alias("data")))
    ends = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("data")))
    return answers.select(key, F.posexplode(F.concat(ends("start"), pieces, ends("complete"))).alias("n", "e")).select(key, "n", "e.*")
