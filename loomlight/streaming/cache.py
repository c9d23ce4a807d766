"""A cache whose entries expire, kept in the state of a stream.

Operations come as rows: put stores a value for a key, over what it had; get looks it up; clear removes it.
Times are those of the rows. An entry counts until its time to live is over, also where its timer has not
gone off yet; the timer removes it from the state once the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a stream of operations holds; ttl is in seconds, null for entries that stay.
OPERATIONS = "op_id long, key string, op string, value string, ttl long, at timestamp"
RESULTS = "key string, op_id long, kind string, value string, at timestamp"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Cache(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        frame = pd.concat(list(rows)).sort_values(["at", "op_id"], kind="stable")
        micros = frame["at"].astype("datetime64[us]").astype("int64").tolist()
        out = []
        for op_id, op, value, ttl, at, us in zip(frame["op_id"].tolist(), frame["op"], frame["value"], frame["ttl"], frame["at"], micros):
            if held is not None and held[1] is not None and held[1] <= us:
                held = None
            if op == "put":
                held = (None if pd.isna(value) else value, None if pd.isna(ttl) else us + int(ttl) * 1_000_000)
            elif op == "clear":
                out.append((key[0], op_id, "cleared" if held is not None else "absent", None, at))
                held = None
            elif op == "get":
                out.append((key[0], op_id, "hit" if held is not None else "miss", held[0] if held is not None else None, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.entry.clear()
        else:
            self.entry.update(held)
            if held[1] is not None:
                # a millisecond late rather than early
                self.handle.registerTimer(max(held[1] // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "op_id", "kind", "value", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[1] is not None and self.entry.get()[1] <= timerValues.getCurrentWatermarkInMs() * 1000:
            over = pd.Timestamp(self.entry.get()[1], unit="us")
            self.entry.clear()
            yield pd.DataFrame([(key[0], None, "expired", None, over)], columns=["key", "op_id", "kind", "value", "at"]).astype({"op_id": "Int64"})

    def close(self) -> None:
        pass


def expiring(operations: DataFrame, late: str) -> DataFrame:
    """RESULTS of a stream of OPERATIONS: hit or miss with the value for each get, cleared or absent for each clear, and a row for each entry that its timer took away.

    Operations of a key are taken in order of at and op_id within a batch; those of later batches
    come after. Unknown operations do nothing. The session's state store must be RocksDB: see with_state.
    """
    keyed = operations.where(F.col("key").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late).groupBy("key")
    return keyed.transformWithStateInPandas(_Cache(), RESULTS, "append", "EventTime")


def with_state(spark, drive):
    """drive() while the session keeps state in RocksDB, which timers need; the setting is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return drive()
    finally:
        spark.conf.set(_PROVIDER, before)
