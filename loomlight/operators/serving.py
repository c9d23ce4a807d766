"""Analytics of requests and other events: windows, limits, running figures.

Where order matters (limits, budgets), rows are dealt by key, sorted within their partition and
read in one pass that keeps a few numbers for the key at hand, so no key is gathered in memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_metrics(events: DataFrame, value: str = "value", failed: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """requests, errors, error_rate (percent, two digits), mean, least and most of a value."""
    failed = failed if failed is not None else F.col("event_type") == "error"
    n, bad = F.count(F.lit(1)), F.count_if(failed)
    return events.groupBy(*by).agg(n.alias("requests"), bad.alias("errors"), F.round(bad * 100.0 / n, 2).alias("error_rate"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def sliding_count(events: DataFrame, key: str, seconds: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """events with in_window: how many of the key's events lie in the seconds up to this one."""
    micros = F.unix_micros(ts)
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(order).over(w))


def in_passes(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], columns: list[str], out: str, kind: str) -> DataFrame:
    """df's columns with what step(state, row of `columns`) says for each row, in order within its key.

    A key's state is what start() gives. Only one key's state is held at a time in a task.
    """
    schema = df.select("*", F.lit(None).cast(kind).alias(out)).schema
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = object(), None
        for batch in batches:
            found = []
            for k, *row in zip(batch[key], *(batch[c] for c in columns)):
                k = None if pd.isna(k) else k
                if k != held:
                    held, state = k, start()
                found.append(step(state, tuple(row)))
            batch[out] = found
            yield batch[[*names, out]]

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limit(events: DataFrame, key: str, limit: int, seconds: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """events with admitted: whether fewer than `limit` admitted ones of the key lie in the window before. Rejected ones don't count."""

    def step(window: deque, row: tuple) -> bool:
        now = row[0]
        while window and window[0] <= now - pd.Timedelta(seconds=seconds):
            window.popleft()
        if len(window) >= limit:
            return False
        window.append(now)
        return True

    return in_passes(events, key, [ts, order], deque, step, [ts], "admitted", "boolean")


def token_batches(items: DataFrame, key: str, tokens: str, order: str, budget: int = 8192) -> DataFrame:
    """items with batch: first in, first out, a new batch of the key where the next item would pass the budget (a larger item stands alone)."""

    def step(state: list, row: tuple) -> int:
        size = int(row[0])
        if state[1] and state[1] + size > budget:
            state[0], state[1] = state[0] + 1, 0
        state[1] += size
        return state[0]

    return in_passes(items, key, [order], lambda: [0, 0], step, [tokens], "batch", "long")


def moving_average(events: DataFrame, key: str, value: Column, order: list[str], alpha: float = 0.1) -> DataFrame:
    """key, average, n: exponential average after the key's last event, begun with its first value, as a weighted sum."""
    w = Window.partitionBy(key)
    placed = events.select(key, value.cast("double").alias("x"), F.row_number().over(w.orderBy(*order)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(alpha)
    return placed.groupBy(key).agg(F.sum(weight * F.col("x")).alias("average"), F.count(F.lit(1)).alias("n"))


def status_of(error_rate: Column) -> Column:
    return F.when(error_rate > 0.1, "degraded").otherwise("healthy")


def rolled_up(status: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """unavailable if any part is, else degraded if any is, else healthy."""
    level = F.when(F.col("status") == "unavailable", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    return status.groupBy(*by).agg(F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unavailable")), F.max(level) + 1).alias("status"))


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """key, begin, finish, events: runs of events with less than the gap between them."""
    found = events.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return found.select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("finish"), "events")


def active(entries: DataFrame, expires: str, now: Column) -> DataFrame:
    """Entries without an expiry or with one after `now`."""
    return entries.where(F.col(expires).isNull() | (F.col(expires) > now))


def cache_counts(entries: DataFrame, expires: str, now: Column) -> DataFrame:
    """total, active, expired."""
    alive = F.col(expires).isNull() | (F.col(expires) > now)
    return entries.agg(F.count(F.lit(1)).alias("total"), F.count_if(alive).alias("active"), F.count_if(~alive).alias("expired"))


def batch_metrics(batches: DataFrame) -> DataFrame:
    """One row of figures over batches (documents, entities, failed, ms): failed ones don't enter the mean."""
    ok = ~F.col("failed")
    return batches.agg(
        F.count(F.lit(1)).alias("batches"), F.count_if("failed").alias("failures"), F.sum(F.when(ok, F.col("documents"))).alias("documents"), F.sum(F.when(ok, F.col("entities"))).alias("entities"),
        F.avg(F.when(ok, F.col("ms"))).alias("mean_ms"), F.count_if(ok & (F.col("entities") == 0)).alias("without_entities"),
    )
