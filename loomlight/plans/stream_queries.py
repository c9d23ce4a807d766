"""Streams over the events of a folder, compared with batches over what closed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomlight.operators.common import rounded, shared_folder
from loomlight.streaming import cache, progress, streams


def stream_tumbling(spark, sf):
    """Days that closed: those that end at least an hour before the last event."""
    found = streams.run(streams.tumbling(streams.read_events(spark, sf), "1 day", "1 hour"), shared_folder(spark))
    return found.select(F.col("begin").cast("string").alias("day"), "event_type", "n", rounded("total").alias("total"))


def stream_sliding(spark, sf):
    found = streams.run(streams.sliding(streams.read_events(spark, sf), "12 hours", "6 hours", "1 hour"), shared_folder(spark))
    return found.select(F.col("begin").cast("string").alias("begin"), "event_type", "n")


def stream_session(spark, sf):
    found = streams.run(streams.sessions(streams.read_events(spark, sf), "30 minutes", "1 hour"), shared_folder(spark))
    return found.select("user_id", F.col("begin").cast("string").alias("begin"), "n")


def stream_dedup(spark, sf):
    found = streams.run(streams.first_of_each(streams.read_events(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "100 days"), shared_folder(spark))
    return found.select("user_id", "event_type")


def stream_rate_limit(spark, sf):
    return streams.run(streams.admitted(streams.read_events(spark, sf), 2, 7200, "1 hour"), shared_folder(spark)).select("event_id", "admitted")


def stream_ttl_cache(spark, sf):
    """Each user's purchases and signups are stored for six hours, errors clear, clicks and views look up."""
    e = streams.read_events(spark, sf)
    op = F.when(F.col("event_type").isin("purchase", "signup"), "put").when(F.col("event_type") == "error", "clear").otherwise("get")
    operations = e.select(F.col("event_id").alias("op_id"), F.col("user_id").cast("string").alias("key"), op.alias("op"), F.col("value").cast("string").alias("value"), F.lit(6 * 3600).cast("long").alias("ttl"), F.col("ts").alias("at"))
    found = cache.with_state(spark, lambda: streams.run(cache.expiring(operations, "1 hour"), shared_folder(spark)))
    return found.where(F.col("kind").isin("hit", "miss")).select("op_id", "key", "kind", rounded(F.col("value").cast("double")).alias("value"))


def stream_progress(spark, sf):
    """The large purchases, taken over batch by batch; how far the status table says it came."""
    folder = f"{shared_folder(spark).rstrip('/')}/progress-{uuid.uuid4().hex}"
    progress.drive(streams.read_events(spark, sf), folder, "purchases", 500, step=lambda batch: batch.where("event_type = 'purchase' and value > 20"))
    taken = progress.output(spark, folder, "purchases").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("total"))
    said = progress.status(spark, folder).where("state = 'complete'").agg(F.max("total").alias("said"))  # one row
    return taken.crossJoin(F.broadcast(said))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_dedup, stream_rate_limit, stream_ttl_cache, stream_progress)}

_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
ORACLE_SQL = {
    "stream_tumbling": f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1, 2",
    "stream_sliding": f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) - to_hours(6 * k) AS b, event_type FROM events, unnest([0, 1]) AS t(k)) SELECT CAST(b AS VARCHAR) AS begin, event_type, count(*) AS n FROM w WHERE b + INTERVAL 12 HOURS <= {_CLOSED} GROUP BY 1, 2""",
    "stream_session": f"""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS begin, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTES <= {_CLOSED}""",
    "stream_ttl_cache": """WITH o AS (SELECT event_id, user_id, ts, value, event_type IN ('click', 'view') AS asks,
  last_value(CASE WHEN event_type NOT IN ('click', 'view') THEN {'put': event_type <> 'error', 'ts': ts, 'value': value} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last FROM events)
SELECT event_id AS op_id, CAST(user_id AS VARCHAR) AS key, CASE WHEN last.put AND ts < last.ts + INTERVAL 6 HOURS THEN 'hit' ELSE 'miss' END AS kind,
       CASE WHEN last.put AND ts < last.ts + INTERVAL 6 HOURS THEN round(last.value, 6) END AS value FROM o WHERE asks""",
    "stream_progress": "SELECT count(*) AS n, round(sum(value), 6) AS total, count(*) AS said FROM events WHERE event_type = 'purchase' AND value > 20",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_rate_limit": """WITH RECURSIVE i AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT event_id, user_id, n, true AS admitted, [ts] AS held FROM i WHERE n = 1
  UNION ALL SELECT i.event_id, i.user_id, i.n, len(list_filter(g.held, lambda h: h > i.ts - INTERVAL 7200 SECONDS)) < 2,
    CASE WHEN len(list_filter(g.held, lambda h: h > i.ts - INTERVAL 7200 SECONDS)) < 2 THEN list_append(list_filter(g.held, lambda h: h > i.ts - INTERVAL 7200 SECONDS), i.ts) ELSE g.held END FROM g JOIN i ON i.user_id = g.user_id AND i.n = g.n + 1)
SELECT event_id, admitted FROM g""",
}
