"""The expiring cache against a plain model over several batches, and the progress of streams."""

import random
from datetime import datetime, timedelta

import pytest

from loomlight.streaming import cache, progress, streams

START = datetime(2024, 1, 1)


def model(batches):
    """What gets and clears say, batch after batch."""
    held, out = {}, []
    for rows in batches:
        for op_id, key, op, value, ttl, at in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[5], r[0])):
            if key in held and held[key][1] is not None and held[key][1] <= at:
                del held[key]
            if op == "put":
                held[key] = (value, None if ttl is None else at + timedelta(seconds=ttl))
            elif op == "clear":
                out.append((op_id, "cleared" if held.pop(key, None) else "absent", None))
            elif op == "get":
                out.append((op_id, "hit" if key in held else "miss", held[key][0] if key in held else None))
    return sorted(out)


def test_cache_over_batches(spark, tmp_path):
    rng = random.Random(1)
    batches, n = [], 0
    for b in range(4):
        rows = []
        for _ in range(30):
            n += 1
            rows.append((n, rng.choice(["a", "b", "c", None]), rng.choice(["put", "put", "get", "get", "get", "clear", "other"]), rng.choice(["x", "y", None]), rng.choice([20, 100, None]), START + timedelta(seconds=b * 300 + rng.randrange(300))))
        batches.append(rows)
    batches.append([(n + 1, "z", "get", None, None, START + timedelta(days=1))])
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, cache.OPERATIONS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    read = spark.readStream.schema(cache.OPERATIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = cache.with_state(spark, lambda: streams.run(cache.expiring(read, "0 seconds"), str(tmp_path))).collect()
    assert sorted((r.op_id, r.kind, r.value) for r in found if r.op_id is not None) == model(batches)
    assert {r.kind for r in found if r.op_id is None} <= {"expired"}


def test_an_entry_is_taken_away_by_its_timer(spark, tmp_path):
    rows = [[(1, "a", "put", "x", 10, START), (2, "b", "put", "y", None, START)], [(3, "c", "get", None, None, START + timedelta(hours=1))], [(4, "c", "get", None, None, START + timedelta(hours=2))]]
    for k, r in enumerate(rows):
        spark.createDataFrame(r, cache.OPERATIONS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    read = spark.readStream.schema(cache.OPERATIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = cache.with_state(spark, lambda: streams.run(cache.expiring(read, "0 seconds"), str(tmp_path))).collect()
    assert [(r.key, r.at) for r in found if r.kind == "expired"] == [("a", START + timedelta(seconds=10))]
    assert sorted(r.op_id for r in found if r.kind == "miss") == [3, 4]


def test_progress_goes_on_after_a_stop(spark, tmp_path):
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    read = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "job")

    def stop(batch):
        if batch == 3:
            raise RuntimeError("stopped on purpose")

    with pytest.raises(Exception, match="stopped on purpose"):
        progress.drive(read(), folder, "load", 20, before_commit=stop)
    said = progress.status(spark, folder).orderBy("at").collect()
    assert [(r.state, r.total) for r in said[:-1]] == [("running", 20)] and said[-1].state == "failed" and "on purpose" in said[-1].message
    seen = progress.drive(read(), folder, "load", 20, step=lambda b: b.where("id % 2 = 0 or id < 40"))
    rows = sorted(r.id for r in progress.output(spark, folder, "load").collect())
    assert rows == [*range(40), *range(40, 60, 2)]
    last = progress.status(spark, folder).orderBy("at").collect()[-1]
    assert (last.state, last.total) == ("complete", 50) and seen.error is None
    assert sum(n for _, n in seen.batches) == 30


def test_status_of_nothing(spark, tmp_path):
    assert progress.status(spark, str(tmp_path)).collect() == []
