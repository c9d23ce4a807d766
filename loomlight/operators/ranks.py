"""Ranks, running sums and exact quantiles of any number of rows, without one task that sees them all.

Rows are dealt by ranges of their values and kept, so that partition numbers go by value. Sums of each
partition, as many rows as partitions, tell where each one starts in the whole: a rank is
an offset and a place in a partition, and a quantile is looked up in the one partition that holds it.
Equal values go to one partition, so count them before they come here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlight.operators.common import cut, stored


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in ranges of its keys, sorted within them and kept, with the range's number as _part."""
    return cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*keys))


def counted(df: DataFrame, group: str, value: str) -> DataFrame:
    """The distinct values of each group: group, value, c (how many rows have it) and _part, dealt by group and value. Null values are left out."""
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    return stored(rows.repartitionByRange("_g", "_v").select(F.col("_g").alias(group), F.col("_v").alias("value"), "c", F.spark_partition_id().alias("_part")), "counted")


def _carried(parts: DataFrame, group: list[str], sums: list[str], least: list[str]) -> dict[int, list]:
    """For each part what the parts before it add to its first group: sums, then least values."""
    own = F.struct(*group) if group else F.lit(0)
    per = parts.groupBy("_part", *group).agg(*(F.sum(c).alias(f"s{k}") for k, c in enumerate(sums)), *(F.min(c).alias(f"l{k}") for k, c in enumerate(least)))
    held = F.struct(*(f"s{k}" for k in range(len(sums))), *(f"l{k}" for k in range(len(least))))
    # a row for each part
    ends = per.groupBy("_part").agg(F.min(own).alias("first"), F.max(own).alias("last"), F.max_by(held, own).alias("held")).collect()
    out, group_before, state, fresh = {}, None, None, [0] * len(sums) + [None] * len(least)
    for r in sorted(ends, key=lambda r: r["_part"]):
        goes_on = state is not None and r["first"] == group_before
        out[r["_part"]] = state if goes_on else fresh
        start = out[r["_part"]] if r["first"] == r["last"] else fresh
        state = [a + b if k < len(sums) else b if a is None else a if b is None else min(a, b) for k, (a, b) in enumerate(zip(start, r["held"]))]
        group_before = r["last"]
    return out


def running(df: DataFrame, order: list[str], sums: list[str] = (), group: list[str] = (), least: list[str] = ()) -> DataFrame:
    """df with upto_<c> for each column of sums (whole numbers): its sum over the rows of the group up to this one in the order; and least_<c> for each column of least (doubles): the least so far. Rows that are equal in the order follow one another in any order."""
    sums, least, group = list(sums), list(least), list(group)
    parts = dealt(df, *group, *order)
    carried = _carried(parts, group, sums, least)
    wide = parts.select("*", *(F.lit(0).cast("long").alias(f"upto_{c}") for c in sums), *(F.lit(0.0).alias(f"least_{c}") for c in least)).drop("_part")
    names = wide.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in group:
                codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            own = [batch.column(c)[0].as_py() for c in group]
            if state is None:
                state = carried[batch.column("_part")[0].as_py()]
            elif own != last:
                new[0] = True
            last = [batch.column(c)[n - 1].as_py() for c in group]
            if new[0]:
                state = [0] * len(sums) + [None] * len(least)
            begins = np.flatnonzero(new | (np.arange(n) == 0))
            segment = np.cumsum(new | (np.arange(n) == 0)) - 1
            made, after = [], []
            for k, c in enumerate(sums):
                x = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(x)
                base = total[begins] - x[begins]
                base[0] -= state[k]
                made.append(pa.array(total - base[segment]))
                after.append(int(made[-1][n - 1].as_py()))
            for k, c in enumerate(least, len(sums)):
                x = batch.column(c).fill_null(np.inf).to_numpy(zero_copy_only=False).astype(np.float64).copy()
                if state[k] is not None:
                    x[0] = min(x[0], state[k])
                for a, b in zip(begins, np.append(begins[1:], n)):
                    x[a:b] = np.minimum.accumulate(x[a:b])
                made.append(pa.array(x))
                after.append(float(x[-1]))
            state = after
            kept = [c for c in batch.schema.names if c != "_part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=names)

    return parts.mapInArrow(run, wide.schema)


def at_places(values: DataFrame, group: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group, n (its rows) and for each place the value there: places are functions of n, from 0 to n - 1; values come from counted. Only the partitions that hold a place are searched."""
    per = values.groupBy(group, "_part").agg(F.sum("c").alias("_c"))
    w = Window.partitionBy(group)  # of a row for each part
    per = per.select(group, "_part", "_c", (F.sum("_c").over(w.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("n"))
    inside = lambda at: F.when((at >= F.col("_before")) & (at < F.col("_before") + F.col("_c")), at)
    wanted = per.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_before", "n", *(inside(f(F.col("n"))).cast("long").alias(f"_at_{x}") for x, f in places.items()))
    wanted = wanted.where(F.coalesce(*(f"_at_{x}" for x in places)).isNotNull())
    local = Window.partitionBy(group, "_part").orderBy("value")
    rows = values.join(wanted, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("_upto", F.col("_before") + F.sum("c").over(local))
    return rows.groupBy(group).agg(F.first("n").alias("n"), *(F.min(F.when(F.col("_upto") > F.col(f"_at_{x}"), F.col("value"))).alias(x) for x in places))


def between(values: DataFrame, group: str, shares: dict[str, float]) -> DataFrame:
    """group, n and for each share p the value at place (n - 1) p, linear between places."""
    low = lambda p: lambda n: F.floor((n - 1) * F.lit(p))
    high = lambda p: lambda n: F.least(F.floor((n - 1) * F.lit(p)) + 1, n - 1)
    places = {f"{side}{k}": f(p) for k, p in enumerate(shares.values()) for side, f in (("_l", low), ("_h", high))}
    found = at_places(values, group, places)
    part = lambda p: (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    return found.select(group, "n", *((F.col(f"_l{k}") + part(p) * (F.col(f"_h{k}") - F.col(f"_l{k}"))).alias(x) for k, (x, p) in enumerate(shares.items())))
