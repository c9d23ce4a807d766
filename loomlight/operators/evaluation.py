"""Statistics for comparing runs: rows (group, metric value), figures per group or pair of groups.

Ranks and percentiles by place start from counts of equal values, dealt by ranges (module ranks).
Tests give their p, unless with_p is false: building its expression takes a second.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlight.functions.distributions import chi_tail, f_tail, normal_quantile, normal_tail, polynomial, t_tails
from loomlight.operators import ranks
from loomlight.operators.common import cut

# Weights of the metrics in an overall score, in this order.
METRIC_WEIGHTS = {"faithfulness": 0.25, "answer_relevancy": 0.20, "context_precision": 0.15, "context_recall": 0.15, "answer_correctness": 0.20, "answer_similarity": 0.05}


def percentile_by_place(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """group, disc, cont: the value at place floor(n p) of the sorted values (the last at most), and the one between places around n p."""
    low = lambda n: F.least(F.floor(n * F.lit(p)), n - 1)
    found = ranks.at_places(ranks.counted(df, group, value), group, {"_a": low, "_b": lambda n: F.least(low(n) + 1, n - 1)})
    part = F.least(F.col("n") * F.lit(p) - low(F.col("n")), F.lit(1.0))
    return found.select(group, F.col("_a").alias("disc"), (F.col("_a") + part * (F.col("_b") - F.col("_a"))).alias("cont"))


def _beside(found: DataFrame, other: DataFrame, group: str) -> DataFrame:
    """Two tables of a row for each group, null groups too, side by side."""
    return found.join(other.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def latency(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, p50, p95, p99 (linear between places), mean, least, most, from counts of equal values."""
    values = ranks.counted(df, group, value)
    mean = (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean")
    rest = values.groupBy(group).agg(mean, F.min("value").alias("least"), F.max("value").alias("most"))
    return _beside(ranks.between(values, group, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n"), rest, group)


def describe(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, sd (ddof 1), se."""
    found = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return found.withColumn("se", F.col("sd") / F.sqrt("n"))


def bootstrap(df: DataFrame, group: str, value: str, key: str, resamples: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """group, low, high: a percentile interval of the mean.

    Each row enters each resample a Poisson(1) number of times, drawn from a hash of seed, key and
    resample: rows need not meet, tasks send only sums, and runs agree.
    """
    table = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("x"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(resamples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            x, h = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            for name in set(names):
                mine = np.flatnonzero(names == name)
                total, count = np.zeros(resamples), np.zeros(resamples)
                for k in range(0, len(mine), 512):
                    part = mine[k : k + 512]
                    z = h[part][:, None] + steps
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
                    times = np.searchsorted(table, u)
                    total += x[part] @ times
                    count += times.sum(axis=0)
                yield pa.RecordBatch.from_pydict({"g": [name] * resamples, "r": np.arange(resamples), "total": total, "count": count})

    sums = rows.mapInArrow(run, "g string, r long, total double, count double").groupBy("g", "r").agg((F.sum("total") / F.sum("count")).alias("mean"))
    edge = (1 - level) / 2
    return sums.groupBy(F.col("g").alias(group)).agg(F.percentile("mean", edge).alias("low"), F.percentile("mean", 1 - edge).alias("high"))


def outliers(df: DataFrame, group: str, value: str, factor: float = 1.5) -> DataFrame:
    """Rows beyond factor times the quartiles' distance, of groups with four values at least."""
    q = ranks.between(ranks.counted(df, group, value), group, {"_a": 0.25, "_b": 0.75}).withColumnRenamed("n", "_n").where("_n >= 4")
    reach = factor * (F.col("_b") - F.col("_a"))
    return df.join(q, group).where((F.col(value) < F.col("_a") - reach) | (F.col(value) > F.col("_b") + reach)).drop("_a", "_b", "_n")


def _sides(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    side = lambda x, f: f(F.when(F.col(group) == x, F.col(value)))
    return df.agg(*(side(x, f).alias(f"{name}{i}") for i, x in enumerate((a, b)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))


def compare_two(df: DataFrame, group: str, value: str, a, b, with_p: bool = True) -> DataFrame:
    """One row: means, Cohen's d (pooled), Student's t (pooled), its degrees of freedom and p."""
    s = _sides(df, group, value, a, b)
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    gap = F.col("m0") - F.col("m1")
    d = F.when(pooled == 0, F.lit(0.0)).otherwise(gap / pooled)
    t = gap / (pooled * F.sqrt(1 / F.col("n0") + 1 / F.col("n1")))
    found = s.select(F.col("m0").alias("mean_a"), F.col("m1").alias("mean_b"), d.alias("cohens_d"), t.alias("t"), (F.col("n0") + F.col("n1") - 2).alias("df"))
    return found.withColumn("p", t_tails(F.col("t"), F.col("df"))) if with_p else found


def paired_t(df: DataFrame, x: str, y: str, with_p: bool = True) -> DataFrame:
    """One row: t of the paired differences, n, p."""
    gap = (F.col(x) - F.col(y)).cast("double")
    found = df.agg((F.avg(gap) / (F.stddev_samp(gap) / F.sqrt(F.count(gap)))).alias("t"), F.count(gap).alias("n"))
    return found.withColumn("p", t_tails(F.col("t"), F.col("n") - 1)) if with_p else found


def mann_whitney(df: DataFrame, group: str, value: str, a, b, with_p: bool = True) -> DataFrame:
    """One row: U of group a, n of each, and p on both sides (normal, with corrections for ties and continuity); equal values share their mean rank. Values are counted before they are ranked."""
    c = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == a).alias("x"), F.count_if(F.col(group) == b).alias("y"))
    # each value of a beats smaller values of b and draws with equal ones
    below = F.col("upto_y") - F.col("y")
    u = F.sum(F.col("x") * (below + F.col("y") / 2)).alias("u")
    s = ranks.running(c, ["v"], ["y"]).agg(u, F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), _ties(F.col("x") + F.col("y")).alias("_ties"))
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    sd = F.sqrt(F.col("n_a") * F.col("n_b").cast("double") / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - F.col("n_a") * F.col("n_b") / 2) - 0.5) / sd
    return s.select("u", "n_a", "n_b", *([F.least(F.lit(1.0), 2 * normal_tail(z)).alias("p")] if with_p else []))


def _ties(times: Column) -> Column:
    """Sum of t ^ 3 - t over values that occur t times."""
    return F.sum(F.pow(times.cast("double"), 3) - times)


def anova(df: DataFrame, group: str, value: str, with_p: bool = True) -> DataFrame:
    """One row: F, degrees of freedom between and within, eta squared, p."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_samp(value) * (F.count(value) - 1)).alias("ss"))
    total = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between"))
    f = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    found = total.select(f.alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), (F.col("between") / (F.col("between") + F.col("within"))).alias("eta_squared"))
    return found.withColumn("p", f_tail(F.col("f"), F.col("df_between"), F.col("df_within"))) if with_p else found


def adjusted(tests: DataFrame, p: str = "p", key: str = "test", alpha: float = 0.05) -> DataFrame:
    """tests with bonferroni and bh (Benjamini-Hochberg) p-values and whether bh is at most alpha. Tests without a p don't count and get nulls. Equal p have the same values, so each p is worked out once."""
    name = F.col(p).cast("double")
    c = tests.where(F.col(p).isNotNull()).groupBy(name.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ranks.running(c, ["_p"], ["_c"])
    m = ranked.agg(F.max("upto__c").alias("_m"))  # one row
    raw = ranked.crossJoin(F.broadcast(m)).select("_p", "_m", (-F.col("_p")).alias("_back"), (F.col("_p") * F.col("_m") / F.col("upto__c")).alias("_r"))
    known = ranks.running(raw, ["_back"], least=["_r"]).select("_p", F.least(F.lit(1.0), F.col("_p") * F.col("_m")).alias("bonferroni"), F.least(F.lit(1.0), F.col("least__r")).alias("bh"))
    return tests.join(known, name == F.col("_p"), "left").select(*tests.columns, "bonferroni", "bh", (F.col("bh") <= alpha).alias("significant"))


def metric_ranks(scores: DataFrame, system: str = "system", metric: str = "metric", value: str = "value") -> DataFrame:
    """scores with the rank of the system for each metric, best first, equal ones alike."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(metric).orderBy(F.desc(value))))


def best_per_metric(scores: DataFrame, system: str = "system", metric: str = "metric", value: str = "value") -> DataFrame:
    """metric, best, value; ties go to the first name."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(system).alias("s")))
    return scores.groupBy(metric).agg(best.alias("b")).select(metric, F.col("b.s").alias("best"), (-F.col("b.v")).alias("value"))


def overall(scores: DataFrame, weights: dict[str, float] = METRIC_WEIGHTS, system: str = "system", metric: str = "metric", value: str = "value") -> DataFrame:
    """system, overall: the weighted mean of its metrics, over the weights of those it has."""
    w = F.try_element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col(metric))
    return scores.where(w.isNotNull()).groupBy(system).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("overall"))


def context_quality(results: DataFrame, known: DataFrame, hit: str = "hit", query: str = "query_id") -> DataFrame:
    """query, precision (share of results that are relevant), recall (share of relevant ones found), utilisation (relevant results with a score over 0.7).

    results: query, score, hit (whether relevant). known: query, known (how many are relevant); the
    relevant ones themselves, which grow with queries times rows, are never listed.
    """
    hits = results.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.count_if(F.col("score") > 0.7).alias("close"))
    return hits.join(known, query, "left").select(query, (F.col("hits") / F.col("n")).alias("precision"), F.coalesce(F.col("hits") / F.col("known"), F.lit(0.0)).alias("recall"), (F.col("close") / F.col("n")).alias("utilisation"))


def nearest_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, p95, p99 as the values at place floor(p n)."""
    at = lambda p: lambda n: F.least(F.floor(n * F.lit(p)), n - 1)
    values = ranks.counted(df, group, value)
    mean = values.groupBy(group).agg((F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"))
    return _beside(ranks.at_places(values, group, {"p95": at(0.95), "p99": at(0.99)}), mean, group).select(group, "n", "mean", "p95", "p99")


def kruskal(df: DataFrame, group: str, value: str, with_p: bool = True) -> DataFrame:
    """One row: H with the correction for ties, degrees of freedom, p. Values are counted before they are ranked."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    per_value = ranks.running(c.groupBy("v").agg(F.sum("c").alias("t")), ["v"], ["t"])
    ranked = per_value.select("v", (F.col("upto_t") - (F.col("t") - 1) / 2).alias("rank"))
    sums = c.join(ranked, "v").groupBy("g").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("n"))
    ties = per_value.agg(_ties(F.col("t")).alias("ties"))
    total = sums.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(ties))  # one row
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    found = total.select(h.alias("h"), (F.col("k") - 1).alias("df"))
    return found.withColumn("p", chi_tail(F.col("h"), F.col("df"))) if with_p else found


def wilcoxon(df: DataFrame, x: str, y: str, with_p: bool = True) -> DataFrame:
    """One row: the smaller signed rank sum of paired differences (none of zero), n, and p on both sides (normal, with the correction for ties). Equal sizes share their mean rank."""
    gap = (F.col(x) - F.col(y)).cast("double")
    c = df.select(F.round(gap, 9).alias("d")).where("d != 0").groupBy(F.abs("d").alias("v")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    rank = F.col("upto_t") - (F.col("t") - 1) / 2
    ranked = ranks.running(c, ["v"], ["t"]).select("t", "up", rank.alias("rank"))
    s = ranked.agg(F.sum(F.col("rank") * F.col("up")).alias("a"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("b"), F.sum("t").alias("n"), _ties(F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.abs(F.least("a", "b") - n * (n + 1) / 4) / sd
    return s.select(F.least("a", "b").alias("w"), "n", *([F.least(F.lit(1.0), 2 * normal_tail(z)).alias("p")] if with_p else []))


def friedman(df: DataFrame, block: str, treatment: str, value: str, with_p: bool = True) -> DataFrame:
    """One row: chi-squared of ranks within blocks (equal values share their mean rank, no correction), degrees of freedom, blocks, p."""
    w = Window.partitionBy(block).orderBy(value)
    same = F.count(F.lit(1)).over(Window.partitionBy(block, value))
    ranked = df.select(treatment, block, (F.rank().over(w) + (same - 1) / 2).alias("r"))
    sums = ranked.groupBy(treatment).agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum(F.col("r") * F.col("r")).alias("s"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    chi = 12 / (F.col("n") * F.col("k") * (F.col("k") + 1)) * F.col("s") - 3 * F.col("n") * (F.col("k") + 1)
    found = total.select(chi.alias("chi"), (F.col("k") - 1).alias("df"), F.col("n").alias("blocks"))
    return found.withColumn("p", chi_tail(F.col("chi"), F.col("df"))) if with_p else found


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: Levene's statistic about the medians (F of distances from the group's median), degrees of freedom, p. Null groups and values are left out."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    middle = ranks.between(ranks.counted(rows, "g", "x"), "g", {"m": 0.5}).drop("n")
    return anova(rows.join(middle, "g").select("g", F.abs(F.col("x") - F.col("m")).alias("z")), "g", "z").select(F.col("f").alias("w"), "df_between", "df_within", "p")


# Royston's polynomials for the Shapiro-Wilk test (algorithm AS R94), lowest power first: the two outer
# weights, and mean and logarithm of the deviation of the transformed statistic for few (4 to 11) and for many values.
_OUTER = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_FEW_START, _FEW_MEAN, _FEW_SPREAD = (-2.273, 0.459), (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
_MANY_MEAN, _MANY_SPREAD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
#: Ranks of equal values that a row lists at once.
_LISTED = 1024


def shapiro(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, w, p: the Shapiro-Wilk test for normality of groups of three values at least (w is 1 if all are equal).

    Weights belong to ranks, which come from running counts; equal values take those of all their
    ranks, listed piece by piece. Royston's approximation is made for up to 5,000 values; beyond, p goes on by the same formula.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    ranked = cut(ranks.running(rows, ["x"], ["c"], ["g"]))
    x, c = F.col("x"), F.col("c")
    # about the mean, so that squares don't cancel
    first = ranked.groupBy("g").agg(F.sum("c").alias("n"), (F.sum(x * c) / F.sum("c")).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high")).where("n >= 3")
    first = first.withColumnRenamed("g", "_g")
    pieces = F.explode(F.sequence(F.col("upto_c") - c + 1, F.col("upto_c"), F.lit(_LISTED).cast("long"))).alias("from")
    pieces = ranked.select("g", "x", "upto_c", pieces).select("g", "x", "from", F.least(F.col("from") + _LISTED - 1, F.col("upto_c")).alias("to"))
    both = pieces.join(first, F.col("g").eqNullSafe(F.col("_g")))
    score = lambda i: normal_quantile((i - 0.375) / (F.col("n") + 0.25))
    scores = F.transform(F.sequence("from", "to"), score)
    inner = F.filter(F.transform(F.sequence("from", "to"), lambda i: F.when((i > F.when(F.col("n") > 5, 2).otherwise(1)) & (i < F.col("n") - F.when(F.col("n") > 5, 1).otherwise(0)), score(i))), lambda m: m.isNotNull())
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, m: s + m)
    at = lambda i: F.sum(F.when((F.col("from") <= i) & (i <= F.col("to")), x - F.col("mean")))
    parts = both.select("g", "n", "x", "mean", "from", "to", scores.alias("m"), inner.alias("i")).groupBy("g").agg(
        F.first("n").alias("n"),
        F.sum(F.aggregate("m", F.lit(0.0), lambda s, m: s + m * m)).alias("ssq"),
        F.sum(add(F.col("i")) * (x - F.col("mean"))).alias("inside"),
        at(F.col("n")).alias("x1"), at(F.col("n") - 1).alias("x2"), at(F.lit(1)).alias("y1"), at(F.lit(2)).alias("y2"),
        F.sum(F.size("m") * (x - F.col("mean")) * (x - F.col("mean"))).alias("squares"),
    )
    n, u = F.col("n").cast("double"), 1 / F.sqrt(F.col("n").cast("double"))
    m1, m2 = normal_quantile((n - 0.375) / (n + 0.25)), normal_quantile((n - 1.375) / (n + 0.25))
    parts = parts.withColumns({"m1": m1, "m2": m2})
    a1 = F.when(n == 3, math.sqrt(0.5)).otherwise(F.col("m1") / F.sqrt("ssq") + polynomial(u, _OUTER))
    a2 = F.when(n > 5, F.col("m2") / F.sqrt("ssq") + polynomial(u, _NEXT)).otherwise(F.lit(0.0))
    parts = parts.withColumns({"a1": a1, "a2": a2})
    two = F.when(n > 5, F.col("m2") * F.col("m2")).otherwise(0.0)
    phi = (F.col("ssq") - 2 * F.col("m1") * F.col("m1") - 2 * two) / (1 - 2 * F.col("a1") * F.col("a1") - 2 * F.col("a2") * F.col("a2"))
    weighed = F.col("a1") * (F.col("x1") - F.col("y1")) + F.col("a2") * (F.col("x2") - F.col("y2")) + F.when(n > 3, F.col("inside") / F.sqrt(phi)).otherwise(0.0)
    w = F.when(F.col("squares") > 0, F.least(F.lit(1.0), weighed * weighed / F.col("squares"))).otherwise(1.0)
    few, many = F.log(F.greatest(1 - F.col("w"), F.lit(1e-300))), F.log(n)
    z_few = (-F.log(F.greatest(polynomial(n, _FEW_START) - few, F.lit(1e-300))) - polynomial(n, _FEW_MEAN)) / F.exp(polynomial(n, _FEW_SPREAD))
    z_many = (few - polynomial(many, _MANY_MEAN)) / F.exp(polynomial(many, _MANY_SPREAD))
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    p = F.when(n == 3, three).otherwise(normal_tail(F.when(n < 12, z_few).otherwise(z_many)))
    return parts.select(F.col("g").alias(group), "n", w.alias("w")).withColumn("p", F.when(F.col("w") == 1, 1.0).otherwise(p))


def chosen_test(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """One row: the test that fits the groups, with its statistic and p, and what it was chosen by: whether all are normal (Shapiro-Wilk) and alike in spread (Levene).

    Two groups: t, or Mann-Whitney's U; more: F, or Kruskal and Wallis' H. Groups of under three values
    count as not normal. Values that are null or not finite and null groups are left out. Raises ValueError with fewer than two groups.
    """
    x = F.col(value).cast("double")
    rows = cut(df.where(F.col(group).isNotNull() & (F.abs(x) < float("inf"))).select(F.col(group).alias("g"), x.alias("x")))
    normal = shapiro(rows, "g", "x").agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.every(F.col("p") > alpha), F.lit(False)).alias("normal")).first()
    names = [r.g for r in rows.select("g").distinct().orderBy("g").limit(3).collect()]
    if len(names) < 2:
        raise ValueError("a test needs two groups at least")
    k = rows.select("g").distinct().count()
    is_normal = bool(normal.normal) and normal.k == k
    spread = levene(rows, "g", "x").first().p if normal.k == k else None
    alike = spread is not None and not math.isnan(spread) and spread > alpha
    fits = is_normal and alike
    if k == 2:
        found = compare_two(rows, "g", "x", *names).select(F.lit("t").alias("test"), F.col("t").alias("statistic"), "p") if fits else mann_whitney(rows, "g", "x", *names).select(F.lit("mann-whitney").alias("test"), F.col("u").alias("statistic"), "p")
    else:
        found = anova(rows, "g", "x").select(F.lit("anova").alias("test"), F.col("f").alias("statistic"), "p") if fits else kruskal(rows, "g", "x").select(F.lit("kruskal-wallis").alias("test"), F.col("h").alias("statistic"), "p")
    return found.select("*", F.lit(is_normal).alias("normal"), F.lit(alike).alias("equal_spread"), F.lit(k).cast("long").alias("groups"), (F.col("p") < alpha).alias("significant"))
