"""Running sums, quantiles and p-values against plain Python."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlight.functions import distributions as D
from loomlight.operators import evaluation as E
from loomlight.operators import ranks


def rows(seed, n=400, groups=("a", "b", None)):
    rng = random.Random(seed)
    return [(rng.choice(groups), rng.choice([0.5, 1.0, round(rng.gauss(0, 3), 3), None])) for _ in range(n)]


def test_running_sums_by_group(spark):
    data = [(g, k, 1 + k % 3, float(-k % 7)) for k, g in enumerate(["a"] * 50 + [None] * 30 + ["b"] + ["c"] * 40)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "g string, k long, c long, v double").repartition(5)
    found = ranks.running(df, ["k"], ["c"], ["g"], ["v"]).collect()
    assert len(found) == len(data)
    for r in found:
        before = [x for x in data if x[0] == r.g and x[1] <= r.k]
        assert r.upto_c == sum(x[2] for x in before) and r.least_v == min(x[3] for x in before)
    whole = ranks.running(df, ["k"], ["c"]).collect()
    assert all(r.upto_c == sum(x[2] for x in data if x[1] <= r.k) for r in whole)
    assert ranks.running(df.limit(0), ["k"], ["c"]).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_quantiles(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "g string, x double").repartition(3)
    own = lambda g: sorted(x for h, x in data if h == g and x is not None)
    for r in E.latency(df, "g", "x").collect():
        v = own(r.g)
        assert [r.p50, r.p95, r.p99] == pytest.approx(np.percentile(v, [50, 95, 99]).tolist()) and r.mean == pytest.approx(sum(v) / len(v)) and (r.least, r.most) == (v[0], v[-1])
    for r in E.nearest_rank(df, "g", "x").collect():
        v = own(r.g)
        assert (r.n, r.p95, r.p99) == (len(v), v[math.floor(0.95 * len(v))], v[math.floor(0.99 * len(v))])
    assert E.latency(df.limit(0), "g", "x").collect() == []


def integral(f, a, b, n=200_001):
    x = np.linspace(a, b, n)
    y = f(x)
    return float((b - a) / (n - 1) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def test_distributions(spark):
    t = lambda v: lambda x: np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
    chi = lambda k: lambda x: x ** (k / 2 - 1) * np.exp(-x / 2) / (2 ** (k / 2) * math.gamma(k / 2))
    cases = [(0.3, 7.0), (2.0, 4.0), (5.0, 30.0), (1.7, 250.0), (9.5, 3.0)]
    df = spark.createDataFrame([(x, v) for x, v in cases], "x double, v double")
    x, v = F.col("x"), F.col("v")
    found = df.select("x", "v", D.t_tails(x, v).alias("t"), D.chi_tail(x, v).alias("c"), D.f_tail(x, F.lit(4.0), v).alias("f"), D.normal_tail(-x).alias("z")).collect()
    for r in found:
        assert r.t == pytest.approx(1 - 2 * integral(t(r.v), 0, r.x), abs=1e-8)
        assert r.c == pytest.approx(1 - integral(chi(r.v), 1e-12, r.x), abs=1e-7)
        assert r.z == pytest.approx(NormalDist().cdf(r.x), abs=1e-12)
        beta = integral(lambda y: y ** (r.v / 2 - 1) * (1 - y), 0, r.v / (r.v + 4 * r.x)) if r.v > 2 else None
        whole = math.exp(math.lgamma(r.v / 2) + math.lgamma(2) - math.lgamma(r.v / 2 + 2))
        assert r.f == pytest.approx(beta / whole, abs=1e-7)
    # printed in every table of these distributions
    known = spark.createDataFrame([(2.228138852, 10.0, 4.964602744, 3.841458821)], "t double, v double, f double, c double").select(
        D.t_tails(F.col("t"), F.col("v")), D.f_tail(F.col("f"), F.lit(1.0), F.col("v")), D.chi_tail(F.col("c"), F.lit(1.0)), D.t_tails(F.lit(1.959963985), F.lit(1e9)), D.f_tail(F.lit(3.841458821), F.lit(1.0), F.lit(1e9)), D.t_tails(F.lit(1.96), F.lit(9e5))
    )
    assert list(known.first())[:5] == pytest.approx([0.05] * 5, abs=1e-6) and known.first()[5] == pytest.approx(2 * NormalDist().cdf(-1.96), abs=1e-6)


def test_quantiles_of_the_normal_distribution(spark):
    ps = [1e-12, 1e-4, 0.03, 0.075, 0.3, 0.5, 0.9, 0.999]
    found = [r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").select(D.normal_quantile(F.col("p")).alias("z")).collect()]
    assert found == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=2e-6)


def plain_ranks(values):
    return [sum(y < x for y in values) + (values.count(x) + 1) / 2 for x in values]


def test_rank_tests(spark):
    data = [(g, x) for g, x in rows(3, 150, ("a", "b", "c")) if x is not None]
    df = spark.createDataFrame(data, "g string, x double").repartition(4)
    a, b = ([x for g, x in data if g == h] for h in "ab")
    r = E.mann_whitney(df, "g", "x", "a", "b").first()
    pooled, n = plain_ranks(a + b), len(a) + len(b)
    assert r.u == sum(pooled[: len(a)]) - len(a) * (len(a) + 1) / 2
    ties = sum((a + b).count(v) ** 3 - (a + b).count(v) for v in set(a + b))
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert r.p == pytest.approx(2 * NormalDist().cdf(-(abs(r.u - len(a) * len(b) / 2) - 0.5) / sd), abs=1e-9)
    k = E.kruskal(df, "g", "x").first()
    values = [x for _, x in data]
    place, n = plain_ranks(values), len(values)
    s = sum(sum(p for (g, _), p in zip(data, place) if g == h) ** 2 / sum(g == h for g, _ in data) for h in "abc")
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    h = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    assert k.h == pytest.approx(h) and k.p == pytest.approx(math.exp(-h / 2), abs=1e-9)


def test_adjusted(spark):
    rng = random.Random(5)
    ps = [(k, rng.choice([0.001, 0.2, round(rng.random(), 3), None])) for k in range(90)]
    found = {r.test: r for r in E.adjusted(spark.createDataFrame(ps, "test long, p double").repartition(4)).collect()}
    known = sorted(p for _, p in ps if p is not None)
    for k, p in ps:
        if p is None:
            assert found[k].bh is None and found[k].significant is None
        else:
            bh = min(min(1.0, q * len(known) / (i + 1)) for i, q in enumerate(known) if q >= p)
            assert found[k].bh == pytest.approx(bh) and found[k].bonferroni == pytest.approx(min(1.0, p * len(known)))


def test_shapiro_and_levene(spark):
    # weights of men, the example of Shapiro and Wilk's paper
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    data = [("men", float(x)) for x in men] + [("flat", 1.0)] * 5 + [("two", 1.0), ("two", 2.0)] + [("three", x) for x in (1.0, 2.0, 4.0)]
    quantiles = [("normal", NormalDist().inv_cdf((k + 0.5) / 3000)) for k in range(3000)]
    skewed = [("skewed", math.exp(x)) for _, x in quantiles]
    found = {r.g: r for r in E.shapiro(spark.createDataFrame(data + quantiles + skewed, "g string, x double").repartition(3), "g", "x").collect()}
    assert set(found) == {"men", "flat", "three", "normal", "skewed"}
    assert found["men"].w == pytest.approx(0.7888, abs=2e-4) and found["men"].p == pytest.approx(0.0067, abs=2e-4)
    assert found["three"].w == pytest.approx(0.9643, abs=1e-4) and found["three"].p == pytest.approx(0.6369, abs=1e-4)
    assert found["flat"].w == 1 and found["normal"].w > 0.9995 and found["normal"].p > 0.9 and found["skewed"].p < 1e-6
    groups = {"a": [1.0, 2.0, 3.0, 9.0], "b": [4.0, 4.5, 5.0], "c": [0.0, 10.0, 20.0, 31.0]}
    z = {g: [abs(x - np.median(v)) for x in v] for g, v in groups.items()}
    every = [x for v in z.values() for x in v]
    between = sum(len(v) * (np.mean(v) - np.mean(every)) ** 2 for v in z.values())
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in z.values())
    r = E.levene(spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x double"), "g", "x").first()
    assert (r.df_between, r.df_within) == (2, 8) and r.w == pytest.approx((between / 2) / (within / 8))


def test_ties_over_many_ranks(spark, monkeypatch):
    monkeypatch.setattr(E, "_LISTED", 3)
    data = [("g", float(x)) for x in [1] * 9 + [2] * 4 + [3, 4, 5, 9, 9, 9]]
    small = E.shapiro(spark.createDataFrame(data, "g string, x double"), "g", "x").first()
    monkeypatch.setattr(E, "_LISTED", 1024)
    assert small.w == pytest.approx(E.shapiro(spark.createDataFrame(data, "g string, x double"), "g", "x").first().w)


def test_choice(spark):
    normal = [NormalDist().inv_cdf((k + 0.5) / 40) for k in range(40)]
    table = lambda **g: spark.createDataFrame([(k, float(x)) for k, v in g.items() for x in v] + [(None, 1.0), ("a", math.nan), ("a", None)], "g string, x double")
    same = E.chosen_test(table(a=normal, b=[x + 1 for x in normal]), "g", "x").first()
    assert (same.test, same.normal, same.equal_spread, same.significant) == ("t", True, True, True)
    assert E.chosen_test(table(a=normal, b=[9 * x for x in normal]), "g", "x").first().test == "mann-whitney"
    assert E.chosen_test(table(a=normal, b=normal, c=normal), "g", "x").first().test == "anova"
    skewed = E.chosen_test(table(a=normal, b=normal, c=[math.exp(2 * x) for x in normal]), "g", "x").first()
    assert (skewed.test, skewed.normal, skewed.groups) == ("kruskal-wallis", False, 3)
    assert E.chosen_test(table(a=normal, b=[1.0, 2.0]), "g", "x").first().normal is False
    with pytest.raises(ValueError):
        E.chosen_test(table(a=normal), "g", "x")
