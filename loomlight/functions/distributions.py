"""Tail probabilities as column expressions: normal, t, chi-squared and F, by incomplete gamma and beta functions.

The continued fractions run a fixed number of steps, enough for 1e-9 at the sizes below which they are
used; larger degrees of freedom go to the distribution's limit, which is nearer than 1e-6 there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS, _TINY = 400, 1e-300
#: Degrees of freedom from which t is normal (after a correction) and F is chi-squared.
_MANY = 1e6

# Lanczos' series for the gamma function with g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# The rational functions of algorithm AS 241 (seven digits) for normal quantiles, for the middle, the near and the far tail.
_MIDDLE = ((3.3871327179, 50.434271938, 159.29113202, 59.109374720), (1.0, 17.895169469, 78.757757664, 67.187563600))
_NEAR = ((1.4234372777, 2.7568153900, 1.3067284816, 0.17023821103), (1.0, 0.73700164250, 0.12021132975))
_FAR = ((6.6579051150, 3.0812263860, 0.42868294337, 0.017337203997), (1.0, 0.24197894225, 0.012258202635))


def polynomial(x: Column, coefficients) -> Column:
    """Coefficients from that of the lowest power on."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def log_gamma(x: Column) -> Column:
    """Of positive numbers."""
    x = x.cast("double") - 1
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + k)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(t) - t + F.log(series)


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _fraction(start: Column, numerator, denominator, first: Column) -> Column:
    """A continued fraction by Lentz's method: first + numerator(1) / (denominator(1) + ...)."""

    def step(state, k):
        k = k.cast("double")
        return _let(
            F.struct(state["h"].alias("h"), _away(denominator(k) + numerator(k) / state["c"]).alias("c"), (1 / _away(denominator(k) + numerator(k) * state["d"])).alias("d")),
            lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["h"] * s["c"] * s["d"]).alias("h")),
        )

    begin = F.struct(_away(first).alias("c"), F.lit(0.0).alias("d"), _away(first).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), begin, step, lambda s: s["h"])


def gamma_tail(a: Column, x: Column) -> Column:
    """The share of the gamma distribution of shape a above x."""

    def of(p):
        a, x = p["a"], p["x"]
        front = F.exp(a * F.log(x) - x - log_gamma(a))
        term = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
        grow = lambda s, k: _let(s["t"] * x / (a + k), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s")))
        below = front * F.aggregate(F.sequence(F.lit(1), F.lit(2 * _STEPS)), term, grow, lambda s: s["s"])
        above = front / _fraction(x, lambda k: k * (a - k), lambda k: x + 2 * k + 1 - a, x + 1 - a)
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - below).otherwise(above)

    return _let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), of)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The share of the beta distribution of shapes a and b below x."""

    def fraction(a, b, x):
        def numerator(k):
            m = F.floor(k / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(k % 2 == 0, even).otherwise(odd)

        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
        return front / a / _fraction(x, numerator, lambda k: F.lit(1.0), F.lit(1.0))

    def of(p):
        a, b, x = p["a"], p["b"], p["x"]
        turned = x > (a + 1) / (a + b + 2)
        sides = F.struct(F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b"), F.when(turned, 1 - x).otherwise(x).alias("x"))
        share = _let(sides, lambda s: fraction(s["a"], s["b"], s["x"]))
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(turned, 1 - share).otherwise(share)

    return _let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x")), of)


def normal_tail(z: Column) -> Column:
    """The share above z."""
    half = gamma_tail(F.lit(0.5), z * z / 2) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def normal_quantile(p: Column) -> Column:
    """The z below which a share p lies, to seven digits; 0 < p < 1."""
    q = p - 0.5

    def tail(r):
        ratio = lambda x, of: polynomial(x, of[0]) / polynomial(x, of[1])
        return F.signum(q) * F.when(r <= 5, ratio(r - 1.6, _NEAR)).otherwise(ratio(r - 5, _FAR))

    middle = q * polynomial(0.180625 - q * q, _MIDDLE[0]) / polynomial(0.180625 - q * q, _MIDDLE[1])
    return F.when(F.abs(q) <= 0.425, middle).otherwise(_let(F.sqrt(-F.log(F.least(p, 1 - p))), tail))


def t_tails(t: Column, df: Column) -> Column:
    """The share of Student's distribution beyond t on both sides."""
    z = t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df > _MANY, 2 * normal_tail(F.abs(z))).otherwise(beta_share(df / 2, F.lit(0.5), df / (df + t * t)))


def chi_tail(x: Column, df: Column) -> Column:
    """The share of the chi-squared distribution above x."""
    return gamma_tail(df / 2, x / 2)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """The share of the F distribution above f."""
    return F.when(df2 > _MANY, chi_tail(f * df1, df1)).when(f <= 0, 1.0).otherwise(beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)))
