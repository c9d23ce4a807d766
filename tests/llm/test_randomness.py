"""The battery against plain Python, its p-values on readable strings, letters alone, and texts with very many matches."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlight.llm import secrets
from tests.llm import nasty


def plain_score(s):
    """The three statistics in a straight way."""
    import re

    name, _, alphabet, excess, changes, correlation = next(e for e in secrets.ENCODINGS if re.search(e[1], s))
    body = s.lower() if name in ("hex", "letters") else s
    x, n, k = [alphabet.find(c) + 1 for c in body], len(s), len(alphabet)
    chi = sum(c * c for v, c in Counter(x).items()) * k / n - n
    more = (n - 1) * excess
    z_chi = ((k - 1) + more - chi) / math.sqrt(2 * (k - 1) + 4 * more + (secrets.EXCESS_SPREAD * more) ** 2)
    kind = (lambda c: c in "aeiouy") if name == "letters" else (lambda c: 0 if c in "0123456789" else 1 if c in "abcdefghijklmnopqrstuvwxyz" else 2 if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 3)
    letters = body if name == "letters" else s
    changed = sum(kind(a) != kind(b) for a, b in zip(letters, letters[1:]))
    z_runs = (changed - (n - 1) * changes) / math.sqrt((n - 1) * changes * (1 - changes) + (secrets.CHANGES_SPREAD * (n - 1)) ** 2) * (-1 if name == "letters" else 1)
    spread = n * sum(v * v for v in x) - sum(x) ** 2
    r = (n * (sum(a * b for a, b in zip(x, x[1:])) + x[-1] * x[0]) - sum(x) ** 2) / spread if spread > 0 else 1.0
    z_serial = (correlation - r) / math.sqrt(1 / n + secrets.CORRELATION_SPREAD**2)
    return (z_chi + z_runs + secrets.SERIAL * z_serial) / math.sqrt(2 + secrets.SERIAL**2)


WORDS = "user name parse config file default timeout customer address content length index handler version request response session manager total amount order line item price discount account number street payment status report monthly summary invoice delivery window buffer offset counter element attribute reader writer stream channel message queue".split()


def readable(rng, style):
    parts = rng.choices(WORDS, k=rng.randrange(4, 8))
    if style == "letters":
        return "".join(parts)
    if style == "camel":
        return parts[0] + "".join(p.title() for p in parts[1:])
    return rng.choice("_-/").join(parts) + (str(rng.randrange(100)) if style == "digits" else "")


def draw(rng, alphabet, n):
    return "".join(rng.choices(alphabet, k=n))


def scores(spark, strings):
    return spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.battery(F.col("s")).alias("t")).select("s", "t.*")


def test_against_plain_python(spark):
    rng = random.Random(2)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", secrets.ENCODINGS[-1][2], "aB"]
    strings = [draw(rng, rng.choice(alphabets), rng.randrange(20, 90)) for _ in range(60)] + [readable(rng, s) for s in ("letters", "camel", "digits", "snake") for _ in range(10)] + ["a" * 20, "A1" * 30]
    for r in scores(spark, strings).collect():
        assert r.z == pytest.approx(plain_score(r.s), abs=1e-6), r.s


@pytest.mark.parametrize("style", ["letters", "camel", "digits", "snake"])
def test_p_values_of_readable_strings(spark, style):
    """Not smaller than they say: at most a share of about alpha lies below alpha."""
    rng = random.Random(7)
    strings = [s for s in (readable(rng, style) for _ in range(3000)) if len(s) >= 20]
    found = scores(spark, strings)
    known = secrets.calibration(found)
    steps = [r.step for r in found.select(secrets.step(F.col("z"), F.col("group"), known).alias("step")).collect()]
    for alpha in (0.2, 0.1, 0.05, 0.01, 0.001):
        share = sum(10 ** (-s / secrets.STEPS) <= alpha for s in steps) / len(steps)
        assert share <= 1.5 * alpha + 3 * math.sqrt(alpha / len(steps)), (alpha, share)


def test_letters_alone(spark):
    rng = random.Random(3)
    lower, both = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    noise = [(k, f"key {draw(rng, lower if k % 2 else both, 80)} end") for k in range(60)]
    plain = [(1000 + k, f"see {readable(rng, 'letters')} and {readable(rng, 'camel')}") for k in range(1200)]
    got = {r.doc_id: r.n_random for r in secrets.digests(spark.createDataFrame(noise + plain, nasty.SCHEMA)).collect()}
    assert sum(got[k] > 0 for k, _ in noise) >= 50 and sum(got[k] > 0 for k, _ in plain) <= 6


def test_very_many_matches_in_one_text(spark):
    """10,000 patterns' matches and 10,000 strings to test in one text."""
    rng = random.Random(5)
    text = "\n".join(f"token=abcdef{k} {draw(rng, 'abcdefghij0123456789', 24)}" for k in range(10_000))
    df = spark.createDataFrame([(1, text)], nasty.SCHEMA)
    secrets.digests(df.limit(0)).collect()
    began = time.time()
    row = secrets.digests(df).first()
    assert row.n_assign == 10_000 and len(text) > 370_000
    assert time.time() - began < 30, time.time() - began
