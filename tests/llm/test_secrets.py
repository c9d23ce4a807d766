"""Secret spans against Python's own matching; the randomness tests on strings of both kinds."""

import base64
import hashlib
import random
import re

from loomlight.llm import secrets
from tests.llm import nasty

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in spans)


def samples(seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(150):
        secret = rng.choice([
            f"password = '{rng.randbytes(9).hex()}'", f'"api_key": "{base64.b64encode(rng.randbytes(12)).decode()}"', f"AKIA{''.join(rng.choices('ABCDEFGHIJ234567', k=16))}", rng.randbytes(20).hex(), "token: short", "SECRET=abc.def-ghi",
            "AKIAAKIA" + "Q" * 12, "passwordtoken:abcdef", "secret secret: 🙂abcdef", "apikey:" + " " * 9 + "x" * 30,
        ])
        out.append(f"{rng.choice(['', 'é🙂 ', 'plain words '])}{secret}{rng.choice(['', ' end', chr(10) + 'é', secret])}")
    return out


def test_base_spans(spark):
    rows = nasty.rows(40) + [(1000 + k, t) for k, t in enumerate(samples())] + [(5000, "secret=abcdefg " * 700)]
    got = secrets.digests(spark.createDataFrame(rows, nasty.SCHEMA)).collect()
    want = sorted((str(i), hashlib.sha256(listed(base(t)).encode()).hexdigest(), *(sum(k == kind for _, k, _ in base(t)) for kind in range(3))) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == want
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        assert hashlib.sha256(",".join(s for s in spans if not s.startswith("random")).encode()).hexdigest() == r.base_sha256


def test_random_strings_are_found_and_readable_ones_left(spark):
    rng = random.Random(9)
    draw = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=k))
    noise = [(k, f"value {draw(rng.choice([24, 32, 48, 90]))} end") for k in range(60)]
    words = ["getUserName", "parse_config_file", "default-timeout", "customer_address", "content-length", "index", "handler", "version"]
    plain = [(1000 + k, " ".join("_".join(rng.choices(words, k=3)) + str(rng.randrange(30)) for _ in range(4))) for k in range(60)]
    long = [(3000, "a" * 600 + "1" + draw(40))]
    got = {r.doc_id: r for r in secrets.digests(spark.createDataFrame(noise + plain + long, nasty.SCHEMA)).collect()}
    assert sum(got[k].n_random > 0 for k, _ in noise) >= 54
    assert sum(got[k].n_random > 0 for k, _ in plain) <= 2


def test_false_discovery_rule(spark):
    rows = [("g", s) for s in [95] * 5 + [74] * 2 + [30] * 3 + [3] * 50 + [0] * 200]
    m = len(rows)
    p = sorted(10 ** (-s / 20) for _, s in rows)
    accepted = max((k + 1 for k, x in enumerate(p) if x <= 0.01 * (k + 1) / m), default=0)
    least = secrets.thresholds(spark.createDataFrame([(1, s) for _, s in rows], "group int, step int")).get(1)
    assert sum(s >= least for _, s in rows) == accepted == 7


def test_empty_and_clashing(spark):
    assert secrets.digests(spark.createDataFrame([], nasty.SCHEMA)).collect() == []
    data = nasty.rows(10)
    assert secrets.digests(nasty.extra(spark, data)).count() == len(data)
