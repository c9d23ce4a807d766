"""Repeated passages against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from loomlight.llm import repeats
from tests.llm.nasty import EXTRA, FIXED, SCHEMA, extra


def brute(rows, width):
    """Of each row: bytes, removed bytes, spans, sha256 of the rest."""
    last = float("inf")
    bodies = [((last if i is None else i), (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    least: dict = {}
    for i, b in bodies:
        for s in range(len(b) - width + 1):
            key = b[s : s + width]
            least[key] = min(least.get(key, last), i)
    out = []
    for (i, t), (rank, b) in zip(rows, bodies):
        gone, seen = np.zeros(len(b), bool), set()
        for s in range(len(b) - width + 1):
            key = b[s : s + width]
            if key in seen or least[key] < rank:
                gone[s : s + width] = True
            seen.add(key)
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def run(df, width):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.deduplicate(df, width).collect())


def corpus(seed, alphabet="ab c", passages=6, n=60):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.choice([71, 90, 99, 100, 101, 130, 260])) for _ in range(passages)]
    rows = []
    for k in range(n):
        parts = [rng.choice([word(rng.randrange(80)), rng.choice(shared), rng.choice(shared)[rng.randrange(40) :]]) for _ in range(rng.randrange(6))]
        rows.append((k, "".join(parts)))
    return rows


@pytest.mark.parametrize("width", [100, 75])
@pytest.mark.parametrize("rows", [1 << 16, 40])
def test_random(spark, monkeypatch, width, rows):
    monkeypatch.setattr(repeats, "BUCKET_ROWS", rows)
    data = corpus(width + rows, "abcdefghij é") + [(100 + k, t) for k, t in enumerate(FIXED)]
    data += [(7, data[3][1]), (200, data[3][1]), (8, data[8][1]), (8, data[9][1]), (None, data[9][1]), (None, None), (None, "z" * 300), (None, "z" * 300), (300, "ab" * 400), (301, "x" * 99 + "ab" * 80)]
    random.Random(1).shuffle(data)
    assert run(spark.createDataFrame(data, SCHEMA).repartition(3), width) == brute(data, width)


@pytest.mark.parametrize("seed", range(3))
def test_one_gram_over_several_buckets(spark, monkeypatch, seed):
    """A frequent passage in ever other surroundings: splitters cut its grams, strings are compared across them."""
    monkeypatch.setattr(repeats, "BUCKET_ROWS", 4)
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("xyz") for _ in range(k))
    tails, heads = [word(70) for _ in range(4)], [word(9) for _ in range(12)]
    data = [(k % 35, word(30) + rng.choice(heads) + "common passage of all documents, of some length: " * 2 + rng.choice(tails) + word(20)) for k in range(60)]
    used = []
    plain = repeats._splitters
    monkeypatch.setattr(repeats, "_splitters", lambda *a: used.append(plain(*a)) or used[-1])
    assert run(spark.createDataFrame(data, SCHEMA).repartition(5), 100) == brute(data, 100)
    assert any(len(c) > 37 for c in used[0])


def test_pieces_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_ROWS", 10)
    monkeypatch.setattr(repeats, "MAX_BUCKETS", 3)
    data = corpus(5, "abcdefghij", 4, 40)
    assert run(spark.createDataFrame(data, SCHEMA), 100) == brute(data, 100)


def test_long_texts(spark, monkeypatch):
    """Texts longer than what is hashed at once, periodic ones too."""
    monkeypatch.setattr(repeats, "_STEP", 256)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdef") for _ in range(3000))
    data = [(1, long), (2, long[500:1700] + "!" + long[100:400]), (3, "ab" * 700 + long[2000:2300]), (4, "ab" * 60), (5, "abc" * 500), (6, "a" * 5000)]
    assert run(spark.createDataFrame(data, SCHEMA), 100) == brute(data, 100)


def test_edges(spark):
    assert run(spark.createDataFrame([], SCHEMA), 100) == []
    data = [(k, t) for k, t in enumerate(FIXED)] + [(None, "q" * 150), (3, "q" * 150)]
    assert run(extra(spark, data), 100) == run(spark.createDataFrame(data, SCHEMA), 100) == brute(data, 100)
    assert EXTRA.startswith(SCHEMA)
    with pytest.raises(ValueError):
        repeats.deduplicate(spark.createDataFrame([], SCHEMA), 70)


def test_text_that_is_left(spark):
    data = [(1, "0123456789" * 10 + "one"), (2, "two" + "0123456789" * 10 + "three"), (3, "short"), (4, "0123456789" * 10 + "one"), (5, None)]
    got = {r.doc_id: (bytes(r.kept), [(s.begin, s.end) for s in r.spans]) for r in repeats.deduplicate(spark.createDataFrame(data, SCHEMA), keep_text=True).collect()}
    assert got == {1: (data[0][1].encode(), []), 2: (b"twothree", [(3, 103)]), 3: (b"short", []), 4: (b"", [(0, 103)]), 5: (b"", [])}


def test_multikey_sort():
    rng = random.Random(4)
    values = [bytes(rng.choice(b"ab") for _ in range(rng.choice([3, 17, 24]))).ljust(24, b"\0") for _ in range(300)]
    order, shared = repeats.multikey_sort(repeats._matrix(values, 24))
    got = [values[k] for k in order]
    assert got == sorted(values)
    assert shared.tolist() == [0] + [next((k for k in range(24) if a[k] != b[k]), 24) for a, b in zip(got, got[1:])]
