"""Fingerprints and components against a comparison of all pairs."""

import random
import re

import numpy as np
import xxhash

from loomlight.llm import copies, simhash
from tests.llm import nasty


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(keys, values):
    """component of each value: the least key reachable over values at 4 or fewer bits."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k in range(len(values)):
        if keys[k] is not None:
            least[find(k)] = min(least.get(find(k), keys[k]), keys[k])
    return [least.get(find(k)) for k in range(len(values))]


def test_documents(spark):
    rng = random.Random(2)
    rows = nasty.rows(40)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)) for n in (3, 5, 60, 200, 400)]
    for k in range(80):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["Q", "new", "word"])
        rows.append((300 + k, " ".join(w)))
    got = simhash.near_duplicates(nasty.extra(spark, rows)).collect()
    fps = [fingerprint(t) for _, t in rows]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, _), f, c in zip(rows, fps, grouped([d for d, _ in rows], fps)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], nasty.SCHEMA)).collect() == []


def planted(seed, n):
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for f in list(out)[: n // 2]:
        for _ in range(rng.randrange(4)):
            f ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))})
            out.add(f)
    return list(out)


def test_links_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    fps = planted(3, 400) + [0, (1 << 64) - 1, 1 << 63]
    core = 0x123456789ABCDEF0
    fps = list({*fps, *(core ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a))})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = grouped(list(range(len(fps))), fps)
    mine = [roots.get(s, s) for s in signed]
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_gray_rank_orders_codes():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_one_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(4, text), (2, text), (9, text.upper()), (7, "something else entirely here now"), (None, "kept without an id at all")]
    df = spark.createDataFrame(rows, nasty.SCHEMA)
    assert sorted(str(r.doc_id) for r in copies.keep_one(df).collect()) == ["2", "7", "None"]
