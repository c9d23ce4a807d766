"""The longest verbatim match of each document against every place of every item; blocks, shards and repeats; the registered SQL."""

import random
import time

import duckdb
import pytest

from loomlight.llm import decontaminate, queries
from tests.llm import nasty
from tests.llm.test_decontaminate import ITEMS, cases, words


def brute(docs, items):
    """doc_id, words, first word and item of the longest match that holds a window."""
    out = []
    for d, t in docs:
        w, best = words(t), (0, None, None)
        for i, text in items:
            v = words(text)
            if i is None or not v:
                continue
            for a in range(len(w)):
                for b in range(len(v) if len(v) >= 10 else 1):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n >= min(10, len(v)):
                        best = min(best, (n, a, str(i)), key=lambda m: (-m[0], -1 if m[1] is None else m[1], m[2] or ""))
        out.append((d, *best))
    return sorted(out, key=str)


def run(spark, docs, items):
    got = decontaminate.digests(spark.createDataFrame(docs, nasty.SCHEMA), spark.createDataFrame([(*r, "z") for r in items], ITEMS))
    return sorted(((r.doc_id, r.longest, r.longest_at, r.longest_item) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", [0, 5])
@pytest.mark.parametrize("small", [False, True])
def test_longest(spark, monkeypatch, seed, small):
    docs, items = cases(seed)
    if small:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)
    assert run(spark, docs, items) == brute(docs, items)


def test_neighbouring_items_do_not_join(spark):
    one, other = " ".join(f"a{k}" for k in range(10)), " ".join(f"b{k}" for k in range(10))
    long = " ".join(f"c{k}" for k in range(40))
    docs = [(1, f"{one} {other}"), (2, f"x {long} y {one}"), (3, f"c0 c1 {long[6:]}"), (4, " ".join(f"c{k}" for k in range(5, 25)) + f" {one}")]
    items = [(7, one), (8, other), (9, long), (10, long)]
    assert run(spark, docs, items) == [(1, 10, 0, "7"), (2, 40, 1, "10"), (3, 40, 0, "10"), (4, 20, 0, "10")]


def test_equal_hashes_are_not_equal_words(spark):
    """Thue-Morse words collide in any polynomial hash modulo 2**64."""
    bits = [k.bit_count() & 1 for k in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    assert run(spark, [(1, a), (2, b), (3, f"{b} {a}")], [(5, a)]) == [(1, 1, 0, "5"), (2, 0, None, None), (3, 1, 1, "5")]
    assert run(spark, [(1, a), (2, b)], [(5, a), (6, b)]) == [(1, 1, 0, "5"), (2, 1, 0, "6")]


def test_very_long_and_repeated_texts(spark):
    item = " ".join(f"w{k % 7}" for k in range(300))
    docs = [(k, item) for k in range(60)] + [(99, "w0 " * 20_000), (100, " ".join([item] * 40))]
    got = {r.doc_id: r for r in decontaminate.digests(spark.createDataFrame(docs, nasty.SCHEMA), spark.createDataFrame([(1, item, "z")], ITEMS)).collect()}
    assert all((got[k].longest, got[k].n_hit) == (300, 300) for k in range(60)) and got[99].n_hit == 0 and got[100].longest == 300


def test_periodic_texts_take_no_longer():
    for word in ("a ", "a b "):
        text = word * 20_000
        began = time.time()
        shard = decontaminate.Shard([text, text[2:] + "x"])
        shard.search(decontaminate.Benchmark([("7", text), ("5", text[: len(text) // 2])]))
        assert time.time() - began < 10
        n = len(text.split())
        assert shard.longest == [(n, 0, "7"), (n - 1, 0, "7")] and shard.hit[:-1].all()


def test_runs_of_few_words(spark):
    rng = random.Random(4)
    for _ in range(3):
        make = lambda n: " ".join(rng.choices("ab", (1, 4), k=n))
        items = [(k, make(rng.randrange(1, 40))) for k in range(6)] + [(6, "b " * 30), (7, "b " * 12)]
        docs = [(k, make(rng.randrange(0, 90))) for k in range(30)] + [(50, "b " * 50), (51, "c " + "b " * 11)]
        assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("at_once", [1, 3])
def test_blocks_are_read_once_for_several_shards(spark, monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)
    monkeypatch.setattr(decontaminate, "SHARDS", at_once)
    docs, items = cases(2)
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("name", ["op5_exact_top_k", "op8_warc", "op9_decontamination"])
def test_registered_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)
