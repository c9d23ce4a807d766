"""Hits against a search of every window at every place."""

import hashlib
import random
import re
import tracemalloc

from loomlight.llm import decontaminate
from tests.llm import nasty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, items string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, named = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    named |= found
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    got = decontaminate.digests(spark.createDataFrame(docs, nasty.SCHEMA), spark.createDataFrame([(*r, "z") for r in items], ITEMS))
    return sorted((tuple(r)[:6] for r in got.collect()), key=str)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "é", "ñandú", "x1", "Zed"]
    line = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.choice([1, 2, 3, 8, 9, 10, 11, 25]))) for k in range(12)] + [(3, line(15)), (None, line(12)), (50, None), (51, ""), (52, "!!!")]
    items[0] = (0, "solo")
    docs = [(k, line(rng.randrange(40))) for k in range(40)]
    for k in range(40, 90):
        docs.append((k, f"{line(rng.randrange(30))} {rng.choice(items)[1] or ''} {line(rng.randrange(20))} {rng.choice(['', 'SOLO', 'solo solo'])}"))
    return docs + nasty.rows(20), items


def test_random_cases(spark, monkeypatch):
    for seed in range(3):
        docs, items = cases(seed)
        assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)
    docs, items = cases(7)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_pipeline_stage(spark):
    docs, items = cases(1)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])
    bad = {r[0] for r in brute(docs, items) if r[5]}
    kept = decontaminate.decontaminate(nasty.extra(spark, docs), spark.createDataFrame([(*r, "z") for r in items], ITEMS))
    clean = sorted((d for d, n, h, *_ in brute(docs, items) if not h), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == clean and bad
    assert kept.columns == nasty.extra(spark, docs).columns and {r.n_words for r in kept.collect()} == {"z"}


def test_hashing_holds_a_few_times_the_text(monkeypatch):
    """Two executors' workers at once hold what a shard takes; hashes are those of one word alone, in passes of any size and for words longer than a pass."""
    text = "Número uno, two 3 " * (1 << 17)
    decontaminate._powers.cache_clear()
    tracemalloc.start()
    hashes, counts, data, at, ends = decontaminate.words([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [4 << 17] and len(set(hashes.tolist())) == 4
    assert peak < 24 * len(data)

    texts = ["ab " * 9 + "z" * 40, None, "", "z" * 40 + " z " + "ñ" * 21, "!!", "ab", "z" * 16 + "," + "z" * 17]
    whole = decontaminate.words(texts)
    alone = {w: int(decontaminate.words([w])[0][0]) for t in texts for w in words(t)}
    assert len(set(alone.values())) == len(alone)
    for size in (1, 3, 16, 17, 1000):
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        decontaminate._powers.cache_clear()
        got = decontaminate.words(texts)
        assert got[0].tolist() == whole[0].tolist() == [alone[w] for t in texts for w in words(t)]
        assert all((a == b).all() for a, b in zip(got[1::2], whole[1::2])) and (got[4] == whole[4]).all()
    decontaminate._powers.cache_clear()


def test_a_kept_text_goes_to_the_workers_once(spark):
    docs, items = cases(2)
    docs, items = spark.createDataFrame(docs, nasty.SCHEMA), spark.createDataFrame([(*r, "z") for r in items], ITEMS)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "_text" not in plan(decontaminate.contamination(docs, items)) and "_text" in plan(decontaminate.contamination(docs, items, keep=["doc_id"]))
    both = [sorted(map(str, decontaminate.contamination(docs, items, keep=k).drop("text").collect())) for k in (["doc_id", "text"], ["doc_id"])]
    assert both[0] == both[1]
    assert "_text" not in plan(decontaminate.decontaminate(docs, items))
