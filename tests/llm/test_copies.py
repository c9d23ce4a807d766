"""Near-duplicates of the pipeline against a comparison of all pairs."""

import random

import corpus_pipeline
from loomlight.llm import copies, simhash
from tests.llm import nasty


def shingled(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """ids left where one of each component stays."""
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    gone = {d for (d, _), r in zip(rows, root) if d is not None and d != least[r]}
    return sorted((str(d), str(t)) for d, t in rows if d not in gone)


def edited():
    """Texts with a few words replaced, from nearly equal ones to those below the bound, and chains of them."""
    rng = random.Random(4)
    rows = nasty.rows(20)
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 80, 300]))]
        rows.append((1000 + 100 * k, " ".join(words)))
        for j in range(1, 12):
            if j > 6:
                words = list(words)
            copy = words if j > 6 else list(words)
            for _ in range(rng.choice([0, 1, 2, 3, len(words) // 60, len(words) // 40])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(5000)}"
            rows.append((1000 + 100 * k + j, " ".join(copy)))
    return rows


def test_stage_against_all_pairs(spark):
    rows = edited()
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, nasty.extra(spark, rows), "")
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == kept(rows)
    assert copies.keep_one(spark.createDataFrame([], nasty.SCHEMA)).collect() == []


def test_near_copy_that_fingerprints_miss(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    near = next(c for c in iter(lambda: [w if rng.random() > 0.02 else w + "x" for w in words], None) if len(shingled(" ".join(c)) & shingled(" ".join(words))) >= 0.8 * len(shingled(" ".join(c)) | shingled(" ".join(words))) and c != words and (simhash.fingerprint(" ".join(c)) ^ simhash.fingerprint(" ".join(words))).bit_count() > 4)
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "another text")]
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, nasty.SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_texts_of_the_same_words_do_not_all_meet(spark, monkeypatch):
    """Equal fingerprints, unlike shingles: no pair leaves a task, and copies among them are still found."""
    rng, words, seen = random.Random(7), [f"word{k}" for k in range(40)], []
    rows = []
    for k in range(400):
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    changed = [t.split() for _, t in rows[:20]]
    for t in changed:
        t[0], t[-1] = "first", "last"  # 34 of 38 shingles stay
    rows += [(1000 + k, " ".join(t)) for k, t in enumerate(changed)]
    plain = copies._meeting
    monkeypatch.setattr(copies, "_meeting", lambda *a: seen.append(copies.cut(plain(*a))) or seen[-1])
    found = {r.doc_id: r.component_id for r in copies.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[1000 + k] == k for k in range(20)) and all(found[k] == k for k in range(400))
    assert 0 < seen[0].count() <= 40
