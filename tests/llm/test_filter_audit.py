"""The audit against plain Python that applies every order to every document."""

import random
from itertools import permutations

import pytest

from loomlight.llm import filter_audit
from tests.llm.nasty import FIXED

DOCS = "doc_id long, text string, lang string, mask string, n string, part string"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    last, out = float("inf"), []
    rank = lambda i: last if i is None else i
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))

    def fails(i, t):
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        yield "A", len(words) < 100
        yield "B", 100 * len(set(words)) < 80 * len(words)
        yield "C", 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)
        yield "D", any(c in "#$%&*|" for c in t)
        yield "E", any((o or "") == t and rank(j) < rank(i) for j, o, _ in docs)

    failed = [{f for f, bad in fails(i, t) if bad} for i, t, _ in docs]
    for part in {x or "" for _, _, x in docs}:
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [k for k, (_, _, x) in enumerate(docs) if (x or "") == part]
            every = list(left)
            for step, f in enumerate(order):
                gone = [k for k in left if f in failed[k]]
                left = [k for k in left if f not in failed[k]]
                redundant = sum(f in failed[k] for k in every) - len(gone)
                shapley[f] += len(gone)
                rows.append((part, "".join(order), step + 1, len(left), len(gone), redundant, sum(failed[k] == {f} for k in every), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def run(spark, docs, labels, **more):
    df = spark.createDataFrame([(*r, "z", "z", "z") for r in docs], DOCS).repartition(4)
    found = filter_audit.audit(df, spark.createDataFrame([(*r, "z") for r in labels], LABELS), **more).collect()
    return sorted((r.part, r.filter_order, r.step, r["kept"], r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found)


def sample(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["UPPER", "a#b", "50%"]
    texts = FIXED + [" ".join(rng.choice(words[: rng.choice([60, 403])]) for _ in range(rng.choice([30, 99, 100, 101, 150]))) for _ in range(30)] + ["AB cdefgh ijklmnop q", "A bcdefghi"]
    docs = [(k if k % 13 else k // 2, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(150)]
    docs += [(None, t, "en") for t in texts[:30]] + [(None, texts[40], "fr")] * 3 + [(5, docs[5][1], "it")] * 2
    labels = [(rng.randrange(170), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    rng.shuffle(docs)
    return docs, labels


@pytest.mark.parametrize("fingerprint", [None, lambda body: len(body) % 3])
def test_random(spark, monkeypatch, fingerprint):
    """Also with many texts on one hash, and with tables that are handed on again and again."""
    docs, labels = sample(1)
    if fingerprint:
        monkeypatch.setattr(filter_audit, "CHUNK_BYTES", 3000)
    assert run(spark, docs, labels, **({"fingerprint": fingerprint} if fingerprint else {})) == brute(docs, labels)


def test_few(spark):
    assert run(spark, [], []) == []
    docs = [(1, None, None)]
    assert run(spark, docs, []) == brute(docs, [])
    assert len(run(spark, docs, [])) == 600


def test_a_frequent_text_is_routed_once_a_task(spark):
    rows = spark.sparkContext.parallelize([(b"same", (k, "", 0)) for k in range(1000)], 5)
    found = filter_audit.repeats(rows, 3).collect()
    assert len(found) == 1000 and [r for r, again, _ in found if not again] == [(0, "", 0)]
    chains = filter_audit.Chains(len)
    losers = [x for k in range(1000) for x in chains.add(b"same", {(k, "", 0): 1})]
    assert len(losers) == 999 and len(list(chains.close())) == 1
