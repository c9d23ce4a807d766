"""Judged answers, fallbacks as a whole, exact draws, names for groups of concepts."""

from pyspark.sql import functions as F

from loomlight.operators import judged, ontology

ROWS = "id long, contexts array<string>, answer string, ground_truth string"


def judge():
    return lambda p, h: [("ENTAILMENT", 0.8) if y in x else ("NEUTRAL", 0.9) if y[:1] == x[:1] else ("CONTRADICTION", 0.7) for x, y in zip(p, h)]


def broken():
    def fail(p, h):
        raise ValueError("the model is away")

    return fail


def embed(text):
    n = F.length(F.coalesce(text, F.lit(""))).cast("double")
    return F.array(n, F.lit(1.0))


def rows(spark):
    return spark.createDataFrame([(1, ["a b", "c"], "b c", "b"), (2, ["x"], "xy", "xz"), (3, [], "q", "q"), (4, ["k"], None, "m")], ROWS)


def test_faithfulness(spark):
    got = {r.id: round(r.faithfulness, 6) for r in judged.faithfulness(rows(spark), judge).collect()}
    assert got == {1: 0.8, 2: 0.5, 3: 0.3, 4: 0.8}


def test_correctness_and_its_fallback(spark):
    cos = lambda a, b: (a * b + 1) / ((a * a + 1) ** 0.5 * (b * b + 1) ** 0.5)
    alike = {1: cos(3, 1), 2: 1.0, 3: 1.0, 4: cos(0, 1)}
    facts = {1: 0.4, 2: 0.0, 3: 0.8, 4: 0.4}
    got = judged.correctness(rows(spark), embed, judge).collect()
    assert {r.id: round(r.correctness, 6) for r in got} == {k: round(0.6 * alike[k] + 0.4 * facts[k], 6) for k in alike}
    assert {(r.served_by, r.degraded) for r in got} == {("entailment", False)}
    got = judged.correctness(rows(spark), embed, broken).collect()
    assert {r.id: round(r.correctness, 6) for r in got} == {k: round(v, 6) for k, v in alike.items()}
    assert {(r.served_by, r.degraded) for r in got} == {("semantic", True)}


def test_draws_are_exact_and_do_not_depend_on_partitions(spark):
    kinds = ["basic"] * 50 + ["intermediate"] * 3 + ["advanced"] * 20 + ["odd"] * 5 + [None]
    q = spark.createDataFrame([(k, kind, 0.5 + (k % 5) / 10) for k, kind in enumerate(kinds)], "item_id long, complexity string, sure double")
    draw = lambda df, **x: sorted((r.complexity, r.item_id) for r in judged.balanced(df, 21, **x).collect())
    got = draw(q)
    assert [sum(c == kind for c, _ in got) for kind in ("basic", "intermediate", "advanced")] == [8, 3, 4] and len(got) == 15
    assert draw(q.repartition(7)) == got and draw(q, seed=8) != got
    sure = draw(q, confidence="sure", least=0.7)
    assert all(0.5 + (i % 5) / 10 >= 0.7 for _, i in sure) and sum(c == "basic" for c, _ in sure) == 8
    assert draw(q.where("item_id < 0")) == []


def test_mappings(spark):
    concepts = [
        (1, "Heart attack event", ["MI", None], "disorder"), (2, "Cardiac event", None, "disorder"), (3, "heart failure", ["HF"], "disorder"), (4, "Failure of heart", [], "disorder"),
        (5, "B2", ["vitamin"], "trace_element"), (6, None, ["x"], "disorder"), (7, "Failing heart event x", ["mi"], None),
    ]
    df = spark.createDataFrame(concepts, "id long, label string, synonyms array<string>, type string")
    got = {r.entity_type: r.terms for r in ontology.mappings(df).collect()}
    assert got == {
        "EVENT": ["cardiac event", "heart attack event", "mi"],
        "HEART": ["failure of heart", "heart failure", "hf"],
        "TRACE_TYPE_ELEMENT": ["b2", "vitamin"],
        "FAILING": ["failing heart event x", "mi"],
    }
    assert ontology.mappings(df.where("id < 0")).collect() == []
