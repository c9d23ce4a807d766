"""Many terms in texts, by automaton and by join, against Python's `in`."""

import random

import pytest
from pyspark.sql import functions as F

from loomlight.operators import common, terms


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_terms_in_texts(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abC é") for _ in range(n))
    texts = [(k, word(rng.randrange(120))) for k in range(60)] + [(60, None), (61, ""), (62, "aba"), (62, "aba")]
    names = [(k, word(rng.choice([1, 2, 5, 6, 7, 9]))) for k in range(50)] + [(50, ""), (51, None), (52, "aba"), (53, "ABA"), (52, "aba")]
    want = sorted((i, k) for i, t in texts for k, n in names if t is not None and n and n.lower() in t.lower())
    found = terms.holding(spark.createDataFrame(texts, "doc long, text string").repartition(3), spark.createDataFrame(names, "id long, term string"))
    assert sorted((r.doc, r.id) for r in found.collect()) == want and found.columns == ["doc", "text", "id", "term"]


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_no_terms_or_texts(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    texts, names = spark.createDataFrame([(1, "a")], "doc long, text string"), spark.createDataFrame([(1, "a")], "id long, term string")
    assert terms.holding(texts.limit(0), names).collect() == [] and terms.holding(texts, names.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["entity_match", "onto_extract", "onto_expand", "query_insights", "pipe_reasoned"])
def test_no_nested_loops(spark, sf, name):
    from loomlight import plans

    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
