"""Operators beyond their registered queries: arguments, edges, and results that SQL doesn't check."""

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.functions import vectors as V
from loomlight.operators import chunks, entities, evaluation, fusion, graph, late, lexical, ontology, pipelines, search, serving
from loomlight.sources import documents, store
from loomlight.streaming import streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges(spark, pairs):
    return frame(spark, [(a, "p", b, float(w)) for a, b, *r in pairs for w in (r or [1])], "src string, pred string, dst string, w double")


# vectors -------------------------------------------------------------------------------------


def test_distances_of_zero_and_null_vectors(spark):
    df = frame(spark, [([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(V.cosine("a", "b"), V.distance("a", "b", "l2"), V.distance("a", "b", "unknown"), V.similarity("a", "b", "l1")).collect()
    assert rows[0][0] == 0.0 and rows[1][0] == pytest.approx(1.0) and rows[1][1] == 0.0 and rows[1][2] == pytest.approx(0.0) and rows[2][0] is None


def test_batched_equals_plain_and_survives_empty_queries(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = search.query_of(v, F.col("vec_id") % 50 == 0)
    plain = {(r.query_id, r.vec_id) for r in search.nearest(v, q, 5).collect()}
    assert {(r.query_id, r.vec_id) for r in search.nearest_batched(v, q, 5, block=3).collect()} == plain
    assert search.nearest_batched(v, q.limit(0), 5).collect() == []


@pytest.mark.parametrize("kind", ["kmeans", "lsh", "forest"])
def test_approximate_search_finds_most_neighbours(spark, sf, kind):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = search.query_of(v, F.col("vec_id") % 50 == 0)
    if kind == "kmeans":
        listed, cells = search.kmeans_cells(v, 8)
        found = search.ivf_search(listed, cells, q, 5, 6)
    elif kind == "lsh":
        found = search.lsh_search(v, q, 5, bucket=1.5)
    else:
        planes = search.projection_planes(64, 3, 12)
        found = search.forest_search(v, search.projection_leaves(v, planes), q, planes, 5)
    share = search.recall(search.nearest(v, q, 5), found).agg(F.avg("recall")).first()[0]
    assert share > 0.6


def test_dimensions_are_checked(spark):
    v = frame(spark, [(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    search.check_dimension(v, search.query_of(v, F.lit(True)))
    with pytest.raises(ValueError):
        search.check_dimension(v, frame(spark, [(1, [1.0])], "query_id long, query array<float>"))


def test_recommended_cells(spark):
    got = frame(spark, [(25600,), (102400,), (204800,), (400,), (16000000,), (3,)], "n long").select(late.recommended_cells(F.col("n"))).collect()
    assert [r[0] for r in got] == [64, 256, 512, 16, 4096, 1]


# texts ---------------------------------------------------------------------------------------


def test_query_variants(spark):
    asked = [("What is diabetes?",), ("how to treat pain",), ("why do we",), ("list drugs",), ("the show",), (None,)]
    got = [r[0] for r in frame(spark, asked, "q string").select(X.query_variants("q")).collect()]
    assert got[0] == ["What is diabetes?", "diabetes overview", "diabetes details", "list of diabetes"]
    assert got[1][1] == "treat pain methods" and got[2][1] == "do we reasons" and got[3][1] == "list drugs overview" and got[4][1] == "the s methods" or got[4][1].endswith("methods")


def test_empty_texts(spark):
    row = frame(spark, [(None,), ("",)], "t string").select(X.density("t"), X.readability("t"), F.size(X.sentences("t")), F.size(X.words("t")), X.token_estimate("t")).collect()
    assert [tuple(r) for r in row] == [(0.0, 0.0, 0, 0, 0)] * 2


def test_lenient_array(spark):
    got = [r[0] for r in frame(spark, [('x ["a", "b"] y',), ("a, b",), ("[broken, c",), (None,)], "t string").select(X.lenient_array("t")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["broken", "c"], []]


def test_bm25_counts_repeated_query_tokens(spark):
    docs = frame(spark, [(1, "apple pear"), (2, "apple apple fig"), (3, ""), (4, None), (5, "plum")], "doc_id long, text string")
    bag = lexical.bags(docs)
    assert lexical.statistics(bag).first().n == 3
    score = lambda q: {r.key: r.score for r in lexical.search(bag, lexical.asked(frame(spark, [(0, q)], "i long, t string"), "i", "t"), 5).collect()}
    once, twice = score("apple"), score("apple Apple")
    assert set(once) == {1, 2} and all(twice[k] == pytest.approx(2 * once[k]) for k in once)
    assert score("nothing") == {}


# fusion --------------------------------------------------------------------------------------


def test_rerank_survives_a_failing_model(spark):
    df = frame(spark, [(k, k, "q", f"t{k}") for k in range(1, 6)], "id long, rank int, query string, text string")

    def broken():
        raise RuntimeError("no model")

    def by_length():
        return lambda q, t: [float(x[1:]) for x in t]

    def sometimes():
        def score(q, t):
            if "t5" in t:
                raise ValueError("not this one")
            return [float(x[1:]) for x in t]

        return score

    said = lambda found: [(r.id, r.rerank_score, r.served_by, r.degraded) for r in found.collect()]
    assert said(fusion.rerank(df, broken, 3)) == [(k, None, "order", True) for k in (1, 2, 3)]
    assert said(fusion.rerank(df, by_length, 2, factor=2)) == [(4, 4.0, "model", False), (3, 3.0, "model", False)]
    # a model that fails for one row, in a task of its own, is given up for all
    assert said(fusion.rerank(df.repartition(5), sometimes, 2, factor=5)) == [(k, None, "order", True) for k in (1, 2)]


def test_embedders_in_turn(spark):
    from loomlight.operators import models

    rows = frame(spark, [(k, f"t{k}") for k in range(40)], "id long, text string").repartition(4)

    @F.pandas_udf("array<double>")
    def fails(t: pd.Series) -> pd.Series:
        if "t7" in t.tolist():
            raise RuntimeError("no model for this")
        return pd.Series([[0.0]] * len(t))

    built_in = lambda c: F.array(F.length(c).cast("double"))
    found = models.embedded(rows, {"remote": fails, "hash": built_in}).collect()
    assert {(r.served_by, r.degraded) for r in found} == {("hash", True)} and {r.embedding[0] for r in found} == {2.0, 3.0}
    assert {(r.served_by, r.degraded) for r in models.embedded(rows.where("id <> 7"), {"remote": fails, "hash": built_in}).collect()} == {("remote", False)}
    with pytest.raises(ValueError):
        models.first_whole({})


def test_pipeline_arguments():
    pipelines.check("q", 5, "rrf", (0.5, 0.5))
    for bad in (("", 5), ("q", 0), ("q", 101), ("q", 5, "other"), ("q", 5, "text", (1.0,))):
        with pytest.raises(ValueError):
            pipelines.check(*bad)


def test_corrective_states(spark):
    state = lambda *s: pipelines.evaluated(frame(spark, [(x,) for x in s], "score double")).first().state
    assert state(0.9, 0.7) == "confident" and state(0.7, 0.1) == "ambiguous" and state(0.5, 0.5) == "ambiguous" and state(0.3) == "disoriented" and state() == "disoriented"


# graphs --------------------------------------------------------------------------------------


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    ids = [f"n{k:03d}" for k in range(120)]
    rng.shuffle(ids)
    pairs = list(zip(ids[:70], ids[1:70])) + list(zip(ids[70:119], ids[71:120]))
    got = {r.node: r.component for r in graph.components(edges(spark, pairs)).collect()}
    assert {got[i] for i in ids[:70]} == {min(ids[:70])} and {got[i] for i in ids[70:]} == {min(ids[70:])}


def test_dijkstra_on_a_random_graph(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}", rng.choice([0, -1, 1, 2.5, 4])) for _ in range(60)]
    best = {"n0": 0.0}
    for _ in range(20):
        for a, b, w in pairs:
            if a in best and best[a] + (w if w > 0 else 1) < best.get(b, math.inf):
                best[b] = best[a] + (w if w > 0 else 1)
    found = graph.dijkstra(edges(spark, pairs), "n0")
    assert {r.node: r.cost for r in found.collect()} == best
    far = max(best, key=best.get)
    way = graph.backtrack(found, far)
    assert way[0][0] == "n0" and way[-1][0] == far and way[-1][2] == best[far]
    assert graph.backtrack(found, "nowhere") == []


def test_paths_cycles_and_limits(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a"), ("c", "e")])
    paths = lambda *x: sorted(r.path for r in graph.shortest_paths(e, *x).collect())
    assert paths("a", "e", 5) == [["a", "b", "c", "e"], ["a", "d", "c", "e"]]
    assert paths("a", "a", 3) == [["a"]] and paths("a", "e", 2) == [] and paths("e", "a", 9) == []
    one = frame(spark, [("a",)], "node string")
    assert {r.dst: r.step for r in graph.bfs(e, one, 9).collect() if r.src == "c"} == {"a": 3, "e": 3}
    assert graph.khop(e, one, 1, "in").where("hop = 1").first().node == "c"
    assert graph.bfs(e, one, 2, targets=frame(spark, [("b",)], "node string")).count() == 1


def test_pagerank_settles_and_walks_repeat(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")])
    ranks = {r.node: r.score for r in graph.pagerank(e, rounds=50).collect()}
    assert ranks["a"] > ranks["b"] == pytest.approx(ranks["c"]) and sum(ranks.values()) == pytest.approx(1.0, abs=1e-3)
    one = frame(spark, [("a",)], "node string")
    w = lambda: sorted(tuple(r) for r in graph.random_walks(e, one, 3, 4).collect())
    assert w() == w() and len(w()) == 15
    assert graph.pagerank(e.limit(0)).collect() == []


# events and statistics -----------------------------------------------------------------------


def test_bootstrap_holds_the_mean(spark):
    df = spark.range(2000).select(F.lit("g").alias("g"), "id", (F.col("id") % 100).cast("double").alias("x"))
    r = evaluation.bootstrap(df, "g", "x", "id", resamples=300).first()
    assert r.low < 49.5 < r.high and 1.5 < r.high - r.low < 4
    assert evaluation.bootstrap(df.repartition(5), "g", "x", "id", resamples=300).first().low == pytest.approx(r.low)


def test_passes_keep_keys_apart(spark):
    rows = [(k % 3 if k % 7 else None, k, 10 + k % 5) for k in range(200)]
    got = serving.token_batches(frame(spark, rows, "key long, id long, tokens int"), "key", "tokens", "id", 40).collect()
    want, state = {}, {}
    for key, i, t in rows:
        b, used = state.get(key, (0, 0))
        b, used = (b + 1, 0) if used and used + t > 40 else (b, used)
        state[key] = (b, used + t)
        want[i] = b
    assert {r.id: r.batch for r in got} == want


def test_rolled_up(spark):
    df = frame(spark, [("x", "healthy"), ("x", "degraded"), ("y", "healthy"), ("z", "unavailable"), ("z", "degraded")], "k string, status string")
    assert {r.k: r.status for r in serving.rolled_up(df, ("k",)).collect()} == {"x": "degraded", "y": "healthy", "z": "unavailable"}


# chunks --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(chunks.STRATEGIES))
def test_chunks_cover_texts(spark, name):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "However", "gamma"]) for _ in range(rng.randrange(3, 30))) + rng.choice([". ", "! ", "? "])
    rows = [(k, "".join(sentence() for _ in range(n)).strip()) for k, n in enumerate((1, 2, 9, 80, 400))] + [(9, ""), (10, None), (11, "x" * 3000), (12, "." * 3000)]
    got = {}
    for r in chunks.chunk(frame(spark, rows, "doc_id long, text string"), name).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert 9 not in got and 10 not in got
    for doc, text in rows[:5]:
        assert [r.n for r in got[doc]] == list(range(len(got[doc])))
        inside = set(text.split())
        assert all(set(r.text.split()[1:-1]) <= inside for r in got[doc])
        if name in ("fixed", "basic"):
            assert all(r.text == text[r.start : r.finish].strip() for r in got[doc])
            assert all(b.start <= a.finish for a, b in zip(got[doc], got[doc][1:]))


def test_short_texts_can_stay_whole(spark):
    df = frame(spark, [(1, "a. " * 300)], "doc_id long, text string")
    assert chunks.chunk(df, "tokens", over=1000).count() == 1 and chunks.chunk(df, lambda t: [(0, 1, t[:1])]).first().text == "a"


# entities and ontology -----------------------------------------------------------------------


def test_fuzzy_modes(spark):
    df = frame(spark, [("Scott Derrickson", "PERSON", 0.9), ("Scott Derrickson director", "PERSON", 0.8), ("Scot Derickson", "person", 0.5), ("Other", "ORG", 1.0)], "name string, entity_type string, confidence double")
    names = lambda *a, **k: [r.name for r in entities.fuzzy(df, *a, **k).collect()]
    assert names("scott derrickson") == ["Scott Derrickson", "Scot Derickson", "Scott Derrickson director"]
    assert names("Scott Derrickson", within=0) == ["Scott Derrickson"] == names("scott derrickson", least=1.0)
    assert names("scott", within=None) == ["Scott Derrickson", "Scott Derrickson director"] and names("ot", within=None) == ["Other"]
    assert names("scott derrickson", types=["person"], confidence=0.6, k=1) == ["Scott Derrickson"] and names(" ") == []


def test_models_and_overlaps(spark):
    docs = frame(spark, [(1, "text"), (2, None)], "doc_id long, text string")
    assert {r.entity for r in entities.by_model(docs, lambda: lambda ts: ['found ["X", "Y"]' if t else "[]" for t in ts]).collect()} == {"X", "Y"}
    assert entities.by_model(docs, lambda: 1 / 0).collect() == []
    found = frame(spark, [(1, 0, 5, 0.5, "a"), (1, 3, 8, 0.9, "b"), (1, 7, 9, 0.9, "c"), (1, 9, 12, 0.1, "d")], "doc_id long, start int, finish int, confidence double, entity string")
    assert [r.entity for r in entities.without_overlaps(found).collect()] == ["b", "d"]


def test_ontology_depth_and_cycles(spark):
    chain = frame(spark, [(f"c{k}", f"c{k + 1}") for k in range(15)], "child string, parent string")
    assert ontology.ancestors(chain).agg(F.max("distance")).first()[0] == 10
    loop = frame(spark, [("a", "b"), ("b", "a"), ("c", "a")], "child string, parent string")
    assert {r.node for r in ontology.cycles(loop).collect()} == {"a", "b"}
    assert ontology.descendants(loop, 1).where("node = 'a'").count() == 2
    pairs = frame(spark, [("c1", "c2")], "a string, b string")
    assert ontology.common_ancestors(ontology.ancestors(chain, 3), pairs).count() == 2


# sources -------------------------------------------------------------------------------------

ARTICLE = """<article><front><article-meta><title-group><article-title>A title</article-title></title-group><contrib-group><contrib><name><surname>Doe</surname><given-names>Jo</given-names></name></contrib></contrib-group>
<abstract><p>Short.</p></abstract><kwd-group><kwd>k1</kwd><kwd>k2</kwd></kwd-group></article-meta></front><body><p>One.</p><sec><p>Two.</p></sec></body></article>"""
RDF = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:skos="http://www.w3.org/2004/02/skos/core#"'
OWL = f"""<rdf:RDF {RDF}><owl:Class rdf:about="http://x#Animal"><rdfs:label>Animal</rdfs:label></owl:Class>
<owl:Class rdf:about="http://x#Dog"><rdfs:label>Dog</rdfs:label><rdfs:label>Hound</rdfs:label><rdfs:subClassOf rdf:resource="http://x#Animal"/></owl:Class><owl:Class rdf:about="http://x#Bare"></owl:Class></rdf:RDF>"""
SKOS = f"""<rdf:RDF {RDF}><skos:Concept rdf:about="u:a"><skos:prefLabel>A</skos:prefLabel><skos:altLabel>Ay</skos:altLabel><skos:narrower rdf:resource="u:b"/></skos:Concept>
<skos:Concept rdf:about="u:b"><skos:prefLabel>B</skos:prefLabel><skos:broader rdf:resource="u:a"/><skos:related rdf:resource="u:c"/></skos:Concept></rdf:RDF>"""


def test_readers(spark, tmp_path):
    for name, body in (("t/a.txt", "hello\nworld"), ("x/a.xml", ARTICLE), ("o/a.owl", OWL), ("s/a.rdf", SKOS), ("j/a.json", '{"doc_id": "1", "title": "T", "content": "C", "metadata": {"source": "s", "year": 2020}}\nbroken\n')):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text(json.dumps({"documents": [{"doc_id": "1", "content": "C"}, {"doc_id": "2", "title": "T"}]}, indent=1))
    t = documents.text_files(spark, str(tmp_path / "t")).first()
    assert (t.text, t.filename, t.file_size) == ("hello\nworld", "a.txt", 11)
    a = documents.articles(spark, str(tmp_path / "x")).first()
    assert (a.title, a.abstract, a.authors, a.keywords, a.text) == ("A title", "Short.", ["Jo Doe"], ["k1", "k2"], "One.\nTwo.")
    assert documents.json_documents(spark, str(tmp_path / "j"), broken="drop").where("doc_id is not null").count() == 1
    assert documents.json_documents(spark, str(tmp_path / "m"), many=True).count() == 2
    concepts, up = documents.owl(spark, str(tmp_path / "o"))
    assert {r.label: r.synonyms for r in concepts.collect()} == {"Animal": [], "Dog": ["Hound"], "Bare": []}
    assert [tuple(r) for r in up.collect()] == [("http://x#Dog", "is_a", "http://x#Animal")]
    concepts, up = documents.skos(spark, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in up.collect()) == [("u:b", "is_a", "u:a"), ("u:b", "related_to", "u:c")] and concepts.count() == 2


def test_store(spark, tmp_path):
    rows = frame(spark, [(1, "a"), (2, "b")], "doc_id long, text string")
    path = str(tmp_path / "rows")
    assert store.insert_counted(rows, path) == 2 and store.insert_counted(rows, path) == 2 and spark.read.parquet(path).count() == 4
    assert documents.snapshot(rows, str(tmp_path / "snap")).count() == 2
    with pytest.raises(ValueError):
        store.attach(spark, "v", rows, "doc_id", "nothing")
    with pytest.raises(ValueError):
        store.metadata_filter({"secret": 1})
    with pytest.raises(ValueError):
        store.metadata_filter({"source": [1]})
    store.attach(spark, "seen_rows", rows, "doc_id", "text")
    assert [r.met for r in store.requirements(spark, {"seen_rows": 2, "no_such_table": 0}).collect()] == [True, False]
    assert store.completeness(rows.withColumn("embedding", F.when(F.col("doc_id") == 1, 1))).first().share == 0.5


def test_page_texts(spark):
    html = "<html><title> A &amp; B </title><script>x<y</script><p>One</p><!-- no --><p>Two &lt;3</p></html>"
    r = documents.page_texts(frame(spark, [(1, html)], "page_id long, html string")).first()
    assert r.title == "A &amp; B" and r.text == "A & B One Two <3"


# streams -------------------------------------------------------------------------------------


def test_stream_in_several_batches(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for n, part in enumerate(([0, 10, 20], [30, 95], [100, 300])):
        rows = [(k, at(k), 1, "view", 1.0, "{}") for k in part]
        frame(spark, rows, streams.EVENTS.replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), "*.parquet", 1)
    got = streams.run(streams.admitted(stream, 2, 3600, "10 minutes"), f"file://{tmp_path}").collect()
    assert {r.event_id: r.admitted for r in got} == {0: True, 10: True, 20: False, 30: False, 95: True, 100: True, 300: True}


def test_answer_events(spark):
    got = streams.answer_events(frame(spark, [(1, "x" * 120), (2, "")], "id long, text string")).orderBy("id", "n").collect()
    assert [r.kind for r in got] == ["start", "chunk", "chunk", "chunk", "complete", "start", "complete"] and len(got[3].data) == 20


def test_normalise_matches_numpy(spark):
    x = np.random.default_rng(1).standard_normal((5, 4))
    df = frame(spark, [(r.tolist(),) for r in x], "v array<double>")
    got = np.array([r[0] for r in df.select(V.normalise("v")).collect()])
    assert np.allclose(got, x / np.linalg.norm(x, axis=1, keepdims=True))


def test_fused_lists_keep_scores_by_source(spark):
    rows = [("a", 1, 1, 0.9), ("b", 1, 2, 3.0), ("a", 2, 2, 0.5)]
    found = {r.id: r for r in fusion.reciprocal(frame(spark, rows, "source string, id long, rank int, score double")).collect()}
    assert found[1].scores == {"a": 0.9, "b": 3.0} and found[2].scores == {"a": 0.5} and found[1].sources == ["a", "b"]


def test_graph_retrieval_falls_back_to_vectors(spark):
    entities = frame(spark, [("e1", "aspirin", 1), ("e2", "fever", 2)], "entity string, name string, doc_id long")
    edges = frame(spark, [("e1", "treats", "e2", 1.0)], "src string, pred string, dst string, w double")
    vectors = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "doc_id long, embedding array<double>")
    asked = frame(spark, [(0, [0.0, 1.0])], "query_id long, query array<double>")
    ask = lambda text: [tuple(r) for r in pipelines.graph(entities, edges, text, 1, 2, vectors, asked).orderBy("doc_id").collect()]
    assert ask("what of aspirin") == [(1, 1), (2, 1)]
    assert ask("nothing named") == [(2, 0), (3, 0)]


def test_filters_take_the_standard_keys():
    for key in ("created_at", "language", "page_number", "collection_id", "version"):
        store.metadata_filter({key: "x"})
    with pytest.raises(ValueError):
        store.metadata_filter({"category": "x"})


def test_weighted_overall_by_the_standard_weights(spark):
    scores = frame(spark, [("s", "faithfulness", 1.0), ("s", "answer_relevancy", 0.5), ("s", "answer_similarity", 0.0), ("s", "other", 9.0)], "system string, metric string, value double")
    assert evaluation.overall(scores).first().overall == pytest.approx((0.25 * 1 + 0.2 * 0.5) / 0.5)


def test_rare_states_of_stores_and_loops(spark, tmp_path):
    old = frame(spark, [(1, "a"), (2, "b")], "doc_id long, text string")
    new = frame(spark, [(2, "x"), (2, "z"), (None, "n")], "doc_id long, text string")
    assert sorted(tuple(r) for r in store.upsert(old, new).where("doc_id is not null").collect()) == [(1, "a"), (2, "z")]
    ring = frame(spark, [(f"n{k}", f"n{(k + 1) % 14}") for k in range(14)], "child string, parent string")
    assert ontology.cycles(ring).count() == 14
    line = frame(spark, [(f"n{k}", "next", f"n{k + 1}", 1.0) for k in range(130)], "src string, pred string, dst string, w double")
    cost = {r.node: r.cost for r in graph.dijkstra(line.limit(130), "n100").collect()}
    assert cost["n130"] == 30.0
