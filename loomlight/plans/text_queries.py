"""Queries over texts and names: scalar functions, metrics, chunks, entities, ontology, stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.operators import chunks as C
from loomlight.operators import entities as N
from loomlight.operators import evaluation, ontology, search, serving
from loomlight.operators.common import rounded
from loomlight.sources import documents, store
from loomlight.sources.tables import events, spread_documents, table


def _docs(spark, sf):
    return spread_documents(spark, sf)


def _questions(spark, sf):
    """Benchmark items as questions of four kinds."""
    kind = F.element_at(F.array(*(F.lit(x) for x in ("What is the ", "How to ", "Why ", "Explain fever and pain in "))), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", F.concat(kind, F.array_join(F.slice(X.words("text"), 1, 4), " "), F.lit("?")).alias("q"), "text")


def str_variants(spark, sf):
    return _questions(spark, sf).select("item_id", F.posexplode(X.query_variants("q")).alias("n", "variant"))


def str_strategy(spark, sf):
    s = X.query_strategy("q")
    return _questions(spark, sf).select("item_id", s["matches"].alias("matches"), rounded(s["density"]).alias("density"), s["query_type"].alias("query_type"), s["strategy"].alias("strategy"))


def str_fuzzy(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).dropDuplicates(["name"]).select("name")
    found = N.fuzzy(names, "smal ring", within=3, k=10)
    return found.select("name", "distance", rounded("similarity").alias("similarity"))


def str_sentences(spark, sf):
    """A text without sentences has no first one; a null text has no number of them either."""
    found = _docs(spark, sf).select("doc_id", "text", X.sentences("text").alias("s"))
    return found.select("doc_id", F.when(F.col("text").isNotNull(), F.size("s")).alias("sentences"), F.get("s", F.lit(0)).alias("first"))


def str_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(F.encode(X.clean("url"), "utf-8")).alias("digest"), X.clean("url").alias("clean"))


def hash_md5(spark, sf):
    key = X.cache_key(F.col("text"), F.col("lang"))
    return _docs(spark, sf).select("doc_id", F.md5(F.encode(X.filled("text"), "utf-8")).alias("md5"), key.alias("cache_key"), F.substring(F.sha2("text", 256), 1, 16).alias("prompt_hash"))


def hash_embedding(spark, sf):
    v = X.hash_embedding("text", 20)
    return _docs(spark, sf).select("doc_id", rounded(F.element_at(v, 1)).alias("x0"), rounded(F.element_at(v, 16)).alias("x15"), rounded(F.element_at(v, 17)).alias("x16"), F.size(v).alias("dim"))


def json_path(spark, sf):
    wanted = store.metadata_filter({"k": 69}, ("k",), "props")
    return events(spark, sf).where(wanted).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def json_lenient(spark, sf):
    said = F.concat(F.lit('Found: ["'), F.array_join(F.slice(X.words("text"), 1, 3), '", "'), F.lit('"] done'))
    loose = F.concat(F.lit("a, b , "), F.element_at(X.words("text"), 1))
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.array_join(X.lenient_array(said), "|").alias("strict"), F.array_join(X.lenient_array(loose), "|").alias("loose"))


def ttl_active(spark, sf):
    e = events(spark, sf).withColumn("expires", F.col("ts") + F.expr("make_interval(0, 0, 0, event_id % 10)"))
    return serving.active(e, "expires", F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


def text_density(spark, sf):
    return _docs(spark, sf).select("doc_id", rounded(X.density("text")).alias("density"), F.size(X.words("text")).alias("words"))


def text_readability(spark, sf):
    return _docs(spark, sf).select("doc_id", rounded(X.readability("text")).alias("readability"))


def text_quality(spark, sf):
    """A document's first line as its title, the next 400 characters as its abstract."""
    title, abstract = F.substring_index("text", "\n", 1), F.substring("text", 1, 400)
    return _docs(spark, sf).select("doc_id", rounded(X.quality(title, abstract, F.col("text"))).alias("quality"), rounded(X.informativeness("text")).alias("informativeness"))


def text_complexity(spark, sf):
    return _questions(spark, sf).select("item_id", X.complexity("q", "text").alias("complexity"))


DOMAINS = {"commerce": ("bolt", "gear", "brand"), "shape": ("ring", "widget", "small"), "colour": ("red", "blue", "green")}


def text_domain(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.best_domain("p_name", DOMAINS, "none").alias("domain"), ontology.domain("p_name", DOMAINS).alias("share_domain"))


def document_valid(spark, sf):
    ok = (F.size(X.words("text")) >= 50) & (F.coalesce("lang", F.lit("en")) == "en")
    return _docs(spark, sf).where(ok).select("doc_id")


STOP_WORDS = ("the", "of", "and", "in", "to", "a", "is", "on", "it", "by", "with", "for", "as", "was", "that", "are", "this")


def key_terms(spark, sf):
    from loomlight.operators.common import top_k_per

    w = _docs(spark, sf).select("doc_id", F.explode(X.tokens("text")).alias("term")).where(F.col("term").rlike(r"^\p{L}+$") & ~F.col("term").isin(*STOP_WORDS))
    return top_k_per(w.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")), "doc_id", 10, F.desc("n"), "term")


def chunk_plain(spark, sf):
    return C.fixed_plain(_docs(spark, sf)).select("doc_id", "start", "finish", F.md5(F.encode("text", "utf-8")).alias("digest"))


def _chunked(strategy, over=0):
    def query(spark, sf):
        return C.chunk(_docs(spark, sf), strategy, over=over).select("doc_id", "n", "start", "finish", F.length("text").alias("size"))

    return query


def chunk_stats(spark, sf):
    found = C.statistics(C.fixed_plain(_docs(spark, sf)), _docs(spark, sf))
    return found.select("chunks", rounded("mean").alias("mean"), "least", "most", rounded("sd").alias("sd"), "over_1920", "over_1440", rounded("coverage").alias("coverage"))


def entity_rules(spark, sf):
    docs = _docs(spark, sf).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Fever and pain; insulin. "), F.col("text"))).otherwise(F.col("text")))
    found = N.by_rules(docs).where("entity_type in ('Disease', 'Medication', 'Symptom')")
    return found.groupBy("entity_type", F.lower("entity").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


def entity_spans(spark, sf):
    return N.without_overlaps(N.by_rules(_docs(spark, sf)))


def entity_capitals(spark, sf):
    return N.capitals(_docs(spark, sf)).select("doc_id", "pos", "entity")


def cooccurrence(spark, sf):
    found = N.capitals(_docs(spark, sf))
    return N.cooccurrences(found).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), rounded(F.sum("strength")).alias("strength"))


def entity_match(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    q = spark.createDataFrame([(0, "from nation_1 to Nation_22"), (1, "no place")], "item_id long, text string")
    return N.named_in(names, q)


def entity_links(spark, sf):
    entities = table(spark, sf, "embeddings").select((F.col("vec_id") * 3).alias("doc_id"))
    return N.linked(entities, _docs(spark, sf))


def top_entities(spark, sf):
    found = N.capitals(_docs(spark, sf)).select("entity", F.lit("Name").alias("entity_type"))
    return N.most_common(found, 20)


def _is_a(spark, sf):
    """Nations in regions, regions in the world, some nations in others."""
    n = table(spark, sf, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    more = n.where("n_nationkey >= 20").select(name("n", "n_nationkey").alias("child"), F.concat(F.lit("n"), (F.col("n_nationkey") - 20).cast("string")).alias("parent"))
    return up.union(more).union(table(spark, sf, "region").select(name("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))


def _concepts(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.array(F.concat(F.lit("land "), F.col("n_nationkey").cast("string")), F.lit("state")).alias("synonyms"))
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("label"), F.array(F.lit("continent")).alias("synonyms"))
    return n.union(r)


def _relations(spark, sf):
    edges = _is_a(spark, sf).select(F.col("child").alias("src"), F.lit("is_a").alias("type"), F.col("parent").alias("dst"), F.lit(1.0).alias("confidence"))
    n = table(spark, sf, "nation").where("n_nationkey < 10")
    near = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.lit("related_to").alias("type"), F.concat(F.lit("n"), F.pmod(F.col("n_nationkey") * 3, F.lit(10)).cast("string")).alias("dst"), F.lit(0.8).alias("confidence"))
    return edges.union(near)


def onto_ancestors(spark, sf):
    return ontology.ancestors(_is_a(spark, sf))


def onto_subsume(spark, sf):
    return ontology.subsumption(_is_a(spark, sf))


def onto_transitive(spark, sf):
    return ontology.transitivity(_relations(spark, sf)).withColumn("confidence", rounded("confidence"))


def onto_symmetric(spark, sf):
    return ontology.symmetry(_relations(spark, sf)).withColumn("confidence", rounded("confidence"))


def onto_infer_all(spark, sf):
    return ontology.infer_all(_relations(spark, sf)).withColumn("confidence", rounded("confidence"))


def onto_rules(spark, sf):
    rules = [{"name": "far", "priority": 1, "where": {"type": "related_to", "dst": "n0"}, "type": "near", "dst": "origin", "confidence": 0.6}, {"name": "top", "priority": 5, "where": {"dst": "world"}, "type": "is_a", "dst": "root", "confidence": 0.9}]
    return ontology.by_rules(_relations(spark, sf), rules)


def onto_expand(spark, sf):
    q = spark.createDataFrame([(0, "trade of NATION_3 and land 21"), (1, "weather in REGION_1"), (2, "nothing")], "item_id long, text string")
    return ontology.expand(_concepts(spark, sf), _is_a(spark, sf), q)


def onto_similarity(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("a"))
    pairs = n.where("a in ('n1', 'n22', 'n5')").crossJoin(F.broadcast(n.withColumnRenamed("a", "b")))  # a fixed number of nations
    return ontology.similarity(_is_a(spark, sf), pairs).withColumn("similarity", rounded("similarity"))


def onto_cycles(spark, sf):
    edges = _is_a(spark, sf).union(spark.createDataFrame([("world", "r2")], "child string, parent string"))
    return ontology.cycles(edges)


def onto_extract(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.concat("text", F.lit(" Land 2 "), F.lit("nation_"), F.pmod("doc_id", F.lit(25)).cast("string")).alias("text"))
    return ontology.extract(_concepts(spark, sf), docs).withColumn("confidence", rounded("confidence"))


def eval_context(spark, sf):
    """Neighbours of a vector as results, vectors of its label as what is relevant."""
    rows = table(spark, sf, "embeddings")
    asked = search.query_of(rows, F.col("vec_id") % 100 == 0)
    label = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    known = label.join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("known")), "label").select("query_id", "known")
    results = search.nearest(rows, asked, 10).select("query_id", "vec_id", "score").join(rows.select("vec_id", F.col("label").alias("own")), "vec_id").join(label, "query_id")
    found = evaluation.context_quality(results.withColumn("hit", F.col("own") == F.col("label")), known)
    return found.select("query_id", *(rounded(c).alias(c) for c in ("precision", "recall", "utilisation")))


def claim_support(spark, sf):
    """Sentences of assistants held against the other turns of their conversation."""
    turns = table(spark, sf, "conversations")
    claims = turns.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(X.sentences("text")).alias("n", "s")).where("length(s) >= 10").select("conv_id", "turn", "n", F.array_distinct(X.tokens("s")).alias("w"))
    proof = turns.where("role <> 'assistant'").select("conv_id", F.array_distinct(X.tokens("text")).alias("d"))
    share = F.size(F.array_intersect("w", "d"))
    held = claims.join(proof, "conv_id", "left").groupBy("conv_id", "turn", "n").agg(F.coalesce(F.max(share), F.lit(0)).alias("overlap"), F.first(F.size("w")).alias("words"))
    ratio = F.when(F.col("words") == 0, 0.5).otherwise(F.greatest(F.lit(0.1), 1 - F.col("overlap") / F.col("words")))
    return held.select("conv_id", "turn", "n", "overlap", (F.col("overlap") >= F.greatest(F.lit(2.0), 0.4 * F.col("words"))).alias("supported"), F.round(ratio, 2).alias("doubt"))


def metric_means(spark, sf):
    m = events(spark, sf).groupBy("user_id").agg(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.avg("value"), F.max("value"))).alias("m"))
    values = F.map_values("m")
    return m.select("user_id", rounded(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).alias("mean"))


def fulltext_token(spark, sf):
    return _docs(spark, sf).where(F.array_contains(X.tokens("text"), "there")).select("doc_id")


def corpus_summary(spark, sf):
    d = _docs(spark, sf)
    return d.agg(F.count(F.lit(1)).alias("documents"), rounded(F.avg(F.length("text"))).alias("mean_length"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"))


def _with_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return _docs(spark, sf).join(v, "doc_id", "left")


def completeness(spark, sf):
    found = store.completeness(_with_vectors(spark, sf))
    return found.withColumn("share", rounded("share"))


def missing_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return store.missing_vectors(_docs(spark, sf), v).select("doc_id")


def backfill(spark, sf):
    """Missing vectors from the hash embedding."""
    lost = store.missing_vectors(_docs(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"))
    return lost.select("doc_id", rounded(F.element_at(X.hash_embedding("text", 64), 64)).alias("last"))


def upsert(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", "source")
    new = d.where("doc_id % 100 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") >= 500, 100000).otherwise(0)).alias("doc_id"), F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    return store.upsert(d, new, kept_if_null=("source",))


def delete_ids(spark, sf):
    return store.delete(_docs(spark, sf).select("doc_id", "lang"), table(spark, sf, "labels").where("toxic = 1").select("doc_id"))


def point_lookup(spark, sf):
    return store.lookup(_docs(spark, sf), [3, 5, 700, 10**9]).select("doc_id", "source", "n_chars")


def attach_table(spark, sf):
    return store.attach(spark, "attached_vectors", table(spark, sf, "embeddings").withColumn("text", F.col("label").cast("string")), "vec_id", "text", "embedding")


def ingest_chunked(spark, sf):
    """Documents of over 1000 characters in plain pieces, shorter ones whole."""
    d = _docs(spark, sf)
    long = C.fixed_plain(d.where("length(text) > 1000")).select("doc_id", "start", "text")
    whole = d.where("length(text) <= 1000 and length(text) > 0").select("doc_id", F.lit(0).alias("start"), "text")
    return long.union(whole).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


def page_titles(spark, sf):
    return documents.page_texts(table(spark, sf, "pages")).select("page_id", "title", F.length("text").alias("chars"))


def answer_events(spark, sf):
    from loomlight.streaming import streams

    a = table(spark, sf, "conversations").where("role = 'assistant' and turn = 1").select(F.col("conv_id").alias("id"), "text")
    return streams.answer_events(a).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        str_variants, str_strategy, str_fuzzy, str_sentences, str_clean, hash_md5, hash_embedding, json_path, json_lenient, ttl_active, text_density, text_readability, text_quality, text_complexity, text_domain,
        document_valid, key_terms, chunk_plain, chunk_stats, entity_rules, entity_spans, entity_capitals, cooccurrence, entity_match, entity_links, top_entities, onto_ancestors, onto_subsume, onto_transitive,
        onto_symmetric, onto_infer_all, onto_rules, onto_expand, onto_similarity, onto_cycles, onto_extract, eval_context, claim_support, metric_means, fulltext_token, corpus_summary, completeness,
        missing_vectors, backfill, upsert, delete_ids, point_lookup, attach_table, ingest_chunked, page_titles, answer_events,
    )
} | {f"chunk_{s}": _chunked(s) for s in C.STRATEGIES}

_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\f\v]+'), lambda w: w <> '')"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda s: s <> '')"
_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_W, _S, _T = _WORDS.format("text"), _SENTENCES.format("text"), _TOKENS.format("text")
_Q = f"""q AS (SELECT item_id, ['What is the ', 'How to ', 'Why ', 'Explain fever and pain in '][item_id % 4 + 1] || array_to_string(({_W})[1:4], ' ') || '?' AS q, text FROM benchmark)"""


def _has(text: str, terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains({text}, '{t}') AS INTEGER)" for t in terms)


def _any(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


_LOW = "lower(q)"
_CHUNKS = """chunks AS (SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(least(s + 512, length(text)) AS INTEGER) AS finish, CASE WHEN length(text) <= 512 THEN text ELSE trim(substr(text, s + 1, 512)) END AS chunk, length(text) AS n
  FROM documents, unnest(CASE WHEN length(text) <= 512 THEN [0] ELSE range(0, greatest(1, length(text) - 50), 462) END) AS t(s) WHERE length(text) > 0),
kept AS (SELECT * FROM chunks WHERE n <= 512 OR length(chunk) >= 100)"""
_CAPITALS = rf"""caps AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, e AS entity FROM (SELECT doc_id, i, regexp_replace(regexp_replace(w[i], '^[.,;:!?()"'']+', ''), '[.,;:!?()"'']+$', '') AS e FROM (SELECT doc_id, {_W} AS w FROM documents), unnest(range(1, len(w) + 1)) AS t(i))
  WHERE length(e) > 3 AND regexp_matches(e, '^\p{{Lu}}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 50)"""
_ISA = """isa AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey - 20) FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
walk AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM isa UNION SELECT w.node, i.parent, w.distance + 1 FROM walk w JOIN isa i ON i.child = w.ancestor WHERE w.distance < 10),
up AS (SELECT node, ancestor, CAST(min(distance) AS INTEGER) AS distance FROM walk GROUP BY node, ancestor)"""
_REL = "rel AS (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey * 3 % 10) AS dst FROM nation WHERE n_nationkey < 10)"
_CONCEPTS = "concepts AS (SELECT 'n' || n_nationkey AS id, n_name AS label, ['land ' || n_nationkey, 'state'] AS synonyms FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, ['continent'] FROM region), terms AS (SELECT DISTINCT id, unnest(list_append(synonyms, label)) AS term FROM concepts)"
_INFERRED = """sub AS (SELECT node AS src, 'is_a' AS type, ancestor AS dst, CAST(0.9 AS DOUBLE) AS confidence FROM up WHERE (node, ancestor) NOT IN (SELECT (child, parent) FROM isa)),
trans AS (SELECT node AS src, 'is_a' AS type, ancestor AS dst, round(greatest(CAST(0.5 AS DOUBLE), 0.9 - 0.1 * (distance - 1)), 6) AS confidence FROM up WHERE distance BETWEEN 2 AND 6 AND node <> ancestor),
sym AS (SELECT dst AS src, 'related_to' AS type, src AS dst, round(CAST(0.8 AS DOUBLE) * 0.9, 6) AS confidence FROM rel WHERE (dst, src) NOT IN (SELECT (src, dst) FROM rel))"""
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = f"{_DOT('e.embedding', 'q.embedding')} / (sqrt({_DOT('e.embedding', 'e.embedding')}) * sqrt({_DOT('q.embedding', 'q.embedding')}))"


def _strip(*cut: str) -> str:
    out = _LOW
    for c in cut:
        out = f"replace({out}, '{c}', '')"
    return f"trim({out})"


_FORMS = {
    _any(_LOW, ("what are", "what is")): (_strip("what are the ", "what is the ", "what are ", "what is ", "?"), ("{0} || ' overview'", "{0} || ' details'", "'list of ' || {0}")),
    _any(_LOW, ("how",)): (_strip("how to ", "how ", "?"), ("{0} || ' methods'", "{0} || ' process'", "{0} || ' steps'")),
    _any(_LOW, ("why",)): (_strip("why ", "?"), ("{0} || ' reasons'", "{0} || ' causes'", "{0} || ' explanation'")),
    "true": ("q", ("{0} || ' overview'", "{0} || ' details'", "{0} || ' information'")),
}
_VARIANTS = "CASE " + " ".join(f"WHEN {when} THEN [q, {', '.join(f.format(base) for f in forms)}]" for when, (base, forms) in _FORMS.items()) + " END"


def _domain_sql(share: bool, default: str) -> str:
    name = lambda words: f"({_has('lower(p_name)', words)})" + (f" / {len(words)}" if share else "")
    best = f"greatest({', '.join(name(w) for w in DOMAINS.values())})"
    return f"CASE WHEN {best} = 0 THEN '{default}' " + " ".join(f"WHEN {name(w)} = {best} THEN '{d}'" for d, w in DOMAINS.items()) + " END"


ORACLE_SQL = {
    "answer_events": """WITH a AS (SELECT text FROM conversations WHERE role = 'assistant' AND turn = 1)
SELECT kind, CASE WHEN kind = 'chunk' THEN CAST(coalesce(sum(ceil(length(text) / 50)), 0) AS BIGINT) ELSE count(*) END AS n, CAST(CASE WHEN kind = 'chunk' THEN sum(length(text)) ELSE 0 END AS BIGINT) AS chars
FROM a, unnest(['start', 'chunk', 'complete']) AS t(kind) GROUP BY kind""",
    "str_variants": f"WITH {_Q}, v AS (SELECT item_id, {_VARIANTS} AS v FROM q) SELECT item_id, CAST(i - 1 AS INTEGER) AS n, v[i] AS variant FROM v, unnest(range(1, 5)) AS t(i)",
    "str_strategy": f"""WITH {_Q}, m AS (SELECT *, {_has(_LOW, X.MEDICAL_TERMS)} AS m, len({_WORDS.format('q')}) AS n FROM q)
SELECT item_id, m AS matches, round(m / n, 6) AS density, CASE {' '.join(f"WHEN {_any(_LOW, t)} THEN '{k}'" for k, t in X.QUERY_TYPES)} ELSE 'general' END AS query_type,
  CASE WHEN m / n > 0.3 THEN 'kg_primary' WHEN m > 0 THEN 'kg_vector_hybrid' ELSE 'vector_primary' END AS strategy FROM m""",
    "str_fuzzy": """SELECT name, CAST(d AS INTEGER) AS distance, round(1 - d / greatest(length(name), 9), 6) AS similarity FROM (SELECT DISTINCT p_name AS name, levenshtein(lower(p_name), 'smal ring') AS d FROM part)
WHERE d <= 3 OR (list_contains(string_split(name, ' '), 'smal') AND list_contains(string_split(name, ' '), 'ring')) ORDER BY d, length(name), name LIMIT 10""",
    "str_sentences": f"SELECT doc_id, CAST(len({_S}) AS INTEGER) AS sentences, ({_S})[1] AS first FROM documents",
    "str_clean": r"""WITH c AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_\s.,;:!?()-]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM pages) SELECT page_id, md5(clean) AS digest, clean FROM c""",
    "hash_md5": "SELECT doc_id, md5(text) AS md5, sha256(text || '|' || lang) AS cache_key, left(sha256(text), 16) AS prompt_hash FROM documents",
    "hash_embedding": """WITH h AS (SELECT doc_id, md5(text) AS h FROM documents), b AS (SELECT doc_id, list_transform(range(0, 16), lambda i: (CAST('0x' || substr(h, CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER) - 127.5) / 127.5) AS b FROM h)
SELECT doc_id, round(b[1], 6) AS x0, round(b[16], 6) AS x15, round(b[1], 6) AS x16, 20 AS dim FROM b""",
    "json_path": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') = '69'",
    "json_lenient": f"SELECT item_id, array_to_string(({_W})[1:3], '|') AS strict, 'a|b|' || trim(string_split(({_W})[1], ',')[1]) AS loose FROM benchmark",
    "ttl_active": "SELECT event_id FROM events WHERE ts + to_days(CAST(event_id % 10 AS INTEGER)) > TIMESTAMP '2024-01-20'",
    "text_density": f"SELECT doc_id, CASE WHEN len({_W}) = 0 THEN 0 ELSE round(len(list_distinct({_W})) / len({_W}), 6) END AS density, CAST(len({_W}) AS INTEGER) AS words FROM documents",
    "text_readability": f"SELECT doc_id, CASE WHEN len({_W}) = 0 THEN 0 ELSE round(1 / (1 + len({_W}) / len({_S}) / 20), 6) END AS readability FROM documents",
    "text_quality": rf"""WITH t AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS title, left(text, 400) AS abstract, len({_W}) AS n FROM documents)
SELECT doc_id, round(least(1.0, CASE WHEN len({_WORDS.format('title')}) >= 3 THEN 0.2 ELSE 0 END + CASE WHEN len({_WORDS.format('abstract')}) >= 50 THEN 0.3 ELSE 0 END + CASE WHEN n >= 1000 THEN 0.2 WHEN n >= 500 THEN 0.1 ELSE 0 END
  + 0.3 * ({_has("lower(title || ' ' || abstract || ' ' || text)", X.RELEVANCE_TERMS)}) / 18), 6) AS quality,
  round(least(1.0, least(({_has('lower(text)', X.MEDICAL_TERMS)}) / 10, 0.4) + least(len(regexp_extract_all(lower(text), '[0-9]+\.?[0-9]*\s*(%|mg|ml|years?|patients?|subjects?)')) / 5, 0.2)
  + least(({_has('lower(text)', X.SCIENCE_TERMS)}) / 8, 0.3) + CASE WHEN n BETWEEN 50 AND 200 THEN 0.1 ELSE 0 END), 6) AS informativeness FROM t""",
    "text_complexity": f"""WITH {_Q}, n AS (SELECT *, len({_W}) AS n FROM q) SELECT item_id, CASE WHEN {_any(_LOW, X.COMPLEXITY[0][1])} THEN CASE WHEN n > 100 THEN 'intermediate' ELSE 'basic' END
  WHEN {_any(_LOW, X.COMPLEXITY[1][1])} THEN CASE WHEN n > 200 THEN 'advanced' ELSE 'intermediate' END WHEN {_any(_LOW, X.COMPLEXITY[2][1])} THEN 'advanced' WHEN n < 50 THEN 'basic' WHEN n < 150 THEN 'intermediate' ELSE 'advanced' END AS complexity FROM n""",
    "text_domain": f"SELECT p_partkey, {_domain_sql(False, 'none')} AS domain, {_domain_sql(True, 'general')} AS share_domain FROM part",
    "document_valid": f"SELECT doc_id FROM documents WHERE len({_W}) >= 50 AND coalesce(lang, 'en') = 'en'",
    "key_terms": rf"""SELECT doc_id, term, count(*) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS INTEGER) AS rank FROM (SELECT doc_id, unnest({_T}) AS term FROM documents)
WHERE regexp_matches(term, '^\p{{L}}+$') AND term NOT IN {STOP_WORDS} GROUP BY doc_id, term QUALIFY rank <= 10""",
    "chunk_plain": f"WITH {_CHUNKS} SELECT doc_id, start, finish, md5(chunk) AS digest FROM kept",
    "chunk_stats": f"""WITH {_CHUNKS} SELECT count(*) AS chunks, round(avg(length(chunk)), 6) AS mean, CAST(min(length(chunk)) AS INTEGER) AS least, CAST(max(length(chunk)) AS INTEGER) AS most, round(stddev_samp(length(chunk)), 6) AS sd,
  count(*) FILTER (length(chunk) > 1920) AS over_1920, count(*) FILTER (length(chunk) > 1440) AS over_1440, round(sum(length(chunk)) / (SELECT sum(length(text)) FROM documents), 6) AS coverage FROM kept""",
    "entity_rules": f"""WITH d AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'Fever and pain; insulin. ' || text ELSE text END AS text FROM documents),
m AS (SELECT 'Symptom' AS entity_type, unnest(regexp_extract_all(lower(text), '\\b(fever|pain|nausea|fatigue|headache|cough|elevated blood glucose|glucose)\\b')) AS entity, text FROM d
  UNION ALL SELECT 'Medication', unnest(regexp_extract_all(lower(text), '\\b(insulin|metformin|aspirin|ibuprofen|lisinopril|therapy)\\b')), text FROM d
  UNION ALL SELECT 'Disease', unnest(regexp_extract_all(lower(text), '\\b(diabetes|hypertension|cancer|asthma|arthritis)\\b')), text FROM d)
SELECT entity_type, entity, count(*) AS n, CAST(min(instr(lower(text), entity)) - 1 AS INTEGER) AS first FROM m GROUP BY entity_type, entity""",
    "entity_capitals": f"WITH {_CAPITALS} SELECT doc_id, pos, entity FROM caps",
    "cooccurrence": f"""WITH {_CAPITALS} SELECT a.doc_id, count(*) AS pairs, round(sum(1 / (b.pos - a.pos + 1)), 6) AS strength FROM caps a JOIN caps b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos <= a.pos + 10 GROUP BY a.doc_id""",
    "entity_match": "SELECT CAST(0 AS BIGINT) AS item_id, n_name AS name FROM nation WHERE contains('from nation_1 to nation_22', lower(n_name)) ORDER BY n_name LIMIT 10",
    "entity_links": "SELECT count(d.doc_id) AS linked, count(*) - count(d.doc_id) AS orphaned, round(count(d.doc_id) * 100.0 / count(*), 2) AS completeness FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id * 3",
    "top_entities": f"WITH {_CAPITALS} SELECT entity, 'Name' AS entity_type, count(*) AS n FROM caps GROUP BY entity ORDER BY n DESC, entity LIMIT 20",
    "onto_ancestors": f"WITH RECURSIVE {_ISA} SELECT node, ancestor, distance FROM up",
    "onto_subsume": f"WITH RECURSIVE {_ISA}, {_REL}, {_INFERRED} SELECT * FROM sub",
    "onto_transitive": f"WITH RECURSIVE {_ISA}, {_REL}, {_INFERRED} SELECT * FROM trans",
    "onto_symmetric": f"WITH RECURSIVE {_ISA}, {_REL}, {_INFERRED} SELECT * FROM sym",
    "onto_infer_all": f"WITH RECURSIVE {_ISA}, {_REL}, {_INFERRED} SELECT src, type, dst, max(confidence) AS confidence FROM (SELECT * FROM sub UNION ALL SELECT * FROM trans UNION ALL SELECT * FROM sym) GROUP BY src, type, dst HAVING max(confidence) >= 0.5",
    "onto_rules": f"WITH RECURSIVE {_ISA}, {_REL} SELECT child AS src, 'is_a' AS type, 'root' AS dst, CAST(0.9 AS DOUBLE) AS confidence, 'top' AS rule FROM isa WHERE parent = 'world' UNION ALL SELECT src, 'near', 'origin', 0.6, 'far' FROM rel WHERE dst = 'n0'",
    "onto_expand": f"""WITH RECURSIVE {_ISA}, {_CONCEPTS}, asked AS (SELECT * FROM (VALUES (0, 'trade of nation_3 and land 21'), (1, 'weather in region_1')) AS t(item_id, q)), hit AS (SELECT DISTINCT item_id, id FROM asked, terms WHERE contains(q, lower(term))),
s AS (SELECT item_id, 'synonym' AS kind, unnest(list_sort(list_distinct(synonyms))[1:3]) AS term FROM hit JOIN concepts USING (id)),
p AS (SELECT item_id, 'parent' AS kind, label AS term FROM hit JOIN isa ON child = hit.id JOIN concepts c ON c.id = parent QUALIFY row_number() OVER (PARTITION BY item_id, hit.id ORDER BY label) <= 2),
k AS (SELECT item_id, 'child' AS kind, label AS term FROM hit JOIN isa ON parent = hit.id JOIN concepts c ON c.id = child QUALIFY row_number() OVER (PARTITION BY item_id, hit.id ORDER BY label) <= 3)
SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, kind, term FROM (SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM k)""",
    "onto_similarity": f"""WITH RECURSIVE {_ISA}, sets AS (SELECT node, list(ancestor) AS a FROM up GROUP BY node), n AS (SELECT 'n' || n_nationkey AS id FROM nation)
SELECT x.id AS a, y.id AS b, CASE WHEN x.id = y.id THEN 1.0 ELSE round(len(list_intersect(s.a, t.a)) / len(list_distinct(list_concat(s.a, t.a))), 6) END AS similarity FROM n x JOIN sets s ON s.node = x.id, n y JOIN sets t ON t.node = y.id WHERE x.id IN ('n1', 'n22', 'n5')""",
    "onto_cycles": "SELECT 'world' AS node UNION ALL SELECT 'r2'",
    "onto_extract": f"""WITH {_CONCEPTS}, d AS (SELECT doc_id, lower(text) || ' land 2 nation_' || (doc_id % 25) AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, id, term, CAST(instr(text, lower(term)) - 1 AS INTEGER) AS start, CAST(instr(text, lower(term)) - 1 + length(term) AS INTEGER) AS finish, CAST(0.9 AS DOUBLE) AS confidence FROM d, terms WHERE contains(text, lower(term))""",
    "eval_context": f"""WITH found AS (SELECT q.vec_id AS query_id, q.label AS ql, e.label, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) <= 10),
known AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT query_id, round(count(*) FILTER (found.label = ql) / count(*), 6) AS precision, round(count(*) FILTER (found.label = ql) / any_value(known.n), 6) AS recall, round(count(*) FILTER (score > 0.7) / count(*), 6) AS utilisation FROM found JOIN known ON known.label = ql GROUP BY query_id""",
    "claim_support": f"""WITH t AS (SELECT * FROM conversations), c AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS n, list_distinct({_TOKENS.format('s[i]')}) AS w FROM (SELECT conv_id, turn, {_S} AS s FROM t WHERE role = 'assistant'), unnest(range(1, len(s) + 1)) AS u(i) WHERE length(s[i]) >= 10),
d AS (SELECT conv_id, list_distinct({_T}) AS d FROM t WHERE role <> 'assistant'), h AS (SELECT c.conv_id, turn, n, coalesce(max(len(list_intersect(w, d))), 0) AS overlap, any_value(len(w)) AS words FROM c LEFT JOIN d ON d.conv_id = c.conv_id GROUP BY c.conv_id, turn, n)
SELECT conv_id, turn, n, CAST(overlap AS INTEGER) AS overlap, overlap >= greatest(2.0, 0.4 * words) AS supported, CASE WHEN words = 0 THEN 0.5 ELSE round(greatest(0.1, 1 - overlap / words), 2) END AS doubt FROM h""",
    "metric_means": "SELECT user_id, round((avg(value) + max(value)) / 2, 6) AS mean FROM events GROUP BY user_id",
    "fulltext_token": f"SELECT doc_id FROM documents WHERE list_contains({_T}, 'there')",
    "corpus_summary": "SELECT count(*) AS documents, round(avg(length(text)), 6) AS mean_length, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages FROM documents",
    "completeness": "SELECT count(*) AS total, count(embedding) AS present, round(count(embedding) / count(*), 6) AS share, count(embedding) / count(*) >= 0.95 AS complete FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "missing_vectors": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)",
    "backfill": "SELECT doc_id, round((CAST('0x' || substr(md5(text), 31, 2) AS INTEGER) - 127.5) / 127.5, 6) AS last FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "upsert": """WITH n AS (SELECT doc_id + CASE WHEN doc_id >= 500 THEN 100000 ELSE 0 END AS doc_id FROM documents WHERE doc_id % 100 = 0)
SELECT d.doc_id, CASE WHEN n.doc_id IS NULL THEN d.lang ELSE 'xx' END AS lang, d.source FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id UNION ALL SELECT doc_id, 'xx', NULL FROM n WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "delete_ids": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "point_lookup": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (3, 5, 700, 1000000000)",
    "attach_table": "SELECT count(*) AS rows, max(len(embedding)) AS dim FROM embeddings",
    "ingest_chunked": f"""WITH {_CHUNKS}, a AS (SELECT doc_id, chunk FROM kept WHERE n > 1000 UNION ALL SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 1 AND 1000) SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM a GROUP BY doc_id""",
}
