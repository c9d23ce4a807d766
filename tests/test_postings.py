"""The stored BM25 index against a search over the texts."""

import random

from pyspark.sql import functions as F

from loomlight.operators import lexical, postings

WORDS = [f"w{k}" for k in range(60)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, segment string")


def found(rows):
    return sorted((r.query_id, r.key, round(r.score, 9), r["rank"]) for r in rows.collect())


def both(spark, path, docs, wanted, k=7):
    """What the index and a rebuild give."""
    return found(postings.search(spark, path, wanted, k)), found(lexical.search(lexical.bags(table(spark, docs)), wanted, k))


def test_segments_merge_to_a_rebuild(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))
    docs = {k: text() for k in range(120)}
    wanted = lexical.asked(spark.createDataFrame([(0, "w1 w2 w2 w3"), (1, "w9"), (2, "nothing")], "q long, t string"), "q", "t")
    rows = lambda: [(k, t, "z") for k, t in docs.items()]
    path = postings.build(table(spark, rows() + [(None, "w1 w1", "z"), (500, None, "z"), (501, "", "z")]), str(tmp_path / "a"))
    a, b = both(spark, path, rows(), wanted)
    assert a == b and a
    new = {k: text() for k in [3, 4, 200, 201]} | {5: "", 6: None}
    docs |= new
    postings.upsert(table(spark, [(k, t, "z") for k, t in new.items()]), path)
    a, b = both(spark, path, rows(), wanted)
    assert a == b
    for gone in ([3, 7, 999], [7, 8]):
        postings.delete(spark.createDataFrame([(k,) for k in gone], "doc_id long"), path)
        docs = {k: t for k, t in docs.items() if k not in gone}
    docs[7] = "w1 w9 w9"
    postings.upsert(table(spark, [(7, docs[7], "z")]), path)
    a, b = both(spark, path, rows(), wanted)
    assert a == b
    live = {k: len(t.split()) for k, t in docs.items() if t}
    assert {r.key: r.length for r in postings.documents(spark, path).collect()} == live
    n, mean = postings.statistics(spark, path)
    assert n == len(live) and abs(mean - sum(live.values()) / n) < 1e-12
    merged = postings.compact(spark, path, str(tmp_path / "b"))
    assert found(postings.search(spark, merged, wanted, 7)) == a and postings.statistics(spark, merged) == (n, mean)


def test_a_search_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    path = postings.build(table(spark, [(k, " ".join(WORDS), "z") for k in range(20)]), str(tmp_path / "a"))
    one = spark.createDataFrame([("w5",)], "term string")
    rows = postings.postings(spark, path, one)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "term" in plan.split("PushedFilters")[1].split("]")[0]
    bucket = one.select(postings._bucket("term", postings.BUCKETS).alias("b")).first().b
    files = {f for f in rows.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files and all(f"bucket={bucket}/" in f for f in files)


def test_an_unfinished_segment_is_not_read(spark, tmp_path):
    path = postings.build(table(spark, [(1, "w1 w2", "z")]), str(tmp_path / "a"))
    stray = spark.createDataFrame([("w1", 9, 1, 1, 2, 0)], "term string, key long, tf long, length long, segment long, bucket int")
    stray.select("term", "key", "tf", "length", "segment", postings._bucket("term", postings.BUCKETS).alias("bucket")).write.mode("append").partitionBy("segment", "bucket").parquet(f"{path}/postings")
    assert [r.key for r in postings.postings(spark, path, spark.createDataFrame([("w1",)], "term string")).collect()] == [1]


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "LISTED_TERMS", 2)
    path = postings.build(table(spark, [(k, f"w{k} w{k + 1}", "z") for k in range(30)]), str(tmp_path / "a"))
    wanted = lexical.asked(spark.createDataFrame([(0, " ".join(WORDS[:20]))], "q long, t string"), "q", "t")
    a, b = both(spark, path, [(k, f"w{k} w{k + 1}", "z") for k in range(30)], wanted, 30)
    assert a == b and len(a) == 20


def test_empty(spark, tmp_path):
    path = postings.build(table(spark, []), str(tmp_path / "a"))
    wanted = lexical.asked(spark.createDataFrame([(0, "w1")], "q long, t string"), "q", "t")
    assert found(postings.search(spark, path, wanted, 5)) == [] and postings.statistics(spark, path) == (0, 1.0)
    postings.upsert(table(spark, [(1, "w1", "z")]), path)
    assert [x[1] for x in found(postings.search(spark, path, wanted, 5))] == [1]
