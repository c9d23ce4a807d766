"""Which sides may be broadcast."""

from pyspark.sql import functions as F

from loomlight.llm import lines, shared
from tests.llm.test_lines import SCHEMA


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_entries_of_arrays_count(spark):
    few = spark.range(4).select("id", F.array_repeat(F.col("id"), 10).alias("a"))
    many = spark.range(4).select("id", F.array_repeat(F.col("id"), 1 << 20).alias("a"))
    assert hinted(shared.sized(few, 64, "a", 8)) and not hinted(shared.sized(many, 64, "a", 8))
    assert hinted(shared.sized(few.limit(0), 64, "a", 8))


def test_line_numbers_of_long_documents_are_not_broadcast(spark, monkeypatch):
    """Few documents, of many repeated lines each: more than may be broadcast, though the rows alone would pass."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 4096)
    docs = spark.createDataFrame([(k, "\n".join(["one two three four five six"] * 2000)) for k in range(3)], SCHEMA)
    taken = []
    plain = shared.sized
    monkeypatch.setattr(lines, "sized", lambda df, *rest: taken.append((df.columns, hinted(plain(df, *rest)))) or plain(df, *rest))
    got = {r.doc_id: r.n_removed for r in lines.deduplicate(docs).collect()}
    assert got == {0: 1999, 1: 2000, 2: 2000}
    assert not any(h for c, h in taken if "removed" in c)
