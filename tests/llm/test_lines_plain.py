"""The short way of plain texts, and what is done once for each line."""

import sys

from pyspark.sql import functions as F

from loomlight.llm import lines
from tests.llm.test_lines import SCHEMA


def test_every_character_is_spaced_alike(spark):
    """Texts that pass as plain are those that the longer way leaves as they are but for case."""
    points = [k for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000]
    texts = spark.range(0, len(points), numPartitions=4).select((F.col("id") + F.when(F.col("id") >= 0xD800, 0x800).otherwise(0)).alias("k"))
    one = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("k"), 8, "0"))), "UTF-32")
    texts = texts.select("k", F.concat(F.lit("Aé  B\n"), one, F.lit("x\nC")).alias("text"))
    seen = texts.select("k", (lines.spaced(F.col("text")) == lines._respaced(F.col("text"))).alias("same"), F.rlike("text", F.lit(lines._PLAIN)).alias("plain"))
    assert seen.where("same").count() == len(points)
    assert {r.k for r in seen.where("plain").collect()} == {k for k in range(256) if k == 10 or k == 32 or not chr(k).isspace()}


def test_lines_are_made_tidy_once(spark):
    """The filter of blank lines doesn't repeat what makes a line tidy."""
    docs = spark.createDataFrame([(1, "A  b\n \t\n\nc")], SCHEMA)
    found = lines._occurrences(docs, "doc_id", "text", 1, 5)
    assert sorted(r.line for r in found.collect()) == [0, 3]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    kept = [s for s in plan.split("\n") if "Filter" in s]
    assert not any("regexp_replace" in s or "replace(" in s for s in kept)


def test_shortest_counts_words(spark):
    docs = spark.createDataFrame([(1, " one \n one\ttwo\none  two three\n\n"), (2, "one two\nONE TWO THREE\none")], SCHEMA)
    for shortest, gone in ((1, 3), (2, 2), (3, 1), (4, 0)):
        got = {r.doc_id: r.n_removed for r in lines.deduplicate(docs, shortest=shortest).collect()}
        assert got == {1: 0, 2: gone}
