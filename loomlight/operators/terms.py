"""Which of many terms each text holds, without meeting every term with every text.

Terms of a bounded size become one automaton, which a task walks once per text. Beyond it, texts and
terms meet where a text has the first characters of a term, and pairs are verified. Both compare in
lower case, as Spark's lower() has it, and anywhere in the text, inside words too. Empty terms
are held by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.operators import common
from loomlight.operators.common import cut, sized, stored

#: Characters by which texts and terms meet where there are too many terms for an automaton.
GRAM = 6


def holding(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """The columns of texts and of terms, for each text and each row of terms whose term it holds. The two must not share names; null texts hold nothing."""
    low = cut(terms.select(F.lower(term).alias("_low")).where(F.length("_low") > 0).distinct())
    rows, characters = low.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_low")), F.lit(0))).first()
    wide = texts.where(F.col(text).isNotNull()).withColumn("_text", F.lower(text))
    # an automaton takes some tens of bytes for a character
    found = _walked(wide, low) if rows * 64 + characters * 32 <= common.BROADCAST_BYTES else _met(wide, low)
    # whether this join ships the terms is left to Spark, which knows their size
    return found.join(terms.withColumn("_l", F.lower(term)), F.col("_low") == F.col("_l")).drop("_low", "_l")


def _walked(wide: DataFrame, low: DataFrame) -> DataFrame:
    """texts with _low, a row for each term they hold, by an automaton in each task."""
    words = low.sparkSession.sparkContext.broadcast([r[0] for r in low.collect()])
    columns = [c for c in wide.columns if c != "_text"]
    schema = wide.select(*columns, F.array(F.lit("")).alias("_low")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        some = len(automaton) > 0
        for batch in batches:
            held = [sorted({w for _, w in automaton.iter(t)}) if some else [] for t in batch.column("_text").to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(held, pa.list_(pa.string()))], names=[*columns, "_low"])

    return wide.mapInArrow(run, schema).withColumn("_low", F.explode("_low"))


def _met(wide: DataFrame, low: DataFrame) -> DataFrame:
    """The same by an equi join: terms by their first GRAM characters, texts by all runs of as many, each once."""
    sizes = sorted(r[0] for r in low.select(F.least(F.length("_low"), F.lit(GRAM))).distinct().collect())  # GRAM at most
    texts = stored(wide.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist()):
                grams = sorted({t[k : k + n] for n in sizes for k in range(len(t) - n + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(grams), pa.int64()), pa.array(grams, pa.string())], names=["_row", "_gram"])

    keyed = low.withColumn("_gram", F.substring("_low", 1, GRAM))
    grams = texts.select("_row", "_text").mapInArrow(run, "_row long, _gram string")
    near = grams.join(sized(keyed, 256), "_gram").select("_row", "_low")
    return texts.join(near, "_row").where(F.contains("_text", "_low")).drop("_text", "_row")
