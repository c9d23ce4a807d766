"""Chunks of documents. A chunk is key, n (from 0), start, finish (characters) and text.

Chunkers are small functions from a text to its spans; Spark deals the documents and keeps one text
at a time in a task. fixed_plain needs no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that begin a new topic.
TOPIC_WORDS = ("however", "furthermore", "moreover", "in addition", "on the other hand", "in contrast", "meanwhile", "subsequently", "therefore", "thus", "in conclusion", "finally", "first", "second", "third")
_SENTENCE_END = re.compile(r"[.!?]\s+")
_WORD = re.compile(r"\w+")

Span = tuple[int, int, str]


def fixed(text: str, size: int = 512, overlap: int = 50, least: int = 100, at_sentences: bool = True) -> Iterator[Span]:
    """Pieces of at most `size` characters, each begun `overlap` before the end of the one before and ended after a sentence in its last fifth if there is one; pieces under `least` characters go. A text within the size is one piece."""
    if len(text) <= size:
        yield 0, len(text), text
        return
    begin = 0
    while True:
        end = min(begin + size, len(text))
        if at_sentences and end < len(text):
            stops = [m.end() for m in _SENTENCE_END.finditer(text, begin + max(size * 4 // 5, least), end)]
            end = stops[-1] if stops else end
        piece = text[begin:end].strip()
        if len(piece) >= least:
            yield begin, end, piece
        if end == len(text):
            return
        begin = max(end - overlap, begin + 1)


def split_sentences(text: str) -> list[str]:
    return [s for part in re.split(r"(?<=[.!?])\s+", text.strip()) if (s := part.strip())]


def _turns(here: str, following: str, alike: float) -> bool:
    """Whether a topic seems to end between two sentences."""
    low = following.lower()
    if low.startswith(TOPIC_WORDS):
        return True
    a, b = set(_WORD.findall(here.lower())), set(_WORD.findall(low))
    return bool(a and b) and len(a & b) / min(len(a), len(b)) < alike


def semantic(text: str, least: int = 200, most: int = 1000, alike: float = 0.7) -> Iterator[Span]:
    """Runs of sentences of `least` characters at least, closed where a topic turns or `most` is passed. Places count in the sentences joined by single spaces."""
    sentences = split_sentences(text)
    if len(sentences) <= 1:
        yield 0, len(text), text
        return
    run, size, begin = [], -1, 0
    for here, following in zip(sentences, [*sentences[1:], None]):
        run.append(here)
        size += 1 + len(here)
        if following is None or (size >= least and (size >= most or _turns(here, following, alike))):
            yield begin, begin + size, " ".join(run)
            begin, run, size = begin + size + 1, [], -1


def hybrid(text: str, most: int = 800) -> Iterator[Span]:
    """Semantic chunks; those over `most` characters are cut again by size."""
    for begin, end, piece in semantic(text):
        if len(piece) <= most:
            yield begin, end, piece
        else:
            yield from ((begin + a, begin + b, part) for a, b, part in fixed(piece))


def basic(text: str, size: int = 1000, overlap: int = 200) -> Iterator[Span]:
    """Pieces ended at the last full stop, else the last space, within the size."""
    if len(text) <= size:
        yield 0, len(text), text
        return
    begin = 0
    while begin < len(text):
        end = min(begin + size, len(text))
        if end < len(text):
            stop, space = text.rfind(".", begin, end), text.rfind(" ", begin, end)
            end = stop + 1 if stop > begin else space if space > begin else end
        if piece := text[begin:end].strip():
            yield begin, end, piece
        if end == len(text):
            return
        begin = max(end - overlap, begin + 1)


def articles(text: str, size: int = 8000, overlap: int = 400, least: int = 100) -> Iterator[Span]:
    """basic with an article's sizes; pieces of `least` characters or fewer go."""
    return (s for s in basic(text, size, overlap) if len(s[2]) > least or len(text) <= size)


def by_tokens(text: str, budget: int = 512, repeated: int = 2) -> Iterator[Span]:
    """Runs of sentences within a budget of words, each begun with the last sentences of the one before. Places count in sentences."""
    sentences = split_sentences(text)
    begin = 0
    while begin < len(sentences):
        end, used = begin, 0
        while end < len(sentences) and (end == begin or used + len(sentences[end].split()) <= budget):
            used += len(sentences[end].split())
            end += 1
        yield begin, end, " ".join(sentences[begin:end])
        if end == len(sentences):
            return
        begin = max(end - repeated, begin + 1)


STRATEGIES: dict[str, Callable[[str], Iterator[Span]]] = {"fixed": fixed, "semantic": semantic, "hybrid": hybrid, "basic": basic, "articles": articles, "tokens": by_tokens}


def chunk(docs: DataFrame, strategy: str | Callable[[str], Iterator[Span]], key: str = "doc_id", text: str = "text", over: int = 0) -> DataFrame:
    """key, n, start, finish, text of the chunks. Texts of at most `over` characters are one chunk; null and empty texts have none."""
    cutter = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    source = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = source.select("key", F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("finish"), "text").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch["key"], batch["text"]):
                spans = [(0, len(t), t)] if len(t) <= over else list(cutter(t))
                if spans:
                    yield pd.DataFrame({"key": k, "n": range(len(spans)), "start": [s[0] for s in spans], "finish": [s[1] for s in spans], "text": [s[2] for s in spans]})

    return source.mapInPandas(run, schema).withColumnRenamed("key", key)


def fixed_plain(docs: DataFrame, size: int = 512, overlap: int = 50, least: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """fixed without sentence ends, as one expression."""
    step, n = size - overlap, F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step)))
    rows = docs.where(n > 0).select(key, text, n.alias("_n"), F.explode(starts).alias("start"))
    rows = rows.select(key, "start", F.least(F.col("start") + size, F.col("_n")).alias("finish"), "_n", F.when(F.col("_n") <= size, F.col(text)).otherwise(F.trim(F.substring(text, F.col("start") + 1, F.lit(size)))).alias("chunk"))
    return rows.where((F.col("_n") <= size) | (F.length("chunk") >= least)).select(key, "start", "finish", F.col("chunk").alias("text"))


def statistics(chunks: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: chunks, mean, least, most and sd of their lengths, how many pass 1920 and 1440 characters, coverage (characters of chunks over those of documents)."""
    n = F.length(text)
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.stddev_samp(n).alias("sd"), F.count_if(n > 1920).alias("over_1920"), F.count_if(n > 1440).alias("over_1440"), F.sum(n).alias("_c"))
    return c.crossJoin(F.broadcast(docs.agg(F.sum(n).alias("_d")))).withColumn("coverage", F.col("_c") / F.col("_d")).drop("_c", "_d")  # one row
