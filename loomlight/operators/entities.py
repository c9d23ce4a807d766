"""Entities in texts and among names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.operators import models, terms
from loomlight.operators.common import top_k, top_k_per

# Patterns of the rule extractor. Names keep their capitals; the rest match in either case.
PATTERNS = {
    "Disease": r"(?i)\b(diabetes|hypertension|cancer|asthma|arthritis)\b",
    "Medication": r"(?i)\b(insulin|metformin|aspirin|ibuprofen|lisinopril|therapy)\b",
    "Symptom": r"(?i)\b(fever|pain|nausea|fatigue|headache|cough|elevated blood glucose|glucose)\b",
    "Person": r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b",
    "Organization": r"\b([A-Z][a-z]+ (?:Corporation|Inc|LLC|Ltd))\b",
}
CONFIDENCE = 0.85
ENTITY = "entity_type string, entity string, start int, finish int, confidence double"


def by_rules(docs: DataFrame, patterns: dict[str, str] = PATTERNS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, entity_type, entity, start, finish, confidence of every match. Null texts have none."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = rows.select("key").schema.simpleString()[7:-1].replace(":", " ") + ", " + ENTITY
    compiled = {kind: re.compile(p) for kind, p in patterns.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, kind, m.group(), m.start(), m.end(), CONFIDENCE) for k, t in zip(batch["key"], batch["text"]) for kind, p in compiled.items() for m in p.finditer(t)]
            yield pd.DataFrame(found, columns=["key", "entity_type", "entity", "start", "finish", "confidence"])

    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def by_model(docs: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]], key: str = "doc_id", text: str = "text", chars: int = 500) -> DataFrame:
    """key, entity: names that a model lists for the first `chars` characters, served_by and degraded. Its answers are JSON arrays, or anything with one inside. If it raises for any document, none has entities: the result is empty, not in part."""
    asked = docs.select(key, F.left(X.filled(text), F.lit(chars)).alias("_asked"))
    ways = {
        "model": lambda: asked.select(key, models.answers(model, F.col("_asked")).alias("answer")),
        "none": lambda: asked.select(key, F.lit("[]").alias("answer")),
    }
    found = models.first_whole(ways)
    return found.select(key, F.explode(X.lenient_array("answer")).alias("entity"), "served_by", "degraded")


def capitals(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 50) -> DataFrame:
    """key, pos, entity: the first words of over three letters that begin with a capital, without punctuation at their ends."""
    named = F.filter(F.transform(X.words(text), lambda w, i: F.struct(i.alias("pos"), F.regexp_replace(w, r"^[.,;:!?()\"']+|[.,;:!?()\"']+$", "").alias("entity"))), lambda e: (F.length(e["entity"]) > 3) & e["entity"].rlike(r"^\p{Lu}"))
    return docs.select(key, F.explode(F.slice(named, 1, most)).alias("e")).select(key, "e.*")


def cooccurrences(found: DataFrame, reach: int = 10, key: str = "doc_id") -> DataFrame:
    """key, entity, other, strength 1 / (distance + 1): entities within `reach` places of each other, earlier one first. A band join on blocks of `reach` places."""
    block = F.floor(F.col("pos") / reach)
    a = found.select(key, "pos", "entity", F.explode(F.array(block, block + 1)).alias("block"))
    b = found.select(F.col(key).alias("_k"), F.col("pos").alias("_p"), F.col("entity").alias("other"), block.alias("_b"))
    near = a.join(b, (a[key] == b["_k"]) & (a["block"] == b["_b"]) & (F.col("_p") > F.col("pos")) & (F.col("_p") <= F.col("pos") + reach))
    return near.select(key, "entity", "other", (1 / (F.col("_p") - F.col("pos") + 1)).alias("strength"))


def fuzzy(entities: DataFrame, query: str, within: int | None = 2, least: float = 0.0, types: list[str] | None = None, confidence: float = 0.0, k: int = 10, name: str = "name") -> DataFrame:
    """Entities whose name is near a query, with distance and similarity: exact ones first, then by distance, length and name.

    Near: at most `within` edits, or all the query's words among the name's; 0, or least 1.0, asks
    for equal names; None for names that hold the query (begin with it, if it has two letters or fewer).
    """
    q = query.strip().lower()
    if not q or k <= 0:
        return entities.limit(0).select("*", F.lit(0).alias("distance"), F.lit(0.0).alias("similarity"))
    low, asked = F.lower(name), F.lit(q)
    distance = F.levenshtein(low, asked)
    subset = (F.size(F.array_except(X.tokens(asked), X.tokens(low))) == 0) & (F.size(X.tokens(asked)) > 0)
    if least == 1.0 or within == 0:
        near = low == asked
    elif within is None:
        near = F.startswith(low, asked) if len(q) <= 2 else F.contains(low, asked)
    else:
        near = (distance <= within) | subset
    pool = entities if not types else entities.where(F.upper("entity_type").isin([t.upper() for t in types]))
    pool = pool if not confidence else pool.where(F.col("confidence") >= confidence)
    found = pool.where(near).withColumns({"distance": distance, "similarity": X.similarity(low, asked)}).where(F.col("similarity") >= least)
    return top_k(found, k, "distance", F.length(name), name)


def named_in(names: DataFrame, queries: DataFrame, name: str = "name", query: str = "text", key: str = "item_id", most: int = 10) -> DataFrame:
    """key, name: known names that a query holds, the first by name."""
    pairs = terms.holding(queries.select(key, query), names.select(F.col(name).alias("_name")).distinct(), query, "_name")
    return top_k_per(pairs.select(key, F.col("_name").alias(name)), key, most, name).drop("rank")


def without_overlaps(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of entities of a text that overlap, in order of start, the one of higher confidence, the earlier of equals. A text's entities are folded in one array."""
    item = F.struct("start", "finish", F.col("confidence"), "entity")
    begin = F.expr("cast(array() as array<struct<start: int, finish: int, confidence: double, entity: string>>)")

    def step(kept: Column, e: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = F.size(kept).eqNullSafe(0) | (last["finish"] <= e["start"])
        better = last["confidence"] < e["confidence"]
        return F.when(apart, F.concat(kept, F.array(e))).when(better, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(e))).otherwise(kept)

    folded = found.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(item)), begin, step).alias("e"))
    return folded.select(key, F.explode("e").alias("e")).select(key, "e.*")


def most_common(found: DataFrame, k: int = 20) -> DataFrame:
    """entity, entity_type, n: the most frequent."""
    return top_k(found.groupBy("entity", "entity_type").agg(F.count(F.lit(1)).alias("n")), k, F.desc("n"), "entity", "entity_type")


def linked(entities: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: linked and orphaned entities, completeness (percent of linked ones, two digits)."""
    known = docs.select(key).distinct().withColumn("_known", F.lit(True))
    n, ok = F.count(F.lit(1)), F.count("_known")
    return entities.join(known, key, "left").agg(ok.alias("linked"), (n - ok).alias("orphaned"), F.round(F.coalesce(ok * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)), 2).alias("completeness"))
