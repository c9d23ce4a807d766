"""Concepts (id, label, synonyms) and relations (src, type, dst): inference and query expansion."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.operators import terms
from loomlight.operators.common import cut

# Words of a label that refine its concept's group, in order of precedence.
CATEGORIES = {
    "entity": ("person", "organization", "location", "place"),
    "concept": ("concept", "idea", "notion", "principle"),
    "process": ("process", "procedure", "method", "workflow"),
    "resource": ("resource", "material", "substance", "component"),
    "event": ("event", "occurrence", "incident", "activity"),
    "quality": ("quality", "attribute", "property", "characteristic"),
}
TRANSITIVE, SYMMETRIC = ("is_a", "part_of"), ("related_to", "equivalent_to")


def ancestors(is_a: DataFrame, depth: int | None = 10) -> DataFrame:
    """node, ancestor, distance (the least), from edges (child, parent), up to so many steps, or all with None; cycles end where nothing new is reached."""
    step = cut(is_a.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    front, out = step.withColumn("distance", F.lit(1)), []
    seen = step
    for d in count(2):
        out.append(front)
        if depth is not None and d > depth:
            break
        up = front.select("node", F.col("ancestor").alias("via")).join(step.select(F.col("node").alias("via"), "ancestor"), "via").select("node", "ancestor").distinct()
        new = cut(up.join(seen, ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        seen, front = seen.union(new), new.withColumn("distance", F.lit(d))
    return reduce(lambda a, b: a.union(b), out)


def descendants(is_a: DataFrame, depth: int = 10) -> DataFrame:
    """node, descendant, distance."""
    return ancestors(is_a, depth).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "distance")


def common_ancestors(up: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, ancestor for pairs (a, b), from ancestors(...)."""
    left, right = up.select(F.col("node").alias("a"), "ancestor"), up.select(F.col("node").alias("b"), "ancestor")
    return pairs.join(left, "a").join(right, ["b", "ancestor"]).select("a", "b", "ancestor")


def subsumption(is_a: DataFrame) -> DataFrame:
    """src, type, dst, confidence: ancestors without a direct edge."""
    direct = is_a.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    return ancestors(is_a).select("node", "ancestor").join(direct, ["node", "ancestor"], "left_anti").select(F.col("node").alias("src"), F.lit("is_a").alias("type"), F.col("ancestor").alias("dst"), F.lit(0.9).alias("confidence"))


def transitivity(relations: DataFrame, types: tuple[str, ...] = TRANSITIVE, depth: int = 5) -> DataFrame:
    """src, type, dst, confidence: chains of 2 to depth + 1 relations of a type; max(0.5, 0.9 - 0.1 per link after the first)."""
    out = []
    for kind in types:
        up = ancestors(relations.where(F.col("type") == kind).select(F.col("src").alias("child"), F.col("dst").alias("parent")), depth + 1).where("distance > 1 and node != ancestor")
        out.append(up.select(F.col("node").alias("src"), F.lit(kind).alias("type"), F.col("ancestor").alias("dst"), F.greatest(F.lit(0.5), 0.9 - 0.1 * (F.col("distance") - 1)).alias("confidence")))
    return reduce(lambda a, b: a.union(b), out)


def symmetry(relations: DataFrame, types: tuple[str, ...] = SYMMETRIC) -> DataFrame:
    """src, type, dst, confidence: the inverses that are missing, at 0.9 of the confidence."""
    some = relations.where(F.col("type").isin(*types))
    turned = some.select(F.col("dst").alias("src"), "type", F.col("src").alias("dst"), (F.col("confidence") * 0.9).alias("confidence"))
    return turned.join(some.select("src", "type", "dst"), ["src", "type", "dst"], "left_anti").select("src", "type", "dst", "confidence")


def by_rules(facts: DataFrame, rules: list[dict]) -> DataFrame:
    """src, type, dst, confidence, rule: for each rule (name, priority, where: column -> value, type, dst, confidence) in order of priority the facts that meet all its conditions. Rules are few and written by hand."""
    out = []
    for rule in sorted(rules, key=lambda r: (-r["priority"], r["name"])):
        met = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in rule["where"].items()))
        out.append(facts.where(met).select("src", F.lit(rule["type"]).alias("type"), F.lit(rule["dst"]).alias("dst"), F.lit(rule["confidence"]).alias("confidence"), F.lit(rule["name"]).alias("rule")))
    return reduce(lambda a, b: a.union(b), out)


def best(inferred: DataFrame, least: float = 0.5) -> DataFrame:
    """Of equal relations the highest confidence, if it is at least `least`."""
    return inferred.groupBy("src", "type", "dst").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= least)


def infer_all(relations: DataFrame) -> DataFrame:
    """All that subsumption, transitivity and symmetry add."""
    is_a = relations.where("type = 'is_a'").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    return best(subsumption(is_a).union(transitivity(relations)).union(symmetry(relations)))


def cycles(is_a: DataFrame, depth: int | None = None) -> DataFrame:
    """node: those that are their own ancestors, however long the way round, or within depth steps."""
    return ancestors(is_a, depth).where("node = ancestor").select("node").distinct()


def similarity(is_a: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity: the share of ancestors in common, 1 for a concept and itself, 0 for two roots."""
    sets = cut(ancestors(is_a).groupBy("node").agg(F.collect_set("ancestor").alias("up")))
    none = F.array().cast("array<string>")
    j = pairs.join(sets.select(F.col("node").alias("a"), F.col("up").alias("x")), "a", "left").join(sets.select(F.col("node").alias("b"), F.col("up").alias("y")), "b", "left")
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    all_ = F.size(F.array_union(x, y))
    return j.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).when(all_ == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / all_).alias("similarity"))


def matched(concepts: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, text, id, term: concepts whose label or a synonym a text holds."""
    names = concepts.select("id", F.explode(F.array_union(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("term"))
    return terms.holding(queries.select(key, text), names, text).select(key, text, "id", "term")


def expand(concepts: DataFrame, is_a: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, kind, term: for every concept in a query its first 3 synonyms, 2 parents and 3 children in order."""
    hit = cut(matched(concepts, queries, key, text).select(key, "id").distinct())
    first = lambda x, n: F.slice(F.array_sort(F.array_distinct(x)), 1, n)
    label = concepts.select(F.col("id").alias("other"), "label")
    synonyms = hit.join(concepts, "id").select(key, F.lit("synonym").alias("kind"), F.explode(first(F.col("synonyms"), 3)).alias("term"))
    up = hit.join(is_a, F.col("id") == F.col("child")).join(label, F.col("parent") == F.col("other")).groupBy(key, "id").agg(F.collect_set("label").alias("t"))
    down = hit.join(is_a, F.col("id") == F.col("parent")).join(label, F.col("child") == F.col("other")).groupBy(key, "id").agg(F.collect_set("label").alias("t"))
    parents = up.select(key, F.lit("parent").alias("kind"), F.explode(first(F.col("t"), 2)).alias("term"))
    children = down.select(key, F.lit("child").alias("kind"), F.explode(first(F.col("t"), 3)).alias("term"))
    return synonyms.union(parents).union(children).distinct()


def extract(concepts: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, id, term, start, finish, confidence: the first place of each label or synonym in a text."""
    found = matched(concepts, docs, key, text)
    start = F.instr(F.lower(text), F.lower("term")) - 1
    return found.select(key, "id", "term", start.alias("start"), (start + F.length("term")).alias("finish"), F.lit(0.9).alias("confidence"))


def domain(text: Column | str, domains: dict[str, tuple[str, ...]]) -> Column:
    """The domain with the largest share of its keywords in a text; general without any."""
    low = F.lower(X.filled(text))
    scored = F.array(*(F.struct((X.how_many_of(low, words) / len(words)).alias("s"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(domains.items())))
    top = F.array_max(scored)
    return F.when(top["s"] > 0, top["name"]).otherwise("general")


def mappings(concepts: DataFrame, kind: str = "type", categories: dict[str, tuple[str, ...]] = CATEGORIES) -> DataFrame:
    """entity_type, terms: names for groups of concepts (id, label, synonyms, kind), with all their labels and synonyms in lower case, sorted.

    A group is a kind and the first category of which the label has a word. It is named after the most frequent word of three letters or more in its labels (letters A to Z alone,
    upper-cased; of equally frequent ones that of the smallest id, the earlier in the label), or without any after the group. Groups that come by the same name are one.
    """
    has = lambda words: F.arrays_overlap(F.split(F.lower("label"), r"\s+"), F.array(*map(F.lit, words)))
    category = F.coalesce(*(F.when(has(words), name) for name, words in categories.items()))
    grouped = concepts.where("label is not null").withColumn("group", F.concat_ws("_", F.coalesce(F.col(kind), F.lit("")), category))
    words = grouped.select("group", "id", F.posexplode(F.split("label", r"\s+")).alias("at", "word")).withColumn("word", F.upper(F.regexp_replace("word", "[^a-zA-Z]", "")))
    counts = words.where(F.length("word") > 2).groupBy("group", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("first"))
    names = counts.groupBy("group").agg(F.min_by("word", F.struct(-F.col("n"), "first")).alias("name"))
    # groups are few, terms many: names go to the terms by group, and repeats are dropped before terms are gathered
    synonyms = F.filter(F.coalesce("synonyms", F.array().cast("array<string>")), lambda x: x.isNotNull())
    terms_ = grouped.select("group", F.explode(F.transform(F.concat(F.array("label"), synonyms), lambda x: F.lower(x))).alias("term")).distinct()
    named = terms_.join(names, "group", "left").select(F.coalesce("name", F.replace(F.upper("group"), F.lit("_"), F.lit("_TYPE_"))).alias("entity_type"), "term")
    return named.distinct().groupBy("entity_type").agg(F.array_sort(F.collect_list("term")).alias("terms"))
