"""Text expressions. Null texts count as empty unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and weights whose change would change results.
MEDICAL_TERMS = ("symptom", "disease", "treatment", "drug", "medication", "therapy", "covid", "diabetes", "cancer", "heart", "blood", "pain", "fever")
RELEVANCE_TERMS = ("patient", "treatment", "disease", "clinical", "medical", "therapy", "diagnosis", "symptom", "drug", "medication", "hospital", "doctor", "health", "medicine", "study", "trial", "research", "analysis")
SCIENCE_TERMS = ("study", "research", "analysis", "treatment", "diagnosis", "therapy", "clinical", "patient", "mechanism", "pathway")
COMPLEXITY = (
    ("basic", ("what is", "define", "name", "identify"), 100, "intermediate"),
    ("intermediate", ("how does", "why does", "explain", "describe"), 200, "advanced"),
    ("advanced", ("analyze", "evaluate", "compare", "synthesize", "integrate"), None, None),
)
QUERY_TYPES = (
    ("factual", ("what", "how", "why", "when", "where")),
    ("treatment", ("treat", "cure", "prevent", "manage")),
    ("diagnostic", ("symptom", "sign", "cause")),
)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(text: Column | str) -> Column:
    return F.coalesce(_col(text).cast("string"), F.lit(""))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(filled(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(text: Column | str) -> Column:
    """What white space separates."""
    return F.filter(F.split(filled(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def sentences(text: Column | str) -> Column:
    """Split after . ! or ? at white space; trimmed, none empty."""
    parts = F.split(filled(text), r"(?<=[.!?])[ \t\n\r\f\x0B]+")
    return F.filter(F.transform(parts, collapse), lambda s: s != "")


def collapse(text: Column | str) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"[ \t\n\r\f\x0B]+", " "))


def clean(text: Column | str) -> Column:
    """Without characters other than letters, digits, underscores, white space and . , ; : ! ? - ( ); white space collapsed."""
    return collapse(F.regexp_replace(filled(text), r"[^\p{L}\p{N}_\s.,;:!?()-]", " "))


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))


def how_many_of(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(t)).cast("int") for t in terms))


def query_variants(query: Column | str, n: int = 4) -> Column:
    """The query and rewritten forms of it, n in all at most, by the question word it holds."""
    q = filled(query)
    low = F.lower(q)

    def without(*cut: str) -> Column:
        return F.trim(reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), cut, low))

    def forms(base: Column, *suffixes: str, listed: bool = False) -> Column:
        made = [F.concat(base, F.lit(f" {s}")) for s in suffixes]
        return F.array(q, *made, *([F.concat(F.lit("list of "), base)] if listed else []))

    out = (
        F.when(any_of(low, ("what are", "what is")), forms(without("what are the ", "what is the ", "what are ", "what is ", "?"), "overview", "details", listed=True))
        .when(any_of(low, ("how",)), forms(without("how to ", "how ", "?"), "methods", "process", "steps"))
        .when(any_of(low, ("why",)), forms(without("why ", "?"), "reasons", "causes", "explanation"))
        .otherwise(forms(q, "overview", "details", "information"))
    )
    return F.slice(out, 1, n)


def query_strategy(query: Column | str) -> Column:
    """A struct: matches of medical terms, their share of the words (density), the type of the query and the strategy it suggests."""
    low, n = F.lower(filled(query)), F.size(words(query))
    found = how_many_of(low, MEDICAL_TERMS)
    density = F.when(n == 0, F.lit(0.0)).otherwise(found / n)
    kind = reduce(lambda w, x: w.when(any_of(low, x[1]), x[0]), QUERY_TYPES[1:], F.when(any_of(low, QUERY_TYPES[0][1]), QUERY_TYPES[0][0])).otherwise("general")
    plan = F.when(density > 0.3, "kg_primary").when(found > 0, "kg_vector_hybrid").otherwise("vector_primary")
    return F.struct(found.alias("matches"), density.alias("density"), kind.alias("query_type"), plan.alias("strategy"))


def similarity(a: Column | str, b: Column | str) -> Column:
    """One less the Levenshtein distance over the longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def density(text: Column | str) -> Column:
    """Distinct words over words, 0 without words."""
    w = words(text)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(w)) / F.size(w))


def readability(text: Column | str) -> Column:
    """1 / (1 + words per sentence / 20), 0 without words."""
    n, s = F.size(words(text)), F.size(sentences(text))
    return F.when((n == 0) | (s == 0), F.lit(0.0)).otherwise(1 / (1 + n / s / 20))


def coverage(text: Column | str, terms: tuple[str, ...] = RELEVANCE_TERMS) -> Column:
    """The share of the terms that occur."""
    return how_many_of(F.lower(filled(text)), terms) / len(terms)


def quality(title: Column, abstract: Column, body: Column) -> Column:
    """Weights for a title of 3 words, an abstract of 50, a body of 500 or 1000, and the coverage of relevant terms; 1 at most."""
    n = F.size(words(body))
    whole = F.concat_ws(" ", filled(title), filled(abstract), filled(body))
    parts = (
        F.when(F.size(words(title)) >= 3, 0.2).otherwise(0.0),
        F.when(F.size(words(abstract)) >= 50, 0.3).otherwise(0.0),
        F.when(n >= 1000, 0.2).when(n >= 500, 0.1).otherwise(0.0),
        0.3 * coverage(whole),
    )
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def informativeness(text: Column | str, entities: tuple[str, ...] = MEDICAL_TERMS) -> Column:
    """Entities, measured numbers, terms of science and a fitting length, each with a ceiling; 1 at most."""
    low, n = F.lower(filled(text)), F.size(words(text))
    measured = F.regexp_count(low, F.lit(r"[0-9]+\.?[0-9]*\s*(%|mg|ml|years?|patients?|subjects?)"))
    parts = (
        F.least(how_many_of(low, entities) / 10, F.lit(0.4)),
        F.least(measured / 5, F.lit(0.2)),
        F.least(how_many_of(low, SCIENCE_TERMS) / 8, F.lit(0.3)),
        F.when(n.between(50, 200), 0.1).otherwise(0.0),
    )
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def best_domain(text: Column | str, domains: dict[str, tuple[str, ...]], default: str) -> Column:
    """The domain with most of its terms in the text, the first named of equals; the default without any."""
    low = F.lower(filled(text))
    scored = F.array(*(F.struct(how_many_of(low, terms).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(domains.items())))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def complexity(question: Column | str, answer: Column | str) -> Column:
    """basic, intermediate or advanced: by words of the question, raised for long answers; by the answer's length without such words."""
    low, n = F.lower(filled(question)), F.size(words(answer))
    by_length = F.when(n < 50, "basic").when(n < 150, "intermediate").otherwise("advanced")
    out = by_length
    for level, cues, limit, above in reversed(COMPLEXITY):
        named = F.lit(level) if limit is None else F.when(n > limit, above).otherwise(level)
        out = F.when(any_of(low, cues), named).otherwise(out)
    return out


def hash_embedding(text: Column | str, dim: int) -> Column:
    """A vector from the MD5 of a text: its bytes as (x - 127.5) / 127.5, repeated to dim components."""
    digest = F.md5(F.encode(filled(text), "utf-8"))
    byte = lambda i: F.conv(F.substr(digest, (i % 16) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (byte(i) - 127.5) / 127.5)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by | (null: empty)."""
    return F.sha2(F.concat_ws("|", *(filled(p) for p in parts)), 256)


def lenient_array(text: Column | str) -> Column:
    """Strings of a JSON array within a text, from its first [ to its last ]; parts between commas where that isn't JSON."""
    t = filled(text)
    inner = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    parsed = F.from_json(inner, "array<string>")
    loose = F.filter(F.transform(F.split(F.regexp_replace(t, r"[\[\]\"]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((inner != "") & parsed.isNotNull(), parsed).otherwise(loose)


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, rounded up: what stands in for a model's tokenizer."""
    return F.ceil(F.length(filled(text)) / 4)
