"""Secrets in texts: credential patterns, and strings that a battery of randomness tests finds.

Tested strings are runs of at least MIN_RANDOM letters, digits and `+/_=-` that hold a letter and
overlap no pattern's match. Their encoding is inferred from their characters (letters of one case,
hexadecimal, base 32, lower-case base 36, base 64). Three statistics are compared with what a
readable identifier of that length would show: chi-squared against a uniform alphabet, runs of one
character class (of vowels and consonants where there are only letters), and correlation of
neighbouring symbols. Their normal scores are added into one. What that sum is for readable strings
of the corpus is read off the lower part of its scores (calibration), as the three are not quite
independent and corpora differ. Within each encoding and class of lengths, the Benjamini-Hochberg rule at
RATE decides over the strings of all texts which are random: longer strings have sharper statistics
and are not held to the short ones' threshold. Scores and p-values are rounded towards readable, so
that their ranks come from histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlight.llm.shared import cut

#: The patterns; fixed values. A match of `assign` whose value has under 6 characters is dropped.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
MIN_VALUE, MIN_RANDOM = 6, 20
RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
RATE, STEPS = 0.01, 20
#: Strings from which on a group's scores are calibrated; the bounds of the centre and of the spread that readable strings are granted.
CALIBRATED, CENTRE, SPREAD = 50, (-1.0, 1.0), (0.6, 2.0)
KINDS = ("assign", "access", "hex", "random")
#: Places are summed in blocks of this many matches, so that a text with very many isn't quadratic.
BLOCK = 128
#: Per encoding: pattern, alphabet (of the lower-cased string if it has no capitals), and of readable identifiers excess of repeats, share of class changes and correlation of neighbouring symbols.
ENCODINGS = (
    ("letters", r"^(?:[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.72, 0.67, 0.0),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 1.0, 0.2, 0.35),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1, 0.1, 0.35),
    ("base36", r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 1.4, 0.1, 0.35),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 3.2, 0.25, 0.0),
)
#: How far one kind of readable identifier is from another: standard deviations of the excess (as a share of it), of the share of class changes and of the correlation.
EXCESS_SPREAD, CHANGES_SPREAD, CORRELATION_SPREAD = 0.25, 0.08, 0.15
#: Weight of the serial correlation beside the other two, which tell more.
SERIAL = 0.5


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def places(df: DataFrame, text: str, pattern: str, name: str, value: bool = False) -> DataFrame:
    """df with an array `name` of the matches' bounds in code points (a, b), their strings s and, if asked for, the length v of the first group."""
    at = lambda c: f"_{name}_{c}"
    lit = F.lit(pattern)
    df = df.withColumn(at("s"), F.regexp_extract_all(text, lit, F.lit(0)))
    if value:
        df = df.withColumn(at("v"), F.transform(F.regexp_extract_all(text, lit, F.lit(1)), F.length))
    some = F.size(at("s")) > 0
    df = df.withColumn(at("gap"), F.when(some, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array(F.lit(0))))
    df = df.withColumn(at("step"), F.transform(at("s"), lambda s, i: F.length(s) + F.get(at("gap"), i)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(at("step")) / BLOCK).cast("int")), lambda k: _total(F.slice(at("step"), k * BLOCK + 1, BLOCK)))
    df = df.withColumn(at("sum"), blocks).withColumn(at("upto"), F.transform(at("sum"), lambda _, k: _total(F.slice(at("sum"), F.lit(1), k))))

    def bounds(s: Column, i: Column) -> Column:
        k = F.floor(i / BLOCK).cast("int")
        begin = F.get(at("upto"), k) + _total(F.slice(at("step"), k * BLOCK + 1, i - k * BLOCK)) + F.get(at("gap"), i)
        more = (F.get(at("v"), i).alias("v"),) if value else ()
        return F.struct(begin.alias("a"), (begin + F.length(s)).alias("b"), s.alias("s"), *more)

    return df.withColumn(name, F.transform(at("s"), bounds)).drop(*(at(c) for c in ("s", "v", "gap", "step", "sum", "upto")))


def _phi(z: Column) -> Column:
    """The normal distribution function, within 0.0002; monotone in its tails."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))


def battery(s: Column) -> Column:
    """For a string: group (encoding and class of lengths) and z, its score: how far it is from a readable identifier towards a random string, in standard deviations."""
    out = None
    for code, (name, pattern, alphabet, excess, changes, correlation) in reversed(list(enumerate(ENCODINGS))):
        body = F.lower(s) if name in ("hex", "letters") else s
        symbols = F.transform(F.split(body, ""), _number(alphabet))
        scored = _score(symbols, F.split(body if name == "letters" else s, ""), len(alphabet), excess, changes, correlation, name == "letters")
        one = F.struct((F.lit(code * 4) + _length_class(F.length(s))).alias("group"), scored.alias("z"))
        out = one if out is None else F.when(s.rlike(pattern), one).otherwise(out)
    return out


def _number(alphabet: str):
    return lambda c: F.instr(F.lit(alphabet), c)


def _length_class(n: Column) -> Column:
    return F.when(n < 28, 0).when(n < 40, 1).when(n < 64, 2).otherwise(3)


def _score(symbols: Column, letters: Column, k: int, excess: float, changes: float, correlation: float, vowels: bool) -> Column:
    """The score from symbol numbers and the string's characters. Readable letters change between vowels and consonants more often than random ones, other classes less often."""
    start = F.struct(
        *(F.lit(0.0).alias(c) for c in ("n", "x", "xx", "xy", "first", "last", "changed")), F.lit(-1).alias("kind")
    )
    kind_of = lambda x: x.rlike("[aeiouy]").cast("int") if vowels else F.when(x.rlike("[0-9]"), 0).when(x.rlike("[a-z]"), 1).when(x.rlike("[A-Z]"), 2).otherwise(3)

    def step(a: Column, p: Column) -> Column:
        x, kind = p["x"].cast("double"), p["kind"]
        begun = a["n"] > 0
        return F.struct(
            (a["n"] + 1).alias("n"),
            (a["x"] + x).alias("x"),
            (a["xx"] + x * x).alias("xx"),
            (a["xy"] + F.when(begun, a["last"] * x).otherwise(0.0)).alias("xy"),
            F.when(begun, a["first"]).otherwise(x).alias("first"),
            x.alias("last"),
            (a["changed"] + F.when(begun & (kind != a["kind"]), 1.0).otherwise(0.0)).alias("changed"),
            kind.alias("kind"),
        )

    pairs = F.zip_with(symbols, letters, lambda x, c: F.struct(x.alias("x"), kind_of(c).alias("kind")))
    squares = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(k)), lambda v: F.size(F.filter(symbols, lambda x: x == v)).cast("double")), F.lit(0.0), lambda a, c: a + c * c
    )

    def finish(a: Column) -> Column:
        n = a["n"]
        chi = squares * k / n - n
        more = (n - 1) * excess
        z_chi = ((k - 1) + more - chi) / F.sqrt(2.0 * (k - 1) + 4 * more + F.pow(EXCESS_SPREAD * more, F.lit(2)))
        z_runs = (-1 if vowels else 1) * (a["changed"] - (n - 1) * changes) / F.sqrt((n - 1) * changes * (1 - changes) + F.pow(CHANGES_SPREAD * (n - 1), F.lit(2)))
        spread = n * a["xx"] - a["x"] * a["x"]
        r = F.when(spread > 0, (n * (a["xy"] + a["last"] * a["first"]) - a["x"] * a["x"]) / spread).otherwise(1.0)
        z_serial = (correlation - r) / F.sqrt(1 / n + CORRELATION_SPREAD**2)
        return (z_chi + z_runs + SERIAL * z_serial) / F.sqrt(F.lit(2.0 + SERIAL**2))

    return F.aggregate(pairs, start, step, finish)


def calibration(scores: DataFrame) -> dict[int, tuple[float, float]]:
    """For each group of at least CALIBRATED strings the centre and spread of its readable strings' scores (group, z); others keep 0 and 1.

    Random strings lie at the upper end, so a normal curve is laid through the points below which
    5 % and 25 % of the scores lie. Where most strings aren't readable, as in a store of keys,
    CENTRE and SPREAD bound what is taken for readable. A histogram of at most 20 groups leaves the aggregation.
    """
    counts = scores.groupBy("group", F.floor(F.greatest(F.least("z", F.lit(40.0)), F.lit(-40.0)) * STEPS).alias("bin")).count()
    whole = Window.partitionBy("group")
    ranked = counts.select("group", "bin", F.sum("count").over(whole).alias("m"), F.sum("count").over(whole.orderBy("bin")).alias("upto"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("m") * q, F.col("bin")))
    found = ranked.groupBy("group").agg(F.first("m").alias("m"), at(0.05).alias("a"), at(0.25).alias("b")).where(F.col("m") >= CALIBRATED).collect()
    out = {}
    for r in found:
        spread = min(max((r["b"] - r["a"] + 1) / STEPS / (1.645 - 0.674), SPREAD[0]), SPREAD[1])
        out[r["group"]] = min(max(r["b"] / STEPS + 0.674 * spread, CENTRE[0]), CENTRE[1]), spread
    return out


def step(z: Column, group: Column, known: dict[int, tuple[float, float]]) -> Column:
    """A twentieth of the negative power of ten of the score's p-value, rounded down."""
    centre, spread = F.lit(0.0), F.lit(1.0)
    for g, (c, w) in known.items():
        centre, spread = F.when(group == g, c).otherwise(centre), F.when(group == g, w).otherwise(spread)
    p = _phi(-(z - centre) / spread)
    return F.floor(F.least(F.lit(40.0), -F.log10(F.greatest(p, F.lit(1e-40)))) * STEPS).cast("int")


def thresholds(scores: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each group the least step that the Benjamini-Hochberg rule accepts, from scores (group, step) of all strings; groups in which none is accepted are left out.

    Only a histogram of at most 20 groups by 801 steps leaves the aggregation.
    """
    counts = scores.groupBy("group", "step").count()
    whole = Window.partitionBy("group")
    ranked = counts.select(
        "group", "step", F.sum("count").over(whole).alias("m"), F.sum("count").over(whole.orderBy(F.desc("step"))).alias("rank")
    )
    accepted = ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("rank") / F.col("m"))
    return {r["group"]: r["least"] for r in accepted.groupBy("group").agg(F.min("step").alias("least")).collect()}


def _blocks(spans: str) -> Column:
    """Sorted spans in runs of about the root of their number, with the bounds of each run."""
    n = F.size(spans)
    width = F.greatest(F.lit(16), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(0), ((n - 1) / width).cast("int")), lambda k: F.slice(spans, k * width + 1, width)))
    return F.transform(F.coalesce(runs, F.array().cast("array<array<struct<a:int,k:int,b:int>>>")), lambda r: F.struct(F.get(r, F.lit(0))["a"].alias("a"), F.array_max(F.transform(r, lambda o: o["b"])).alias("b"), r.alias("of")))


def find(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, found: the spans (a, k, b) of every text in order of start and kind, k a place in KINDS.

    Null texts are empty and have no spans. Each row is its own document; doc_ids may be null or
    repeat. Other columns are ignored; an empty table gives no rows.
    """
    df = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    df = places(df, "text", ASSIGN, "assign", value=True)
    for name, pattern in (("access", ACCESS), ("hex", HEX), ("random", RANDOM)):
        df = places(df, "text", pattern, name)
    span = lambda k: lambda m: F.struct(m["a"].alias("a"), F.lit(k).alias("k"), m["b"].alias("b"))
    base = F.concat(F.transform(F.filter("assign", lambda m: m["v"] >= MIN_VALUE), span(0)), F.transform("access", span(1)), F.transform("hex", span(2)))
    df = df.select("doc_id", F.array_sort(base).alias("base"), "random").withColumn("runs", _blocks("base"))
    meets = lambda o, m: (o["a"] < m["b"]) & (m["a"] < o["b"])
    # of the base spans only the runs that reach a string are looked through
    free = lambda runs: F.filter("random", lambda m: ~F.exists(runs, lambda r: meets(r, m) & F.exists(r["of"], lambda o: meets(o, m))))
    apart = F.get(F.transform(F.array("runs"), free), F.lit(0))  # within a lambda, a column's expression would run for every string
    tested = F.transform(apart, lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), battery(m["s"]).alias("t")))
    kept = cut(df.select("doc_id", "base", tested.alias("tested")))
    scores = kept.select(F.explode("tested.t").alias("t")).select("t.*")
    known = calibration(scores)
    least = thresholds(scores.select("group", step(F.col("z"), F.col("group"), known).alias("step")))
    limit = F.create_map(*(F.lit(x) for pair in least.items() for x in pair)) if least else None
    accept = lambda m: F.coalesce(step(m["t"]["z"], m["t"]["group"], known) >= F.try_element_at(limit, m["t"]["group"]), F.lit(False)) if least else F.lit(False)
    added = F.transform(F.filter("tested", accept), lambda m: F.struct(m["a"].alias("a"), F.lit(3).alias("k"), m["b"].alias("b")))
    return kept.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("found"))


def _listed(spans: str) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(kinds, m["k"]), m["a"], m["b"])), ",")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the patterns' spans as kind:start:end), spans (all of them, listed alike), n_random. What find says of nulls, repeats and empty tables holds."""
    count = lambda k: F.size(F.filter("found", lambda m: m["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return find(documents).select("doc_id", count(0), count(1), count(2), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("found").alias("spans"), count(3))
