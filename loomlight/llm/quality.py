"""A quality classifier of sparse rules.

Trees are grown on statistics of texts; every path from a root to a node is a conjunction of
comparisons, a rule. A lasso logistic regression weighs the rules and drops most. What is left
becomes one column expression, so scoring runs no Python and no model object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.llm.shared import cut, sized

#: At most this many labelled rows are fitted, those with the least hash of their id; statistics and scores cover all rows.
FIT_ROWS = 20_000
TREES, DEPTH, LASSO, CUTOFF, SEED = 24, 4, 0.002, 0.7, 7

Rule = tuple[tuple[str, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Steps that compute the statistics of a text, each over columns of the steps before; names with an underscore in front are aids."""
    words = F.col("_words")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length("_text"), F.lit(1)).cast("double")
    lines = F.col("_lines")
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)) / chars
    return {
        "_text": F.coalesce(text.cast("string"), F.lit("")),
        "_words": F.filter(F.split("_text", "[ \\n\\t]+"), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\\n"), lambda s: s != ""),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length("_text") / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "repeated_neighbours": F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))) / n,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)).cast("double"),
        "capitals": count(r"\p{Lu}"),
        "digits": count("[0-9]"),
        "symbols": count("[#$%&*!|<>{}\\[\\]^~@=_+\\\\]"),
        "stops": count("[.,;:?]"),
    }


FEATURES = ("log_words", "word_length", "distinct_words", "repeated_neighbours", "short_words", "distinct_lines", "capitals", "digits", "symbols", "stops")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the FEATURES after its columns; a null text counts as empty."""
    steps = statistics(F.col(text))
    first = {k: v for k, v in steps.items() if k == "_text"}
    split = {k: v for k, v in steps.items() if k in ("_words", "_lines")}
    rest = {k: v for k, v in steps.items() if not k.startswith("_")}
    return df.withColumns(first).withColumns(split).withColumns(rest).drop("_text", "_words", "_lines")


def paths(tree: str) -> list[Rule]:
    """The rules of a tree in Spark ML's printed form: one for each node but the root."""
    out, path = [], []
    for line in tree.splitlines():
        depth = (len(line) - len(line.lstrip())) // 1
        if found := re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line):
            path = [p for p in path if p[0] < depth] + [(depth, (FEATURES[int(found[2])], found[3], float(found[4])))]
            out.append(tuple(p[1] for p in path))
    return out


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, value in rule:
        out &= (F.col(name) <= value) if sign == "<=" else (F.col(name) > value)
    return out


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights, and an intercept."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    #: Whether any label was seen.
    fitted: bool = True

    def score(self) -> Column:
        """The probability of label 1, over the columns FEATURES."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(rows: DataFrame) -> RuleModel:
    """A model of rows: FEATURES and label (0.0 or 1.0), few enough for the driver's choice of FIT_ROWS. Without rows, or with one label only, the score is a constant."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return RuleModel(0.0 if not counts else 5.0 if 1.0 in counts else -5.0, (), bool(counts))
    data = cut(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", "label", *FEATURES))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(1, min(20, sum(counts.values()) // 50)), featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=SEED
    ).fit(data)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString)})
    columns = [f"r{k}" for k in range(len(rules))]
    marked = data.select("label", *(holds(rule).cast("double").alias(c) for rule, c in zip(rules, columns)))
    marked = cut(VectorAssembler(inputCols=columns, outputCol="x").transform(marked).select("x", "label"))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(marked)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(lasso.intercept, tuple((rule, w) for rule, w in zip(rules, weights) if w))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> RuleModel:
    """Fits on labelled documents whose id isn't held out.

    Labels other than 0 and 1, and those without an id, are ignored; of an id with several labels
    the largest counts. At most FIT_ROWS labelled ids with a document are taken.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("label")).where("_id is not null and label in (0, 1)").where(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("label").alias("label")).join(documents.select(F.col(doc_id).alias("_id")), "_id", "left_semi")
    known = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS))
    rows = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(sized(known, 24), "_id")
    chosen = cut(with_statistics(rows).select("_id", "label", *FEATURES).orderBy(F.xxhash64("_id"), *FEATURES).limit(FIT_ROWS))
    return fit(chosen)


def score(documents: DataFrame, model: RuleModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 where the score is at least CUTOFF) of every row; null texts are scored as empty, repeated rows each get a row, other columns are ignored."""
    rows = with_statistics(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents predicted to be good, with their own columns; all of them where no document has a label to fit.

    Rows that pass come out of a generator: a filter would be pushed below the statistics, and each
    rule would compute those it names anew.
    """
    model = train(documents, labels, doc_id, text)
    if not model.fitted:
        return documents
    marks = with_statistics(documents.select(F.struct("*").alias("_row"), F.col(text).alias("_own")), "_own")
    passed = F.when(model.score() >= CUTOFF, F.array(F.struct(F.lit(True).alias("_good"), "_row")))
    return marks.select(F.inline_outer(passed)).where("_good").select("_row.*")
