"""Answers judged by models of entailment and of meaning, and question sets drawn in given shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions import vectors as V
from loomlight.operators.common import cut
from loomlight.operators.models import first_whole

#: model() gives a function from premises and hypotheses to (label, score) each; labels are ENTAILMENT, NEUTRAL, CONTRADICTION.
Entailment = Callable[[], Callable[[list[str], list[str]], list[tuple[str, float]]]]
# Shares of meaning and facts in correctness, and the share of each level in a question set.
SEMANTIC, FACTUAL = 0.6, 0.4
LEVELS = {"basic": 0.4, "intermediate": 0.4, "advanced": 0.2}


def entailment(model: Entailment, premise: Column, hypothesis: Column) -> Column:
    """A struct of label and score. model() is called once in each task; what it raises ends the task. Nulls count as empty texts."""

    @F.pandas_udf("label string, score double")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge_all = None
        for p, h in batches:
            judge_all = judge_all or model()
            yield pd.DataFrame(judge_all(p.tolist(), h.tolist()), columns=["label", "score"]).astype({"label": "object", "score": "float64"})

    return judge(F.coalesce(premise, F.lit("")), F.coalesce(hypothesis, F.lit("")))


def faithfulness(results: DataFrame, model: Entailment, contexts: str = "contexts", answer: str = "answer") -> DataFrame:
    """results with faithfulness: how far the contexts (an array, joined by spaces) entail the answer; 0.5 where neutral, the complement of the score where they contradict it."""
    e = F.col("_e")
    score = F.when(e["label"] == "ENTAILMENT", e["score"]).when(e["label"] == "NEUTRAL", 0.5).otherwise(1.0 - e["score"])
    return results.withColumn("_e", entailment(model, F.array_join(contexts, " "), F.col(answer))).withColumn("faithfulness", score).drop("_e")


def _alike(embed: Callable[[Column], Column], a: str, b: str) -> Column:
    return V.cosine(embed(F.col(a)), embed(F.col(b)))


def relevancy(results: DataFrame, embed: Callable[[Column], Column], question: str = "question", answer: str = "answer") -> DataFrame:
    """results with relevancy: the cosine of question and answer."""
    return results.withColumn("relevancy", _alike(embed, question, answer))


def correctness(results: DataFrame, embed: Callable[[Column], Column], model: Entailment, answer: str = "answer", truth: str = "ground_truth") -> DataFrame:
    """results with correctness, served_by and degraded: cosine of answer and truth, and half of the score of each direction that is entailed, in their shares.

    If the model of entailment fails, the cosine alone judges all rows: rows of the two never mix.
    """

    def whole() -> DataFrame:
        half = lambda c: F.when(F.col(c)["label"] == "ENTAILMENT", F.col(c)["score"] * 0.5).otherwise(0.0)
        both = results.withColumns({"_f": entailment(model, F.col(answer), F.col(truth)), "_b": entailment(model, F.col(truth), F.col(answer))})
        return both.withColumn("correctness", SEMANTIC * _alike(embed, answer, truth) + FACTUAL * (half("_f") + half("_b"))).drop("_f", "_b")

    return first_whole({"entailment": whole, "semantic": lambda: results.withColumn("correctness", _alike(embed, answer, truth))})


def balanced(questions: DataFrame, total: int, shares: dict[str, float] = LEVELS, stratum: str = "complexity", key: str = "item_id", seed: int = 7, confidence: str | None = None, least: float = 0.7) -> DataFrame:
    """An exact draw of questions: of each stratum the whole part of total times its share, or all if it has fewer; first those with the least hash of seed and key.

    With confidence, the name of a column, only questions of at least `least` take part. The same questions come out at any partitioning. Equal keys are drawn apart only if the
    key is unique; strata not named in shares, and nulls, are left out.
    """
    pool = questions if confidence is None else questions.where(F.col(confidence) >= least)
    pool = cut(pool.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))))
    drawn = [pool.where(F.col(stratum) == s).orderBy("_h", key).limit(int(total * share)) for s, share in shares.items()]
    return reduce(DataFrame.union, drawn).drop("_h")
