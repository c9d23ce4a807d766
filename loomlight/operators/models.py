"""Calls of models that may fail: a result comes whole from one of several ways, and says which."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.operators.common import cut


def first_whole(ways: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The rows of the first way that runs to its end, with served_by, its name, and degraded, whether it wasn't the first.

    A way that raises in Python, in a task or before, is given up as a whole: rows of two ways never mix. Each but the last is worked out here and kept in
    the shared folder; the last is taken as it is, so it should need no model. Other errors are raised.
    """
    names = list(ways)
    for k, (name, way) in enumerate(ways.items()):
        said = {"served_by": F.lit(name), "degraded": F.lit(k > 0)}
        if k == len(names) - 1:
            return way().withColumns(said)
        try:
            return cut(way()).withColumns(said)
        except PythonException:
            continue
    raise ValueError("a way is needed")


def scores(model: Callable[[], Callable[[list[str], list[str]], list[float]]], query: Column, text: Column) -> Column:
    """A model's score of each query and text. model() is called once in each task; what it raises ends the task."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = None
        for q, t in batches:
            scorer = scorer or model()
            yield pd.Series(scorer(q.tolist(), t.tolist()), dtype="float64")

    return score(query, text)


def answers(model: Callable[[], Callable[[list[str]], list[str]]], text: Column) -> Column:
    """A model's answer to each text, as scores."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = None
        for batch in batches:
            answer = answer or model()
            yield pd.Series(answer(batch.tolist()), dtype="object")

    return ask(text)


def embedded(rows: DataFrame, embedders: dict[str, Callable[[Column], Column]], text: str = "text", vector: str = "embedding") -> DataFrame:
    """rows with a vector for each text, all by the first embedder that works for all, with served_by and degraded. The last must not fail."""
    return first_whole({name: (lambda embed=embed: rows.withColumn(vector, embed(F.col(text)))) for name, embed in embedders.items()})
