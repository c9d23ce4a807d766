"""The library's functions for SQL: temporary functions of the session, expanded by Catalyst, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

_VECTORS = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
FUNCTIONS = {
    "vec_dot": (_VECTORS, "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_cosine": (_VECTORS, "DOUBLE", "if(aggregate(a, 0D, (s, x) -> s + x * x) = 0 OR aggregate(b, 0D, (s, x) -> s + x * x) = 0, 0D, aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))))"),
    "vec_l2": (_VECTORS, "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "text_tokens": ("t STRING", "ARRAY<STRING>", r"regexp_extract_all(lower(coalesce(t, '')), r'[\\p{L}\\p{N}]+', 0)".replace(r"\\p", r"\p")),
    "place_disc": ("a ARRAY<DOUBLE>, p DOUBLE", "DOUBLE", "get(array_sort(a), least(cast(floor(size(a) * p) AS INT), size(a) - 1))"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates (or replaces) the functions and returns their names."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return list(FUNCTIONS)
