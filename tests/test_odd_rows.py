"""Queries over rows that the given tables don't have: the same rows as their SQL in DuckDB."""

import duckdb
import pytest

from loomlight import plans
from tests.test_queries import plain

TEXTS = [
    (1, "One. Two!  Three"), (2, ""), (3, " "), (4, None), (5, "\n\n"), (6, "a\nbb\n"), (7, " \t a. b?  "), (8, ". ! ?"), (9, "\x0b"), (10, "\u0085"), (11, "日本。 語. é"),
]


@pytest.fixture
def same(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = plans.queries()[name](spark, str(tmp_path))
        found = con.execute(plans.oracle_sql()[name])
        names = [d[0] for d in found.description]
        want = sorted(tuple(map(plain, r)) for r in found.fetchall())
        assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want
        return want

    return check


def test_sentences_of_texts_without_any(same):
    assert len(same("str_sentences", documents=(TEXTS, "doc_id long, text string"))) == len(TEXTS)


def test_tokens_of_blank_texts_and_repeated_rows(same):
    rows = [*TEXTS, (1, "One. Two!  Three"), (2, "b\nc"), (4, None), (20, None), (20, None), (21, "x"), (21, "y\nzz"), (21, ""), (21, "x"), (22, ""), (22, ""), (None, "no id"), (None, "no id"), (None, ""), (None, None)]
    labels = [(1, 1, 0), (1, 0, 0), (2, 1, 0), (21, 0, 1), (None, 1, 1), (99, 1, 0)]
    got = same("heal_tokens", documents=(rows, "doc_id long, text string"), labels=(labels, "doc_id long, quality int, toxic int"))
    assert {(i, n) for i, n, _ in got} >= {("2", "3"), ("3", "1"), ("5", "3"), ("21", "5"), ("22", "2"), ("None", "3")}
