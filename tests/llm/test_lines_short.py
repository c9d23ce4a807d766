"""Repeats of short lines, other white space and scripts without spaces, in the registered query and the pipeline's stage."""

import random
import re

import corpus_pipeline
from loomlight.llm import queries
from tests.llm.test_lines import SCHEMA, within_one

#: Scripts written without spaces, as far as the tests use them.
ALONE = re.compile("([ก-๛ぁ-ヿ一-鿿])")


def split(line):
    return ALONE.sub(r" \1 ", line.lower()).split()


def brute(rows):
    """doc_id, kept text and number of removed lines, where earlier lines of few words count as exact repeats only."""
    early, out = [], []
    for doc, text in rows:
        kept, gone = [], 0
        for line in text.split("\n"):
            w = split(line)
            near = any(w == v or (len(w) >= 5 and len(v) >= 5 and within_one(w, v)) for v in early)
            if w and near:
                gone += 1
            else:
                kept.append(line)
            early.append(w)
        out.append((doc, "\n".join(kept), gone))
    return out


LINES = [
    "Ietzte.", "All rights reserved.", "all rights reserved.", "", " \t", "　", "one two three four", "one two three five", "x", "中文字符没有空格", "中文字符没有空白", "中文", "日本語のテキスト　です", "ภาษาไทยไม่มีช่องว่าง",
    "a b c d e", "a b c d f", "für alle Fälle schön geöffnet", "für alle Fälle nicht geöffnet", "unbroken" * 200, "éa",
]


def test_registered_query_and_stage(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, "\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 6)))) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    got = queries.op6_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == want
    thinned = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in thinned) == [(d, t) for d, t, gone in want if not gone or t.strip()]
