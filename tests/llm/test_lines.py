"""Line dedup against a comparison of every two lines."""

import random

from loomlight.llm import lines

SCHEMA = "doc_id long, text string"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    """Kept text, lines and removed lines of each row."""
    everything = []
    for doc, text in rows:
        for n, line in enumerate((text if text is not None else "").split("\n") if text is not None else []):
            everything.append(((doc is not None, doc, n, text), line.lower().split(), line))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        kept, gone = [], 0
        for n, line in enumerate(text.split("\n")):
            w = line.lower().split()
            mine = ((doc is not None, doc or 0, n), text)
            early = [v for (known, d, m, t), v, _ in everything if (((known, d or 0, m) < mine[0]) and len(v) >= 5)]
            if len(w) >= 5 and any(within_one(w, v) for v in early):
                gone += 1
            else:
                kept.append(line)
        out.append((doc, "\n".join(kept), len(text.split("\n")), gone))
    return out


def run(spark, rows):
    got = lines.deduplicate(spark.createDataFrame(rows, SCHEMA), shortest=5)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)


def test_random_edits(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 5, 6, 7, 8, 12, 31, 32, 33, 40, 70]))] for _ in range(30)]
    rows = []
    for doc in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    line.insert(at, rng.choice(vocabulary))
                elif at < len(line):
                    line[at : at + 1] = [rng.choice(vocabulary)] if kind == 1 else []
            text.append(rng.choice([" ", "  ", "\t"]).join(line).title())
        rows.append((doc, "\n".join(text)))
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_edges(spark):
    line = "one two three four five six"
    rows = [(1, None), (2, ""), (3, line), (4, line.upper()), (5, "short line"), (6, "short line"), (7, f"x\n{line} seven\ny"), (8, "\n\n")]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, []) == []


def test_rows_that_repeat_or_share_an_id(spark):
    line = "one two three four five six"
    assert run(spark, [(1, line), (1, line)]) == [(1, line, 1, 0)] * 2
    got = run(spark, [(None, line), (1, line)])
    assert (None, line, 1, 0) in got and (1, "", 1, 1) in got


def test_clashing_columns_and_long_line(spark):
    long = " ".join(f"t{k}" for k in range(5000))
    rows = [(1, long, 9, "a"), (2, long + " more", 9, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, removed string")
    got = {r.doc_id: r for r in lines.deduplicate(df, shortest=5).collect()}
    assert got[2].n_removed == 1 and got[1].n_removed == 0
    assert got[1].removed == "a" and got[1].n_lines == 1
    assert lines.thin(df, shortest=5).columns == df.columns and lines.thin(df, shortest=5).count() == 1
