"""What each of five filters removes, in every order of applying them.

Texts are routed by xxhash64 of their bytes: a task keeps, for each hash, a chain of the full texts
that have it, each with the row of the smallest doc_id so far. A row that isn't the smallest of its
text goes on at once, marked as identical to a smaller one, without its text; what is left in the
chains goes on unmarked. Each task first does the same with its own rows, so that of a frequent text
one copy for each task is routed. Rows end as a mask of failed filters; combineByKey
merges a vector of counts for each part, by mask and label, from which all orders follow.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations
from math import ceil

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Bytes of text that a task holds before it hands rows on, and that a routed partition holds.
CHUNK_BYTES, ROUTED_BYTES = 16 << 20, 48 << 20
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Labels by which documents are counted: good, toxic, both or neither.
_GOOD, _TOXIC = 1, 2


def mask(body: bytes, characters: int) -> int:
    """The filters A to D that a text fails, as bits: under 100 words, repetitive words, capitals, marks. Words end at ASCII white space; characters are code points."""
    words = body.split()
    out = len(words) < 100
    out |= (100 * len(set(words)) < 80 * len(words)) << 1
    out |= (100 * (len(body) - len(body.translate(None, _UPPER))) > 10 * characters) << 2
    return out | (len(body) != len(body.translate(None, _MARKS))) << 3


def _earlier(one: tuple, other: tuple) -> bool:
    """Whether row one has the smaller id; rows without an id are behind all others."""
    return one[0] is not None and (other[0] is None or one[0] < other[0])


class Chains:
    """Texts by hash, each with the rows of its smallest id and how many times each came."""

    def __init__(self, fingerprint):
        self.fingerprint, self.held, self.size = fingerprint, {}, 0

    def add(self, body: bytes, rows: dict[tuple, int]):
        """Takes rows of one text and id, with their numbers; yields those, old or new, that are now known not to be the smallest."""
        chain, new = self.held.setdefault(self.fingerprint(body), []), next(iter(rows))
        for link in chain:
            if link[0] == body:
                old = next(iter(link[1]))
                if _earlier(old, new):
                    yield from rows.items()
                elif _earlier(new, old):
                    yield from link[1].items()
                    link[1] = rows
                else:
                    for row, n in rows.items():
                        link[1][row] = link[1].get(row, 0) + n
                return
        chain.append([body, rows])
        self.size += len(body) + 200

    def close(self):
        """What is left; the table is empty then."""
        held, self.held, self.size = self.held, {}, 0
        for h, chain in held.items():
            for body, rows in chain:
                yield h, body, rows


def repeats(rows: RDD, parts: int, fingerprint=xxhash.xxh64_intdigest) -> RDD:
    """Of rows (text, (id, *rest)): each distinct (id, *rest), whether a row of a smaller id has the same text, and how many such rows there are. Rows of one text that share the smallest id are none of them repeats; a row without an id repeats those with one."""

    def own(rows):
        chains, nameless = Chains(fingerprint), Counter()
        for body, row in rows:
            for loser, n in chains.add(body, {row: 1}):
                if loser[0] is None:
                    nameless[loser] += n
                else:
                    yield loser[0], (None, {loser: n})
            if chains.size > CHUNK_BYTES:
                yield from ((h, (body, kept)) for h, body, kept in chains.close())
        yield from ((h, (body, kept)) for h, body, kept in chains.close())
        yield from ((0, (None, {row: n})) for row, n in nameless.items())

    def settle(routed):
        chains = Chains(fingerprint)
        for _, (body, kept) in routed:
            if body is None:
                yield from ((row, True, n) for row, n in kept.items())
            else:
                yield from ((row, True, n) for row, n in chains.add(body, kept))
        for _, _, kept in chains.close():
            yield from ((row, False, n) for row, n in kept.items())

    return rows.mapPartitions(own).partitionBy(parts, lambda h: (h ^ h >> 32) * 0x9E3779B1 >> 7 & 0xFFFFFFFF).mapPartitions(settle)


def masks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", fingerprint=xxhash.xxh64_intdigest) -> DataFrame:
    """doc_id, part and mask (bits of the filters it fails, A lowest) of the rows, and n, how many rows are alike."""
    spark = documents.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.char_length(body).alias("n"), body.cast("binary").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / ROUTED_BYTES))

    def measured(rows):
        for doc, name, n, body in rows:
            body = bytes(body)
            yield body, (doc, name, mask(body, n))

    found = repeats(rows.rdd.mapPartitions(measured), parts, fingerprint)
    return spark.createDataFrame(found.map(lambda x: (x[0][0], x[0][1], x[0][2] | x[1] << 4, x[2])), "doc_id long, part string, mask int, n long", verifySchema=False)


def counts(marked: DataFrame, labels: DataFrame) -> RDD:
    """For each part its vector: the number of rows by 4 * mask + label."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max((F.col("quality") == 1).cast("int")) * _GOOD).alias("g"), (F.max((F.col("toxic") == 1).cast("int")) * _TOXIC).alias("x"))
    cell = 4 * F.col("mask") + F.coalesce("g", F.lit(0)) + F.coalesce("x", F.lit(0))
    rows = marked.join(known, "doc_id", "left").select("part", cell.alias("cell"), "n")

    def first(found: tuple[int, int]) -> list[int]:
        return add([0] * (4 << len(FILTERS)), found)

    def add(vector: list[int], found: tuple[int, int]) -> list[int]:
        cell, n = found
        vector[cell] += n
        return vector

    def merge(one: list[int], other: list[int]) -> list[int]:
        return [a + b for a, b in zip(one, other)]

    return rows.rdd.map(lambda r: (r[0], (r[1], r[2]))).combineByKey(first, add, merge)


def orders(vector: list[int]) -> list[dict]:
    """The counts of each step of each order, from a part's vector."""
    names = range(len(FILTERS))
    masks = range(1 << len(FILTERS))
    every = [sum(vector[4 * m : 4 * m + 4]) for m in masks]
    good = [vector[4 * m + _GOOD] + vector[4 * m + _GOOD + _TOXIC] for m in masks]
    toxic = [vector[4 * m + _TOXIC] + vector[4 * m + _GOOD + _TOXIC] for m in masks]

    def step(before: int, f: int) -> dict:
        failing = [m for m in masks if m >> f & 1]
        gone = [m for m in failing if not m & before]
        return {
            "kept": sum(every[m] for m in masks if not m & (before | 1 << f)),
            "removed": sum(every[m] for m in gone),
            "redundant": sum(every[m] for m in failing if m & before),
            "unique_fails": every[1 << f],
            "good_lost": sum(good[m] for m in gone),
            "toxic_lost": sum(toxic[m] for m in gone),
        }

    steps = {(before, f): step(before, f) for before in masks for f in names if not before >> f & 1}
    out, shapley = [], [0] * len(FILTERS)
    for order in permutations(names):
        before = 0
        for place, f in enumerate(order):
            found = steps[before, f]
            shapley[f] += found["removed"]
            out.append((f, {"filter_order": "".join(FILTERS[k] for k in order), "step": place + 1} | found))
            before |= 1 << f
    return [row | {"shapley": shapley[f]} for f, row in out]


def audit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", fingerprint=xxhash.xxh64_intdigest) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each value of part (null is the empty string) all orders of the five filters, step by step.

    A: under 100 words; B: distinct words under 80 % of all; C: capitals A-Z over 10 % of the code
    points; D: any of #$%&*|; E: the text is that of a row with a smaller id, in whatever part, removed or
    not. Null texts count as empty, and empty ones fail A, and E where repeated. Of rows that share
    id and text neither repeats the other; rows without an id repeat those with one, not each other,
    and have no labels. A document is good or toxic if any of its labels says so. Repeated rows count
    each, other columns are ignored, an empty table gives no rows. Ids must fit a long.
    """
    found = counts(masks(documents, doc_id, text, part, fingerprint), labels)
    rows = found.flatMap(lambda x: [Row(part=x[0], **row) for row in orders(x[1])])
    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return documents.sparkSession.createDataFrame(rows, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))
