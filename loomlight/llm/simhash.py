"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most d bits agree on at least two of d + 2 blocks of bits. Each
distinct fingerprint goes, for each choice of two blocks, to the group of those with the same bits
there: this masked pattern is the top node of an index. Below it, a task sorts the group by Gray
rank, so that neighbours share bits, and factors the bits that all members of a run share into a
node, run upon run. Two nodes whose shared bits already differ in more than d places are
dropped with all below them; the rest meet level by level down to single fingerprints. A group
sends on one link from each member to its part's least member, never all pairs; a group of more
than GROUP_ROWS is dealt into parts that meet two by two.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.shared import cut, sized

DISTANCE, SHINGLE, SEED = 4, 4, 42
GROUP_ROWS, FAN = 4096, 8
#: Node pairs expanded at once in a task.
FRONTIER = 1 << 18


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Of a text's bits: those set in over half the hashes of its shingles, repeats included; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    of = xxhash.xxh64_intdigest
    hashes = [of(joined[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        bits = np.unpackbits(np.array(hashes[k : k + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, schema)


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Each choice of blocks - distance blocks of bits, as a signed 64-bit mask."""
    bounds = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    parts = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:])]
    return [x - (1 << 64) if (x := sum(chosen)) >> 63 else x for chosen in combinations(parts, blocks - distance)]


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each number in the sequence of Gray codes."""
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Index:
    """Groups of fingerprints as trees: level 0 has single fingerprints in Gray order, each further level runs of FAN nodes of the one below, the last the groups."""

    def __init__(self, groups: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), groups))
        self.order, groups = order, groups[order]
        one = fps[order]
        self.levels = [(np.zeros(0, np.int64), one, np.full(len(one), ~np.uint64(0)))]
        while len(groups) > len(np.unique(groups)):
            firsts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            place = np.arange(len(groups)) - np.repeat(firsts, np.diff(np.append(firsts, len(groups))))
            starts = np.flatnonzero(place % FAN == 0)
            _, bits, shared = self.levels[-1]
            all_one = np.bitwise_and.reduceat(bits & shared, starts)
            all_zero = np.bitwise_and.reduceat(~bits & shared, starts)
            self.levels.append((np.append(starts, len(groups)), all_one, all_one | all_zero))
            groups = groups[starts]

    def pairs(self, distance: int):
        """Yields arrays of places (in the order given) of two fingerprints of a group that differ in at most distance bits."""
        top = np.arange(len(self.levels[-1][1]))
        todo = [(len(self.levels) - 1, top, top)]
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                apart = a != b
                yield self.order[a[apart]], self.order[b[apart]]
                continue
            starts = self.levels[level][0]
            na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
            sizes = na * nb
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(FRONTIER, sizes.sum() + FRONTIER, FRONTIER), side="left") + 1
            lo = 0
            for hi in [*cuts.tolist()]:
                hi = min(hi, len(a))
                if hi <= lo:
                    continue
                size = sizes[lo:hi]
                of = np.repeat(np.arange(lo, hi), size)
                k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                x, y = starts[a[of]] + k // nb[of], starts[b[of]] + k % nb[of]
                _, bits, shared = self.levels[level - 1]
                near = (a[of] != b[of]) | (x <= y)
                near &= np.bitwise_count((bits[x] ^ bits[y]) & shared[x] & shared[y]) <= distance
                if near.any():
                    todo.append((level - 1, x[near], y[near]))
                lo = hi


def parts(n: int, pairs) -> np.ndarray:
    """For each of n places the least place linked to it."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def _meetings(fps: DataFrame, distance: int, found) -> DataFrame:
    """What found yields for the groups of the distinct fingerprints fps (k, fp, tag): pairs (k, a, b) of fingerprints of one kind k, a small number.

    found takes an Index, the fingerprints and their tags, and yields two arrays of places.
    """
    chosen = masks(distance + 2, distance)
    keyed = fps.select("k", "fp", "tag", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in chosen))).alias("t", "key"))
    keyed = keyed.withColumn("t", F.col("k") * len(chosen) + F.col("t"))
    large = cut(keyed.groupBy("t", "key").count().where(F.col("count") > GROUP_ROWS).select("t", "key", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("n")))
    dealt = keyed.join(sized(large, 40), ["t", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    meet = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda other: F.least(own, other) * F.col("n") + F.greatest(own, other))
    )
    grouped = dealt.select("t", "key", "fp", "tag", F.explode(meet).alias("part")).repartition("t", "key", "part").sortWithinPartitions("t", "key", "part")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def close():
            rows = pa.Table.from_batches(held)
            t, key, part, fp, tag = (rows.column(c).to_numpy() for c in ("t", "key", "part", "fp", "tag"))
            group = np.concatenate([[0], np.cumsum((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1]))])
            size, firsts = np.bincount(group), np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            # a group of one fingerprint, or of one tag, has nothing to tell apart
            one_tag = (np.minimum.reduceat(tag, firsts) == np.maximum.reduceat(tag, firsts)) & (tag[firsts] != 0)
            kept = ((size > 1) & ~one_tag)[group]
            t, group, fp, tag = t[kept], group[kept], fp[kept].view(np.uint64), tag[kept]
            if len(fp):
                index, signed = Index(group, fp), fp.view(np.int64)
                for a, b in found(index, signed, tag):
                    yield pa.RecordBatch.from_arrays([pa.array((t[a] // len(chosen)).astype(np.int32)), pa.array(signed[a]), pa.array(signed[b])], names=["k", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and sum(b.num_rows for b in held) >= 1 << 16:
                # the last group held may go on in this batch
                rows = pa.Table.from_batches(held).combine_chunks()
                last = [rows.column(c)[-1].as_py() for c in ("t", "key", "part")]
                same = np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(("t", "key", "part"), last)])
                first = int(np.argmax(same))
                if first:
                    held = rows.slice(0, first).to_batches()
                    yield from close()
                held = rows.slice(first).to_batches()
            held.append(batch)
        if held:
            yield from close()

    return grouped.select("t", "key", "part", "fp", "tag").mapInArrow(run, "k int, a long, b long").distinct()


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """links_of_kinds where there is one kind: links (a, b) between the distinct fingerprints of column fp."""
    return links_of_kinds(fps.select(F.lit(0).alias("k"), "fp"), distance).select("a", "b")


def links_of_kinds(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (k, a, b) between the distinct fingerprints of each kind, columns k and fp, that connect exactly those which chains of steps of at most distance bits connect: of each, to the least of its part of a group."""

    def stars(index, fp, tag):
        label = parts(len(fp), index.pairs(distance))
        linked = np.flatnonzero(label != np.arange(len(fp)))
        yield linked, label[linked]

    return _meetings(fps.select("k", "fp", F.lit(0).cast("long").alias("tag")), distance, stars)


def near_pairs(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (k, a, b), a < b, of the distinct fingerprints fps (k, fp, tag) of each kind that differ in at most distance bits and have different tags or a tag of zero."""

    def pairs(index, fp, tag):
        for a, b in index.pairs(distance):
            apart = (tag[a] != tag[b]) | (tag[a] == 0)
            a, b = a[apart], b[apart]
            yield np.where(fp[a] < fp[b], a, b), np.where(fp[a] < fp[b], b, a)

    return _meetings(fps, distance, pairs)


def components(edges: DataFrame) -> DataFrame:
    """For each node of the links (a, b): node, root, equal for two nodes exactly where links connect them.

    Every round sends each node to the least of itself and its neighbours, merges the nodes that
    meet and drops links inside them; fingerprints come in random order, so a round leaves a
    fraction of the nodes. The rounds' steps are then composed from the last to the first.
    """
    steps, left = [], cut(edges.where("a != b").distinct())
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
        steps.append(step)
        for end in ("a", "b"):
            left = left.join(step, left[end] == step["node"]).select(*(F.col("root").alias(end) if c == end else F.col(c) for c in ("a", "b")))
        left = cut(left.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    final = steps.pop()
    while steps:
        later = final.select(F.col("node").alias("via"), F.col("root").alias("last"))
        final = steps.pop().join(later, F.col("root") == F.col("via"), "left").select("node", F.coalesce("last", "root").alias("root"))
        final = cut(final)
    return final


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id that links reach.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows each get a
    row. Rows without a doc_id link, but name no component unless no other row of theirs has an id.
    Other columns are ignored; an empty table gives no rows.
    """
    found = cut(fingerprints(documents, doc_id, text))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed)
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    merged = cut(smallest.where("n > 1").drop("n"))
    named = cut(placed.join(sized(merged, 40), "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
