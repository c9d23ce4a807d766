"""SimHash near-duplicates by resemblance: documents whose sets of five-word shingles have a Jaccard coefficient of at least LEAST.

The index of simhash proposes: two fingerprints of each text's distinct words link in it at
DISTANCE or fewer differing bits. Words, not shingles, are printed since one changed word changes
five shingles: shingles' fingerprints of texts at LEAST differ in 10 bits on average. Each word
counts once, as frequent words would make all texts of a language alike. The sets of shingles
decide on every link. Candidates first meet the least member of
their group. Where that leaves several components in a chain of near fingerprints, as of many texts of the same words,
only those of its members meet that share a band of least shingle hashes and most of a sketch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm import simhash
from loomlight.llm.shared import cut, sized
from loomlight.llm.simhash import components

SHINGLE, LEAST, DISTANCE, SEED = 5, 0.8, 6, 42
#: Where the members of a group of near fingerprints are unlike: bands, least hashes in each, and the share of bands' sketches that must agree. Sets at LEAST share no band in 1 % of cases, and fall short of ALIKE in as many.
BANDS, ROWS, ALIKE = 64, 12, 0.68
#: Hashes whose bits are counted at once.
_STEP = 1 << 15


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words has one shingle, one without words none."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    of = xxhash.xxh64_intdigest
    spans = zip(begins[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter((of(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def prints(text: str | None) -> list[int]:
    """Two signed fingerprints of a text's distinct words, by two hashes; none without words."""
    words = set(_words(text))
    if not words:
        return []
    hashes, out = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)), []
    for mixed in (hashes, (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)):
        total = np.zeros(64, np.int64)
        for k in range(0, len(mixed), _STEP):
            total += np.unpackbits(mixed[k : k + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(total * 2 > len(mixed), bitorder="little").view("<i8")[0]))
    return out


def _sets(documents: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), s (of its set of shingles), n (the set's size) and fps, the fingerprints, of every row."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    schema = rows.select("doc_id", "t", F.lit("").alias("s"), F.lit(0).alias("n"), F.array(F.lit(0).cast("long")).alias("fps")).schema

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [shingles(t) for t in texts]
            columns = [
                batch.column("doc_id"),
                batch.column("t"),
                pa.array([xxhash.xxh128_hexdigest(h.tobytes(), SEED) for h in found], pa.string()),
                pa.array([len(h) for h in found], pa.int32()),
                pa.array([prints(t) for t in texts], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "s", "n", "fps"])

    return rows.mapInArrow(run, schema)


def _hashes(texts: DataFrame) -> DataFrame:
    """s and the set of shingles of each row (s, text)."""

    def run(batches):
        for batch in batches:
            for s, text in zip(batch.column("s").to_pylist(), batch.column("text").to_pylist()):
                found = pa.array([shingles(text).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([s]), found], names=["s", "set"])

    return texts.mapInArrow(run, "s string, set array<long>")


def _pair(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _close(n: str, m: str):
    """Whether sets of these sizes can be alike enough."""
    return F.least(n, m) >= LEAST * F.greatest(n, m) - 1e-9


def _named(named: DataFrame, distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """s and a text of each set of named (s)."""
    wanted = cut(distinct.select("s", "t").join(named, "s", "left_semi"))
    return texts.join(sized(wanted, 64), "t").select("s", "text").dropDuplicates(["s"])


def _verified(pairs: DataFrame, distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets of at least LEAST, from the texts that they come from."""
    sets = cut(_hashes(_named(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct(), distinct, texts)))
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.where(common >= LEAST * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"))


def _links(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the sets s of distinct (s, t, n, fps) that connect what chains of verified pairs connect."""
    printed = cut(distinct.select("s", "n", F.posexplode("fps").alias("k", "fp")))
    hubs = cut(printed.groupBy("k", "fp").agg(F.min(F.struct("s", "n")).alias("hub")))
    steps = cut(simhash.links_of_kinds(hubs, DISTANCE))
    own = printed.join(hubs, ["k", "fp"]).select("s", "n", "hub")
    across = printed.join(steps.withColumnRenamed("a", "fp"), ["k", "fp"]).join(hubs.select("k", F.col("fp").alias("b"), "hub"), ["k", "b"]).select("s", "n", "hub")
    stars = own.union(across).where((F.col("s") != F.col("hub.s")) & _close("n", "hub.n"))
    stars = cut(stars.select(*_pair("s", "hub.s")).distinct())
    found = _verified(stars, distinct, texts)

    # chains of near fingerprints that hold several components
    node = lambda fp: F.struct("k", F.col(fp).alias("fp"))
    chained = components(steps.select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node").alias("own"), F.col("root").alias("chain"))
    roots = components(found)
    placed = printed.join(roots, F.col("s") == F.col("node"), "left").select("s", F.coalesce("root", "s").alias("root"), node("fp").alias("own"))
    placed = cut(placed.join(chained, "own", "left").select("s", "root", F.xxhash64(F.coalesce("chain", "own")).alias("chain")).distinct())
    crowded = placed.groupBy("chain").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("chain")
    crowd = cut(placed.join(crowded, "chain", "left_semi"))
    rest = cut(_meeting(crowd, _banded(_named(crowd.select("s").distinct(), distinct, texts))).join(stars, ["a", "b"], "left_anti"))
    return found.union(_verified(rest, distinct, texts))


def _banded(texts: DataFrame) -> DataFrame:
    """s, bands (a hash of ROWS least hashes of its shingles each) and sketch (a byte of each band's first least hash) of each row (s, text)."""
    rng = np.random.default_rng(SEED)
    odd, add = (rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def run(batches):
        for batch in batches:
            bands, sketches = [], []
            for text in batch.column("text").to_pylist():
                found, least = shingles(text), np.full(BANDS * ROWS, ~np.uint64(0))
                found ^= found >> np.uint64(31)
                for k in range(0, len(found), 64):
                    mixed = found[k : k + 64, None] * odd + add
                    least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
                least = least.reshape(BANDS, ROWS)
                bands.append([xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(least)])
                sketches.append((least[:, 0] >> np.uint64(8)).astype(np.uint8).tobytes())
            if bands:
                yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["s", "bands", "sketch"])

    return texts.mapInArrow(run, "s string, bands array<long>, sketch binary")


def _meeting(crowd: DataFrame, banded: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of crowd (s, chain, root) of one chain and different roots that share a band and whose sketches agree in a share of ALIKE. A pair leaves its task only if they do."""
    rows = crowd.join(banded, "s").select("s", "root", "sketch", "chain", F.explode("bands").alias("band")).select(F.xxhash64("chain", "band").alias("g"), "s", "root", "sketch")
    dealt = rows.repartition("g").sortWithinPartitions("g", "root", "s")

    def pairs(s: list, root: np.ndarray, sketch: np.ndarray):
        for k in range(len(s) - 1):
            # rows of a root lie together: what is behind it has other roots
            behind = int(np.searchsorted(root, root[k], side="right"))
            agree = (sketch[behind:] == sketch[k]).sum(axis=1)
            for j in (np.flatnonzero(agree >= ALIKE * BANDS) + behind).tolist():
                yield min(s[k], s[j]), max(s[k], s[j])

    def settle(table: pa.Table):
        g = table.column("g").to_numpy()
        ends = np.flatnonzero(np.append(g[1:] != g[:-1], True)) + 1
        roots = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        # groups of one root have nothing to say
        starts = np.append(0, ends[:-1])
        told = (ends - starts > 1) & (roots[starts] != roots[ends - 1])
        s, sketch = table.column("s").to_pylist(), np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(g), -1)
        found = {p for a, b in zip(starts[told].tolist(), ends[told].tolist()) for p in pairs(s[a:b], roots[a:b], sketch[a:b])}
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.string()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
                g = held.column("g").to_numpy()
                done = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if done:
                    yield from settle(held.slice(0, done))
                    held = held.slice(done)
        if held is not None and held.num_rows:
            yield from settle(held)

    return dealt.mapInArrow(run, "a string, b string").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links reach.

    Equal sets link, those of null and empty texts too. Repeated rows each get a row. Rows without a
    doc_id link, but name no component. Columns other than doc_id and text are ignored; an empty
    table gives no rows.
    """
    found = cut(_sets(documents))
    distinct = found.groupBy("s").agg(F.min("doc_id").alias("least"), F.first(F.struct("t", "n", "fps")).alias("f"))
    distinct = cut(distinct.select("s", "least", "f.*"))
    texts = documents.select(F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    roots = components(_links(distinct, texts))
    placed = cut(distinct.join(roots, F.col("s") == F.col("node"), "left").select("s", "least", F.coalesce("root", "s").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").select("s", "component_id")
    return found.join(named, "s").select("doc_id", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without those that a document with a smaller doc_id is linked to.

    Rows that share a doc_id are one document, and rows without one stay. Of null and empty texts
    one stays too. Other columns pass unchanged, whatever their names; an empty table gives none.
    """
    found = near_duplicates(documents).where("doc_id != component_id").select("doc_id").distinct()
    return documents.join(sized(cut(found), 24), "doc_id", "left_anti").select(*documents.columns)
