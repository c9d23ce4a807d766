"""Removal of repeated passages with a sparse suffix array.

A byte goes if a string of `width` bytes that covers it also starts earlier in the corpus. Sorting
the suffix at every byte would move each text a hundred times, so only suffixes at anchors are
sorted: of each string of `width` bytes, the leftmost gram with the least hash among its GRAMS grams.
Equal strings have their anchor at the same place, so they share the suffix from there on, and what
stands before it. In steps:

1. Anchors whose gram occurs once in the corpus are left out, by hash: one row for each anchor,
   and one only for those that a task already knows to be repeated.
2. Suffixes from the other anchors, with the bytes before them, are range-partitioned by their
   leading bytes: splitters are quantiles of a sample. A splitter is cut to the gram, so that a gram
   stays in one bucket, unless the sample shows that it fills several.
3. A bucket sorts its suffixes by multikey quicksort, eight bytes a character, which gives the
   longest common prefixes of neighbours; so it does with the bytes before, read backwards. Two
   strings that start o bytes before their anchors are equal where prefixes of width - o bytes and
   o bytes before agree. All but the first of equal strings are repeats.
4. Strings whose suffix part goes on beyond a splitter are compared across the boundary: each
   bucket sends its first one of each, as it stands, to be grouped with those of other buckets.

Hashes of grams only propose; equality is decided on bytes. Equal texts, told by 128 bits of hash,
are one text here, with the smallest doc_id of theirs: all others lose every byte.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlight.llm.shared import cut, scratch

#: Length of the strings in bytes, and the grams of a string among which its anchor is chosen.
WIDTH, GRAMS = 100, 64
#: Suffixes that are sorted at once, buckets at most, and how many suffixes of each a sample holds. Beyond so many buckets, each is dealt into pieces by gram.
BUCKET_ROWS, MAX_BUCKETS, SAMPLE_ROWS = 1 << 16, 1 << 13, 32
#: Bytes of text whose grams are hashed at once; below 2 ** 20.
_STEP = 1 << 17
#: Place of documents without an id: behind all others.
NO_ID = (1 << 63) - 1
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)


@contextmanager
def _dropping_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a query go when it ends: what it wrote stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, name)
    with _dropping_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _gram_hashes(piece: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes (8 at least) from each byte of piece on."""
    n = len(piece) - gram + 1
    x = piece.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    out = np.zeros(n, np.uint64)
    for at in sorted({*range(0, gram - 7, 8), gram - 8}):
        out ^= out >> np.uint64(29)
        out *= _C[0]
        out += x[at : at + n] * _C[1]
    out ^= out >> np.uint64(31)
    out *= _C[2]
    out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Of texts that lie one behind the other in data: text's number, anchor, first and last start of the strings with that anchor (all as places in data), hash of the anchor's gram. An anchor may come in two rows."""
    gram, out = width - GRAMS + 1, []
    long_enough = np.flatnonzero(ends - starts >= width)
    if not len(long_enough):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    firsts, lasts = starts[long_enough], ends[long_enough] - width
    for lo in range(int(firsts[0]), int(lasts[-1]) + 1, _STEP):
        hi = min(lo + _STEP, int(lasts[-1]) + 1)
        inside = np.arange(np.searchsorted(lasts, lo), np.searchsorted(firsts, hi))
        if not len(inside):
            continue
        hashes = _gram_hashes(data[lo : hi - 1 + width], gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = (hashes & ~np.uint64((1 << 20) - 1)) | place
        for shift in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-shift], least[shift:])
        chosen = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        a, b = np.maximum(firsts[inside], lo), np.minimum(lasts[inside], hi - 1)
        if len(inside) == 1:
            s = np.arange(a[0], b[0] + 1)
        else:
            edge = np.zeros(hi - lo + 1, np.int8)
            edge[a - lo] += 1
            edge[b + 1 - lo] -= 1
            s = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8)) + lo
        at = chosen[s - lo]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)))
        last = np.append(first[1:], len(s)) - 1
        place = at[first]
        text = long_enough[np.searchsorted(firsts, s[first], side="right") - 1]
        out.append((text, place + lo, s[first], s[last], hashes[place]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and where each value starts and ends in them."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def _proposals(texts: DataFrame, width: int) -> DataFrame:
    """Rows (route, t1, t2, at) of the anchors of texts (t1, t2, text): one for each gram of a text, with the first place it has there.

    Of a gram that a batch holds once, or of the first one if it holds several, the route is the
    hash, so that the batches' rows meet. Others, which need no answer, are dealt at random. Where
    a batch already knows that a gram is repeated, at is negative.
    """

    def run(batches):
        seen: set = set()
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            pairs, fresh = list(zip(t1.tolist(), t2.tolist())), []
            for k, pair in enumerate(pairs):
                if pair not in seen:
                    seen.add(pair)
                    fresh.append(k)
            if len(seen) > 1 << 20:
                seen.clear()
            if not fresh:
                continue
            data, starts, ends = _flat(batch.column("text").take(pa.array(fresh)))
            t1, t2 = t1[fresh], t2[fresh]
            text, at, _, _, h = anchors(data, starts, ends, width)
            if not len(at):
                continue
            order = np.lexsort((at, h))  # texts lie in ascending order of place
            text, at, h = text[order], at[order], h[order]
            new_gram = np.append(True, h[1:] != h[:-1])
            new_text = new_gram | np.append(True, text[1:] != text[:-1])
            gram = np.cumsum(new_gram) - 1
            other_place = ~new_gram & np.append(False, at[1:] != at[:-1])
            known = (np.bincount(gram, weights=other_place, minlength=gram[-1] + 1) > 0)[gram]
            tester = new_gram[new_text]
            text, at, h, known = text[new_text], at[new_text], h[new_text], known[new_text]
            spread = (h ^ t1[text].view(np.uint64)) * _C[0] + at.astype(np.uint64)
            own = at - starts[text]
            columns = [np.where(tester, h, spread ^ (spread >> np.uint64(32))).view(np.int64), t1[text], t2[text], np.where(known, -1 - own, own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["route", "t1", "t2", "at"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "route long, t1 long, t2 long, at long")


def _repeated(proposals: DataFrame) -> DataFrame:
    """t1, t2, at of the proposals whose gram occurs at two places."""
    rows = proposals.repartition("route").sortWithinPartitions("route", "t1", "t2", "at")

    def settle(rows: np.ndarray):
        route, t1, t2, at = rows
        own = np.where(at < 0, -1 - at, at)
        group = np.cumsum(np.append(False, route[1:] != route[:-1]))
        apart = np.append(False, (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (own[1:] != own[:-1])) & np.append(False, group[1:] == group[:-1])
        kept = (np.bincount(group, weights=apart | (at < 0)) > 0)[group]
        return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (t1, t2, own)], names=["t1", "t2", "at"])

    def run(batches):
        held = np.zeros((4, 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
                done = int(np.searchsorted(held[0], held[0, -1]))  # the last group may go on
                if done:
                    yield settle(held[:, :done])
                    held = held[:, done:]
        if held.shape[1]:
            yield settle(held)

    return rows.mapInArrow(run, "t1 long, t2 long, at long")


#: A suffix from an anchor: its text, the text's doc_id, the anchor's place, the suffix, the bytes before it backwards. Or, where suffix is null, a repeat: `n` strings from place `at` on.
_SUFFIXES = "t1 long, t2 long, id long, at long, n long, suffix binary, before binary"


def _suffixes(texts: DataFrame, width: int) -> DataFrame:
    """The suffixes of texts (t1, t2, id, text, places): those from anchors whose gram is at one of the text's places. One of several with the same bytes around them stays, the others are repeats."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts, ends = _flat(batch.column("text"))
            t1, t2, ids = (batch.column(c).to_numpy() for c in ("t1", "t2", "id"))
            text, at, first, last, h = anchors(data, starts, ends, width)
            places = batch.column("places").combine_chunks() if isinstance(batch.column("places"), pa.ChunkedArray) else batch.column("places")
            wanted = np.repeat(starts, places.value_lengths().to_numpy()) + places.flatten().to_numpy()
            named = np.isin(at, wanted)
            pair = np.lexsort((h, text))
            gram = np.empty(len(at), np.int64)
            gram[pair] = np.cumsum(np.append(True, (text[pair][1:] != text[pair][:-1]) | (h[pair][1:] != h[pair][:-1]))) - 1 if len(at) else []
            kept = np.flatnonzero(np.isin(gram, gram[named]))
            whole, held, losers = data.tobytes(), {}, []
            rows = []
            for k, d, a, s, e in zip(kept.tolist(), text[kept].tolist(), at[kept].tolist(), first[kept].tolist(), last[kept].tolist()):
                key = (a - s, whole[s : e + width])
                rival = held.get(key)
                if rival is None:
                    held[key] = k
                    continue
                other = int(text[rival])
                if other == d or ids[other] < ids[d]:
                    losers.append(k)
                elif ids[other] > ids[d]:
                    losers.append(rival)
                    held[key] = k
                else:
                    rows.append(k)  # of two documents that share an id neither is earlier
            rows += held.values()
            rows, losers = np.sort(np.array(rows, np.int64)), np.sort(np.array(losers, np.int64))
            if len(rows):
                a, s, e = at[rows], first[rows], last[rows]
                columns = [t1[text[rows]], t2[text[rows]], ids[text[rows]], a - starts[text[rows]], e - s + 1]
                suffix = [whole[x:y] for x, y in zip(a.tolist(), (e + width).tolist())]
                before = [whole[x:y][::-1] for x, y in zip(s.tolist(), a.tolist())]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(suffix, pa.binary()), pa.array(before, pa.binary())], names=["t1", "t2", "id", "at", "n", "suffix", "before"])
            if len(losers):
                # strings of neighbouring anchors make one run
                d, s, e = text[losers], first[losers], last[losers]
                new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] != e[:-1] + 1)))
                stop = e[np.append(new[1:], len(e)) - 1]
                d, s = d[new], s[new]
                none = pa.nulls(len(s), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (t1[d], t2[d], ids[d], s - starts[d], stop - s + 1)), none, none], names=["t1", "t2", "id", "at", "n", "suffix", "before"])

    return texts.select("t1", "t2", "id", "text", "places").mapInArrow(run, _SUFFIXES)


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    """Rows of eight-byte characters, filled with zeros."""
    size = -(-width // 8) * 8
    return np.frombuffer(b"".join(v.ljust(size, b"\0") for v in values), ">u8").reshape(len(values), size // 8).astype(np.uint64)


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of characters, and the bytes that each shares with the one before it (0 for the first).

    A group of rows alike so far is sorted by its next character; each run of equal ones is a group
    for the character after that.
    """
    n, characters = rows.shape
    order, shared = np.arange(n), np.full(n, 8 * characters)
    shared[:1] = 0
    open_places, group = np.arange(n), np.zeros(n, np.int64)
    for depth in range(characters):
        if not len(open_places):
            break
        x = rows[order[open_places], depth]
        by = np.lexsort((x, group))
        order[open_places] = order[open_places][by]
        x, same_group = x[by], np.append(False, group[1:] == group[:-1])
        differs = same_group & np.append(False, x[1:] != x[:-1])
        if differs.any():
            gap = np.flatnonzero(differs)
            bits = x[gap] ^ x[gap - 1]
            equal = np.sum([bits >> np.uint64(64 - 8 * k) == 0 for k in range(1, 8)], axis=0)
            shared[open_places[gap]] = 8 * depth + equal
        new = ~same_group | differs
        group = np.cumsum(new)
        crowd = np.bincount(group)[group] > 1
        open_places, group = open_places[crowd], group[crowd]
    return order, shared


def _runs(flagged: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of each run of true values in the rows."""
    edge = np.diff(flagged.astype(np.int8), axis=1, prepend=0, append=0)
    row, begin = np.nonzero(edge == 1)
    return row, begin, np.nonzero(edge == -1)[1] - begin


def _bucket(t1, t2, ids, at, suffix: list, before: list, bounds: list, width: int):
    """Of a bucket's suffixes the repeats: row and offset before the anchor as a matrix of flags; and the strings that the neighbours may hold too, as pairs of rows and offsets."""
    n, gram = len(at), width - GRAMS + 1
    right, left = _matrix(suffix, width), _matrix(before, GRAMS - 1)
    lowest = width - np.fromiter(map(len, suffix), np.int64, n)
    highest = np.fromiter(map(len, before), np.int64, n)
    flagged, loose = np.zeros((n, GRAMS), bool), []
    order, shared = multikey_sort(right)
    alone = np.append(shared < gram, True)
    crowd = order[~(alone[:-1] & alone[1:])]  # a gram that only one suffix here has can't be repeated, unless beyond a boundary
    touching = np.zeros(n, np.int64)
    for bound in bounds:
        other = _matrix([bound[:width]], width)[0]
        apart = right != other
        column = np.where(apart.any(axis=1), apart.argmax(axis=1), -1)
        bits = right[np.arange(n), column] ^ other[column]
        equal = np.sum([bits >> np.uint64(64 - 8 * k) == 0 for k in range(1, 8)], axis=0)
        touching = np.maximum(touching, np.where(column < 0, width, np.minimum(8 * column + equal, len(bound))))
    of_left, shared_left = multikey_sort(left)
    text = np.unique(np.stack([t1, t2], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    block, block_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(GRAMS):
        block[order] = np.cumsum(shared < width - o)
        block_left[of_left] = np.cumsum(shared_left < o)
        rows = crowd[(lowest[crowd] <= o) & (o <= highest[crowd])]
        if len(rows) > 1:
            key = block[rows] * (n + 1) + block_left[rows]
            by = np.argsort(key, kind="stable")
            rows, key = rows[by], key[by]
            equal = key[1:] == key[:-1]
            several = np.append(equal, False) | np.append(False, equal)
            rows, key = rows[several], key[several]
            by = np.lexsort((at[rows], text[rows], ids[rows], key))
            rows, key = rows[by], key[by]
            begin = np.append(True, key[1:] != key[:-1])[: len(rows)]
            least = ids[rows][np.maximum.accumulate(np.where(begin, np.arange(len(rows)), 0))]
            again = (ids[rows] > least) | (np.append(False, text[rows][1:] == text[rows][:-1])[: len(rows)] & ~begin)
            flagged[rows[again], o] = True
        if bounds:
            open_rows = np.flatnonzero((lowest <= o) & (o <= highest) & (touching >= width - o))
            open_rows = open_rows[~flagged[open_rows, o]]
            loose.append((open_rows, np.full(len(open_rows), o)))
    return flagged, [np.concatenate(x) for x in zip(*loose)] if loose else [np.zeros(0, np.int64)] * 2


def _splitters(suffixes: DataFrame, n: int, width: int) -> list[bytes]:
    """Ascending keys (suffix, then the bytes before it) that cut the n suffixes into buckets of about BUCKET_ROWS, or MAX_BUCKETS larger ones."""
    buckets = min(MAX_BUCKETS, -(-n // BUCKET_ROWS))
    if buckets < 2:
        return []
    wanted, gram = buckets * SAMPLE_ROWS, width - GRAMS + 1
    sample = suffixes.sample(min(1.0, 1.2 * wanted / n), seed=42).select("suffix", "before").limit(2 * wanted).collect()
    keys = sorted(bytes(r.suffix).ljust(width, b"\0") + bytes(r.before) for r in sample)
    every = [keys[k * len(keys) // buckets] for k in range(1, buckets)] if keys else []
    times = Counter(k[:gram] for k in every)
    return sorted({k if times[k[:gram]] > 1 else k[:gram] for k in every})


def _resolved(suffixes: DataFrame, width: int) -> DataFrame:
    """The repeats among suffixes: t1, t2, at, n (strings from at on), window null; and strings to compare across boundaries, with their bytes as window and id."""
    n, gram = suffixes.count(), width - GRAMS + 1
    cuts = _splitters(suffixes, n, width)
    pieces = max(1, n // (BUCKET_ROWS * MAX_BUCKETS))
    schema = "t1 long, t2 long, at long, n long, id long, window binary"

    def deal(batches):
        for batch in batches:
            suffix, before = batch.column("suffix").to_pylist(), batch.column("before").to_pylist()
            bucket = [bisect_right(cuts, s.ljust(width, b"\0") + b) for s, b in zip(suffix, before)]
            piece = [crc32(s[:gram]) % pieces for s in suffix]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32()), pa.array(piece, pa.int32())], names=[*batch.schema.names, "bucket", "piece"])

    rows = suffixes.mapInArrow(deal, f"{_SUFFIXES}, bucket int, piece int").repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "piece")

    def settle(held: list):
        table = pa.Table.from_batches(held)
        bucket = table.column("bucket")[0].as_py()
        # only a splitter longer than a gram has the same gram on both its sides
        bounds = [c for c in cuts[max(0, bucket - 1) : bucket + 1] if len(c) > gram]
        t1, t2, ids, at = (table.column(c).to_numpy() for c in ("t1", "t2", "id", "at"))
        suffix, before = table.column("suffix").to_pylist(), table.column("before").to_pylist()
        flagged, (rows, offsets) = _bucket(t1, t2, ids, at, suffix, before, bounds, width)
        # column o is the string that starts o bytes before the anchor: backwards, columns go by place
        row, begin, size = _runs(flagged[:, ::-1])
        start = at[row] - (GRAMS - 1) + begin
        columns = [pa.array(c) for c in (t1[row], t2[row], start, size)]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.binary())], names=["t1", "t2", "at", "n", "id", "window"])
        for lo in range(0, len(rows), 1 << 14):
            r, o = rows[lo : lo + (1 << 14)], offsets[lo : lo + (1 << 14)]
            window = [before[i][:k][::-1] + suffix[i][: width - k] for i, k in zip(r.tolist(), o.tolist())]
            columns = [pa.array(c) for c in (t1[r], t2[r], at[r] - o, np.ones(len(r), np.int64), ids[r])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(window, pa.binary())], names=["t1", "t2", "at", "n", "id", "window"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                bucket, piece = batch.column("bucket").to_numpy(), batch.column("piece").to_numpy()
                if held and (bucket[0], piece[0]) != mine:
                    yield from settle(held)
                    held = []
                mine = (bucket[0], piece[0])
                other = (bucket != mine[0]) | (piece != mine[1])
                size = int(other.argmax()) if other.any() else len(other)
                held.append(batch.slice(0, size))
                batch = batch.slice(size)
        if held:
            yield from settle(held)

    return rows.mapInArrow(run, schema)


def _across(loose: DataFrame) -> DataFrame:
    """t1, t2, at, n of the strings that another bucket, or an earlier place of the same text, holds too."""
    same, own = Window.partitionBy("window"), Window.partitionBy("window", "t1", "t2")
    again = (F.col("id") > F.min("id").over(same)) | (F.col("at") > F.min("at").over(own))
    return loose.select("t1", "t2", "at", "n", again.alias("again")).where("again").drop("again")


def _hashed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = documents.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")


def repeats(documents: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. Of every distinct text with repeats against smaller ids or within itself: t1, t2, text (binary), runs, an array of (at, n), n strings of width bytes from byte at on. Of every distinct text: t1, t2, id, the smallest doc_id."""
    if width < GRAMS + 7:
        raise ValueError(f"width must be {GRAMS + 7} at least")
    hashed = _hashed(documents, doc_id, text)
    least = cut(hashed.groupBy("t1", "t2").agg(F.coalesce(F.min(F.col("doc_id").cast("long")), F.lit(NO_ID)).alias("id")))
    long_enough = hashed.select("t1", "t2", "text").where(F.octet_length("text") >= width)
    places = _repeated(_proposals(long_enough, width)).groupBy("t1", "t2").agg(F.collect_set("at").alias("places"))
    distinct = long_enough.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    candidates = _kept(distinct.join(places, ["t1", "t2"]).join(least, ["t1", "t2"]), "repeat-candidates")
    found = _kept(_suffixes(candidates, width), "repeat-suffixes")
    resolved = _kept(_resolved(found.where(F.col("suffix").isNotNull()), width), "repeat-runs")
    runs = found.where(F.col("suffix").isNull()).select("t1", "t2", "at", "n")
    runs = runs.union(resolved.where(F.col("window").isNull()).select("t1", "t2", "at", "n"))
    runs = runs.union(_across(resolved.where(F.col("window").isNotNull())))
    runs = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    return candidates.join(runs, ["t1", "t2"]).select("t1", "t2", "text", "runs"), least


def _spans(runs: list[dict], width: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes, end exclusive, that the strings of runs cover."""
    out: list[list[int]] = []
    for begin, end in sorted((r["at"], r["at"] + r["n"] - 1 + width) for r in runs):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def _cut_texts(repeated: DataFrame, width: int, keep_text: bool) -> DataFrame:
    """t1, t2, removed, spans (array of begin and end in bytes), sha256 of what is left, and what is left if asked for."""
    schema = "t1 long, t2 long, removed long, spans array<struct<begin: long, end: long>>, sha string" + ", kept binary" * keep_text

    def run(batches):
        for batch in batches:
            rows = []
            for t1, t2, text, runs in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "runs"))):
                spans, at, pieces = _spans(runs, width), 0, []
                for a, b in spans:
                    pieces.append(text[at:a])
                    at = b
                kept = b"".join([*pieces, text[at:]])
                rows.append({"t1": t1, "t2": t2, "removed": len(text) - len(kept), "spans": [{"begin": a, "end": b} for a, b in spans], "sha": hashlib.sha256(kept).hexdigest()} | ({"kept": kept} if keep_text else {}))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    target = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("removed", pa.int64()), ("spans", pa.list_(span)), ("sha", pa.string())] + [("kept", pa.binary())] * keep_text)
    return repeated.mapInArrow(run, schema)


def deduplicate(documents: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin and end in bytes) of every document; with keep_text also kept, the bytes that are left.

    A byte is removed if a string of width bytes that covers it also starts earlier: in a document
    of a smaller doc_id, or before in the same document. Strings are judged on the input and never
    cross documents. Null texts count as empty and lose nothing. Repeated rows each get a row. Of
    rows that share a doc_id neither is earlier, so they lose nothing to each other; rows without
    an id are behind all others, and lose nothing to each other. Other columns are ignored,
    whatever their names; an empty table gives no rows. Ids must fit a long.
    """
    repeated, least = repeats(documents, width, doc_id, text)
    # kept, so that the last join is between two tables alone: Spark can split a text of many rows there
    state = _kept(least.join(_cut_texts(repeated, width, keep_text), ["t1", "t2"], "left"), "repeat-cuts")
    whole = F.when(F.col("n_bytes") >= width, F.col("n_bytes")).otherwise(0)
    rows = _hashed(documents, doc_id, text).select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha"), *[F.col("text").alias("own")] * keep_text)
    later = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) > F.col("id")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    gone = later & (F.col("n_bytes") >= width)
    entire = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<begin: long, end: long>>")
    spans = F.when(gone, entire).otherwise(F.coalesce("spans", none))
    out = rows.join(state, ["t1", "t2"], "left")
    return out.select(
        F.col("doc_id"),
        "n_bytes",
        F.when(gone, whole).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("sha", "own_sha")).alias("kept_sha256"),
        spans.alias("spans"),
        *[F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "own")).alias("kept")] * keep_text,
    )
