"""Benchmark decontamination with suffix arrays of the training texts.

Each task turns its documents, a few megabytes at a time, into a shard: the words in one sequence
and a suffix array, the places where a match can begin, sorted by the words that follow: by those
of a window first, and where a suffix of the benchmark goes on, by all of them, with ranks that
double in length. Every suffix of the benchmark's items is found in the shard by binary search,
which gives all places where it occurs; how far each match goes follows from the same ranks, so
that periodic texts take no longer than others. Places that can't begin a match (too few of the
words that follow are benchmark words at all) are left out of the array. Hashes only propose which
words are equal; bytes decide. The benchmark is written in indexed blocks of bounded size, which
tasks read one at a time, once for several shards; documents are never shuffled.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomlight.llm import files
from loomlight.llm.shared import cut, scratch

#: Words of a match. An item with fewer words must match whole.
WINDOW = 10
#: Texts of a shard, and of a block of the benchmark, together, in bytes.
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20
#: Shards held at once while the blocks of the benchmark pass.
SHARDS = 8
#: Bytes of words hashed in one numpy pass; longer words take several.
PASS_BYTES = 1 << 17
_MULTIPLIER = 0xD6E8FEB86659FD93


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a word (digits, a-z, and all of other than ASCII), and a mixed value."""
    word = np.zeros(256, bool)
    word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return word, x ^ (x >> np.uint64(27))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hashes(codes: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of each word: of as many words at once as lie within PASS_BYTES, so that what a pass holds doesn't grow with the texts."""
    mixed, most = _tables()[1], PASS_BYTES
    up, down = _powers(most)
    hashes, k = np.empty(len(at), np.uint64), 0
    while k < len(at):
        begin, upto = int(at[k]), int(np.searchsorted(ends, at[k] + most, side="right"))
        if upto == k:
            parts = range(begin, int(ends[k]), most)
            sums = (int((mixed[x] * up[: len(x)]).sum()) for x in (codes[p : min(p + most, ends[k])] for p in parts))
            hashes[k] = sum(n * pow(_MULTIPLIER, p - begin, 1 << 64) for n, p in zip(sums, parts)) % (1 << 64)
            k += 1
            continue
        sums = np.zeros(ends[upto - 1] - begin + 1, np.uint64)
        np.cumsum(mixed[codes[begin : ends[upto - 1]]] * up[: len(sums) - 1], out=sums[1:])
        hashes[k:upto] = (sums[ends[k:upto] - begin] - sums[at[k:upto] - begin]) * down[at[k:upto] - begin]
        k = upto
    return hashes


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, how many words each text has, the bytes, and each word's bounds in them."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = b"\x00".join(raw) + b"\x00"
    codes = np.frombuffer(data, np.uint8)
    mask = _tables()[0][codes]
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edges = np.concatenate([[0], edges]) if mask[0] else edges
    at, ends = edges[0::2], edges[1::2]
    offsets = np.cumsum([0, *(len(x) + 1 for x in raw)])
    return _hashes(codes, at, ends), np.diff(np.searchsorted(at, offsets)), data, at, ends


class Benchmark:
    """A block of items: their words by number, the places where a match may begin in them, and their distinct windows."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        hashes, counts, data, at, ends = words([t for _, t in items])
        self.names = [i for i, _ in items]
        ranks = {n: k for k, n in enumerate(sorted(set(self.names)))}
        self.by_rank = list(ranks)
        self.numbers_of: dict[bytes, int] = {}
        self.seq = np.fromiter((self.numbers_of.setdefault(data[a:b], len(self.numbers_of) + 1) for a, b in zip(at.tolist(), ends.tolist())), np.int64, len(at))
        numbers, first = np.unique(self.seq, return_index=True)
        self.data, self.at, self.ends = data, np.append(0, at[first]), np.append(0, ends[first])
        order = np.argsort(hashes[first], kind="stable")
        self.hashes, self.of_hash = hashes[first][order], numbers[order]
        upto = np.cumsum(counts)
        left = np.repeat(upto, counts) - np.arange(len(self.seq))
        whole = np.repeat(counts, counts)
        size = np.minimum(whole, window)
        # an item of fewer words is one window; of others every place with as many words left begins one
        self.tests = np.flatnonzero((left >= size) & ((whole >= window) | (left == whole)))
        self.size, self.left = size[self.tests], left[self.tests]
        self.rank = np.repeat([ranks[n] for n in self.names], counts).astype(np.int64)[self.tests]
        self.least, self.most = (int(self.size.min()), int(self.left.max())) if len(self.tests) else (0, 0)
        deep = np.arange(window)
        spelled = np.where(deep < self.size[:, None], np.append(self.seq, np.zeros(window, np.int64))[self.tests[:, None] + deep], 0)
        _, self.window = np.unique(spelled, axis=0, return_inverse=True) if len(spelled) else (None, np.empty(0, np.int64))
        self.window = self.window.reshape(-1)
        # the items of each distinct window, in one list
        pairs = np.unique(np.stack([self.window, self.rank], axis=1), axis=0) if len(spelled) else np.empty((0, 2), np.int64)
        self.item_ranks, self.items_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(pairs) + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number that each word's hash proposes, 0 for words that no item has."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[k] == hashes, self.of_hash[k], 0)

    def checked(self, ids: np.ndarray, asked: np.ndarray, data: bytes, at: np.ndarray, ends: np.ndarray) -> bool:
        """Compares the words at the places asked, byte by byte, with those of their numbers; corrects ids and tells whether any was wrong."""
        n = ends[asked] - at[asked]
        own = ids[asked]
        wrong = n != self.ends[own] - self.at[own]
        same, n = asked[~wrong], n[~wrong]
        if len(same):
            upto = np.cumsum(n)
            inside = np.arange(upto[-1]) - np.repeat(upto - n, n)
            mine, theirs = np.frombuffer(data, np.uint8), np.frombuffer(self.data, np.uint8)
            unequal = mine[np.repeat(at[same], n) + inside] != theirs[np.repeat(self.at[ids[same]], n) + inside]
            wrong[np.flatnonzero(~wrong)] = np.logical_or.reduceat(unequal, upto - n)
        for p in asked[wrong].tolist():
            ids[p] = self.numbers_of.get(data[at[p] : ends[p]], 0)
        return bool(wrong.any())


class Shard:
    """Texts as one sequence of words, with what blocks of the benchmark have found in them so far."""

    def __init__(self, texts: list[str | None]):
        self.hashes, self.counts, self.data, self.at, self.ends = words(texts)
        self.upto = np.cumsum(self.counts)
        self.hit = np.zeros(len(self.hashes), bool)
        self.items: list[set[str]] = [set() for _ in texts]
        self.longest: list[tuple[int, int, str] | None] = [None] * len(texts)

    def _room(self, ids: np.ndarray) -> np.ndarray:
        """How many words of the benchmark follow one another from each place on, within the text."""
        stops = np.unique(np.concatenate([np.flatnonzero(ids == 0), self.upto]))
        return np.where(ids > 0, stops[np.searchsorted(stops, np.arange(len(ids)), side="right")] - np.arange(len(ids)), 0) if len(ids) else ids

    def _array(self, block: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' numbers, the suffix array of the places where a match can begin, and their room. Suffixes are ordered by the words of a window."""
        ids = block.numbers(self.hashes)
        while True:
            room = self._room(ids)
            array = np.flatnonzero(room >= max(1, block.least))
            reach = np.zeros(len(ids) + 1, np.int64)
            np.add.at(reach, array, 1)
            np.add.at(reach, array + room[array], -1)
            if not block.checked(ids, np.flatnonzero(np.cumsum(reach[:-1])), self.data, self.at, self.ends):
                break
        return ids, array[np.lexsort(_next_words(ids, array, room[array]).T[::-1])], room

    def search(self, block: Benchmark):
        """Finds every suffix of the block's items in the array, and notes hits and longest matches."""
        if not len(block.tests) or not len(self.hashes):
            return
        ids, array, room = self._array(block)
        low, high = np.zeros(len(block.tests), np.int64), np.full(len(block.tests), len(array), np.int64)
        best, named = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
        live = np.flatnonzero(low < high)
        for d in range(int(block.size.max())):
            if not len(live):
                break
            column = np.where(room[array] > d, ids[np.minimum(array + d, len(ids) - 1)], 0)
            low[live], high[live] = narrow(column, block.seq[block.tests[live] + d], low[live], high[live])
            live = live[low[live] < high[live]]
            whole = live[block.size[live] == d + 1]
            self._windows(block, whole, array, low, high)
            # equal beginnings have the same range: one of them, of the least item, marks it
            whole = whole[np.lexsort((block.rank[whole], low[whole]))]
            whole = whole[np.append(True, low[whole][1:] != low[whole][:-1])] if len(whole) else whole
            places, owner = _ranges(low[whole], high[whole])
            best[places], named[places] = d + 1, block.rank[whole][owner]
            live = live[block.left[live] > d + 1]
        deep = Deep(block, live, ids, room, array, low, high) if len(live) else None
        if deep:
            best[deep.inside] = deep.longest()
        found = np.flatnonzero(best)
        text = np.searchsorted(self.upto, array[found], side="right")
        order = np.lexsort((array[found], -best[found], text))
        for k in order[np.append(True, text[order][1:] != text[order][:-1])] if len(order) else ():
            i, at, n = int(text[k]), int(found[k]), int(best[found[k]])
            rank = deep.item(at, n) if deep and n > block.size.max() else named[at]
            match = (n, int(array[at]) - int(self.upto[i] - self.counts[i]), block.by_rank[rank])
            self.longest[i] = min((m for m in (self.longest[i], match) if m), key=lambda m: (-m[0], m[1], m[2]))

    def _windows(self, block: Benchmark, whole: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Notes the words hit and the items of windows found whole; equal windows are taken once."""
        _, first = np.unique(block.window[whole], return_index=True)
        whole = whole[first]
        places, owner = _ranges(low[whole], high[whole])
        places, windows, size = array[places], block.window[whole][owner], block.size[whole][owner]
        cover = np.zeros(len(self.hit) + 1, np.int64)
        np.add.at(cover, places, 1)
        np.add.at(cover, places + size, -1)
        self.hit |= np.cumsum(cover[:-1]) > 0
        text = np.searchsorted(self.upto, places, side="right")
        pairs = np.unique(text * (len(block.items_from) + 1) + windows)
        text, windows = np.divmod(pairs, len(block.items_from) + 1)
        named, owner = _ranges(block.items_from[windows], block.items_from[windows + 1])
        for i, rank in zip(text[owner].tolist(), block.item_ranks[named].tolist()):
            self.items[i].add(block.by_rank[rank])

    def results(self) -> dict[str, pa.Array]:
        upto = np.concatenate([[0], np.cumsum(self.hit)])
        n_hit = upto[self.upto] - upto[self.upto - self.counts]
        items = [sorted(x) for x in self.items]
        length, at, item = zip(*(m or (0, None, None) for m in self.longest)) if self.longest else ((), (), ())
        return {
            "n_words": pa.array(self.counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(list(map(len, items)), pa.int64()), "items": pa.array(items, pa.list_(pa.string())),
            "longest": pa.array(length, pa.int64()), "longest_at": pa.array(at, pa.int64()), "longest_item": pa.array(item, pa.string()), "contaminated": pa.array(n_hit > 0, pa.bool_()),
        }


class Deep:
    """How far the suffixes of items that go on after a window (live) match at the places found for them, which are put in whole order in the array.

    The words from there on, of texts and items, are one sequence of runs. Ranks of its places by 1, 2, 4, ... words order suffixes and tell how many words two of them have in common.
    """

    def __init__(self, block: Benchmark, live: np.ndarray, ids: np.ndarray, room: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.inside = np.flatnonzero(_covered(low[live], high[live], len(array)))
        places, tests = array[self.inside], block.tests[live]
        mine = np.flatnonzero(_covered(places, places + room[places], len(ids)))
        theirs = np.flatnonzero(_covered(tests, tests + block.left[live], len(block.seq)))
        begun = np.searchsorted(tests, theirs, side="right") - 1
        self.rest = np.concatenate([room[mine], tests[begun] + block.left[live][begun] - theirs])
        self.levels = _doubled(np.concatenate([ids[mine], block.seq[theirs]]), self.rest)
        ranks, at, of = self.levels[-1], np.searchsorted(mine, places), len(mine) + np.searchsorted(theirs, tests)
        order = np.argsort(ranks[at], kind="stable")
        array[self.inside], self.at = places[order], at[order]
        order = np.argsort(ranks[of], kind="stable")
        self.of, self.items = of[order], block.rank[live][order]
        # every suffix's place in the array by binary search; of how many suffixes each place is the end or beyond it
        found = np.searchsorted(ranks[self.at], ranks[self.of])
        self.upto = np.searchsorted(found, np.arange(len(self.at)), side="right")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words two suffixes have in common."""
        a, b, n, last = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(self.rest) - 1
        limit = np.minimum(self.rest[a], self.rest[b])
        for k in range(len(self.levels) - 1, -1, -1):
            # runs that end within these words at the same place are equal to their end
            same = np.flatnonzero((n < limit) & (self.levels[k][a] == self.levels[k][b]))
            n[same] += 1 << k
            a[same], b[same] = np.minimum(a[same] + (1 << k), last), np.minimum(b[same] + (1 << k), last)
        return np.minimum(n, limit)

    def longest(self) -> np.ndarray:
        """The words of the longest match at each place inside: with a neighbour in order."""
        before, after = np.maximum(self.upto - 1, 0), np.minimum(self.upto, len(self.of) - 1)
        return np.maximum(self.common(self.at, self.of[before]), self.common(self.at, self.of[after]))

    def item(self, place: int, n: int) -> int:
        """The least item with a suffix that has n words in common with a place of the array. Such suffixes are neighbours."""
        k = int(np.searchsorted(self.inside, place))
        alike = lambda j: self.common(self.at[[k]], self.of[[j]])[0] >= n
        low, high = 0, int(self.upto[k])
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if alike(mid) else (mid + 1, high)
        first, low, high = low, int(self.upto[k]), len(self.of)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if alike(mid) else (low, mid)
        return int(self.items[first:low].min())


def _covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, low, 1)
    np.add.at(cover, high, -1)
    return np.cumsum(cover[:-1]) > 0


def _doubled(seq: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their next 1, 2, 4, ... words, none counted after the rest of their run, until no two are equal or the longest run is reached."""
    levels, size, n = [seq.astype(np.int32)], 1, len(seq)
    while size < rest.max():
        own = levels[-1].astype(np.int64)
        follows = np.where(rest > size, own[np.minimum(np.arange(n) + size, n - 1)], 0)
        values, ranks = np.unique(own * (max(n, int(own.max())) + 1) + follows, return_inverse=True)
        levels.append((ranks.reshape(-1) + 1).astype(np.int32))
        size *= 2
        if len(values) == n:
            break
    return levels


def _next_words(ids: np.ndarray, places: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The WINDOW words that follow each place, 0 beyond its room."""
    deep = np.arange(WINDOW)
    return np.where(deep < room[:, None], ids[np.minimum(places[:, None] + deep, len(ids) - 1)], 0)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and the range that each belongs to."""
    n = high - low
    owner = np.repeat(np.arange(len(n)), n)
    return low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def narrow(column: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range, in which column ascends, that equals the word wanted: two binary searches for all ranges at once."""
    out = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) // 2
            value = column[mid]
            up = (value <= wanted[open_]) if right else (value < wanted[open_])
            a[open_[up]] = mid[up] + 1
            b[open_[~up]] = mid[~up]
        out.append(a)
    return out[0], out[1]


def write_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[str]:
    """Writes the items, indexed, in files of about BLOCK_BYTES of text to the shared folder and returns the files' names.

    Items without an id or a text take no part. Neither the driver nor any task holds more than a block.
    """
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first().n
    folder, most, window = scratch(benchmark.sparkSession, "benchmark"), BLOCK_BYTES, WINDOW

    def run(batches):
        block, size, seq = [], 0, 0

        def close():
            uri = f"{folder}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{seq:06d}.block"
            with files.publish(uri) as out:
                out.write(pickle.dumps(Benchmark(block, window), protocol=5))
            return pa.RecordBatch.from_pydict({"uri": [uri]})

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.append((i, t))
                size += len(t)
                if size >= most:
                    yield close()
                    block, size, seq = [], 0, seq + 1
        if block:
            yield close()

    return sorted(r.uri for r in cut(rows.repartition(max(1, total // most)).mapInArrow(run, "uri string")).collect())


@functools.lru_cache(maxsize=1)
def _load(uri: str) -> Benchmark:
    return pickle.loads(files.read(uri))


ADDED = "n_words long, n_hit long, n_items long, items array<string>, longest long, longest_at long, longest_item string, contaminated boolean"


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents (or of their columns those to keep) with n_words, n_hit, n_items, items (ids as sorted strings), the longest verbatim match (longest: words, longest_at: its first word's place from 0, longest_item) and contaminated after the others.

    A match lies within one item; of equally long ones the first place counts, then the smallest
    item. Columns of the added names are replaced. A null text, or one without words, has no hits.
    Repeated rows each get their own row. Rows of the benchmark that share an id count as one item
    with all their windows; items without an id, a text or words have none. An empty benchmark hits
    nothing. Blocks of the benchmark are read one after another, once for SHARDS shards.
    """
    added = [f.split()[0] for f in ADDED.split(", ")]
    kept = [c for c in (documents.columns if keep is None else keep) if c not in added]
    # a text that is kept goes to the workers once
    place = kept.index(text) if text in kept and documents.schema[text].dataType == StringType() else len(kept)
    base = documents.select(*kept, *([F.col(text).cast("string").alias("_text")] if place == len(kept) else []))
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema.fields[: len(kept)]), ADDED])
    uris, most = write_blocks(benchmark, item_id, item_text), SHARD_BYTES
    # one block stays in memory by itself
    at_once = SHARDS if len(uris) > 1 else 1

    def found(batch, shards):
        for uri in uris:
            block = _load(uri)
            for _, _, shard in shards:
                shard.search(block)
        for a, b, shard in shards:
            results = shard.results()
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(kept)], *results.values()], names=[*kept, *results])

    def run(batches):
        for batch in batches:
            texts, shards = batch.column(place), []
            begin = size = 0
            for k, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
                size += n
                if size < most and k + 1 < len(texts):
                    continue
                shards.append((begin, k + 1, Shard(texts.slice(begin, k + 1 - begin).to_pylist())))
                begin, size = k + 1, 0
                if len(shards) == at_once or begin == len(texts):
                    yield from found(batch, shards)
                    shards = []
        # workers go on to other stages: a block would stay in their memory
        _load.cache_clear()

    return base.mapInArrow(run, schema)


def digests(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the items' ids joined by commas), contaminated, longest, longest_at, longest_item. What contamination says of nulls, repeats and empty tables holds."""
    found = contamination(documents, benchmark, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest", "longest_at", "longest_item")


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with their own columns, whatever their names. Null and empty texts stay, and so does every repeat of a clean row."""
    names = [f"c{k}" for k in range(len(documents.columns))]
    found = contamination(documents.toDF(*names), benchmark, text=names[documents.columns.index(text)])
    return found.where(~F.col("contaminated")).select(*(F.col(a).alias(b) for a, b in zip(names, documents.columns)))
