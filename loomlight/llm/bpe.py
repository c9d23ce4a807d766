"""Byte-pair encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest vocabulary entries. The cut equals what the merges
give if every entry survives merging on its own and every two neighbours are compatible, that is,
no merge crosses their border before both are whole. That test runs for all neighbours of all new
words at once; only words that fail are merged pair by pair.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.words import Encoder, normalizer, rules_by_task

NEVER = np.int64(1) << 40
#: Texts handed to an encoder at once, in bytes.
BATCH_BYTES = 1 << 20
#: Words that an encoder keeps with their ids.
KNOWN_WORDS = 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """A tokenizer file with word ends: entries, merges, and for each entry the pair and rank that form it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.size = 1 + max(max(self.ids.values()), max(self.specials.values(), default=0))
        names = [""] * self.size
        for name, i in [*self.ids.items(), *self.specials.items()]:
            names[i] = name
        self.names = np.array(names, object)
        self.numbers = np.array([str(i) for i in range(self.size)], object)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.rank = np.full(self.size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges.setdefault((x, y), (r, z))
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x * self.size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.longest = max(map(len, self.ids))
        self.sound = np.zeros(self.size, bool)
        for name, i in self.ids.items():
            if i not in self.specials.values():
                body, last = (name[: -len(self.suffix)], True) if self.suffix and name.endswith(self.suffix) else (name, False)
                self.sound[i] = self.merge(self.units(body, last)) == [i]

    def spell(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))

    def units(self, spelled: str, last: bool = True) -> list[int]:
        out = [self.ids[c] for c in spelled]
        if last and out:
            out[-1] = self.ids[spelled[-1] + self.suffix]
        return out

    def merge(self, parts: list[int]) -> list[int]:
        """Exact merging: the pair of least rank first, the leftmost of equals, until no pair merges. A heap keeps long words from taking quadratic time."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        parts = list(parts)
        heap = [(m[0], k, m[1], parts[k], parts[k + 1]) for k in range(n - 1) if (m := self.merges.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, z, x, y = heapq.heappop(heap)
            j = after[k]
            if parts[k] != x or j < 0 or parts[j] != y:
                continue
            parts[k], parts[j], after[k] = z, -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if m := self.merges.get((z, parts[after[k]])):
                    heapq.heappush(heap, (m[0], k, m[1], z, parts[after[k]]))
            if (i := before[k]) >= 0 and (m := self.merges.get((parts[i], z))):
                heapq.heappush(heap, (m[0], i, m[1], parts[i], z))
        return [x for x in parts if x >= 0]

    def greedy(self, spelled: str) -> list[int]:
        """The longest entries from the left; the one that ends the word carries the suffix."""
        out, k, n, ids = [], 0, len(spelled), self.ids
        marked = spelled + self.suffix
        while k < n:
            if n - k <= self.longest and (found := ids.get(marked[k:])) is not None:
                out.append(found)
                break
            for size in range(min(self.longest, n - k - 1), 0, -1):
                if (found := ids.get(spelled[k : k + size])) is not None:
                    break
            out.append(found)
            k += size
        return out

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs of entries: whether merging leaves the border between them alone.

        Both entries are taken apart in reverse order of the merges that formed them. At each step
        the two pieces at the border coexist until the earlier of the merges that absorb them; a
        merge of the two that comes before crosses the border.
        """
        x, y = x.astype(np.int64), y.astype(np.int64)
        good, live = np.ones(len(x), bool), np.arange(len(x))
        end_x, end_y = np.full(len(x), NEVER), np.full(len(y), NEVER)
        while len(live):
            a, b = x[live], y[live]
            keys = a * self.size + b
            k = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            m = np.where(self.pair_keys[k] == keys, self.pair_ranks[k], NEVER)
            crossed = (m < end_x[live]) & (m <= end_y[live]) & (m < NEVER)
            good[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            first = ra > rb
            x[live] = np.where(first, self.right[a], a)
            end_x[live] = np.where(first, ra, end_x[live])
            y[live] = np.where(first, b, self.left[b])
            end_y[live] = np.where(first, end_y[live], np.where(rb >= 0, rb, end_y[live]))
            live = live[~crossed & ((ra >= 0) | (rb >= 0))]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        spelled = [self.spell(w) for w in words]
        proposed = [self.greedy(s) for s in spelled]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        failed = np.zeros(len(words), bool)
        failed[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[where]
        failed[owner[inner[~good]]] = True
        for k in np.flatnonzero(failed).tolist():
            proposed[k] = self.merge(self.units(spelled[k]))
        return proposed

    def decode(self, ids: np.ndarray) -> str:
        """The entries' names joined by a space, as the library does where a file names no decoder."""
        return " ".join(self.names[ids].tolist())


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str, known: bytes) -> Encoder:
    """known: words.rules(path), made once."""
    v = vocabulary(path)
    return Encoder(v.encode_words, v.specials, known, normalizer(), KNOWN_WORDS)


def text_batches(texts: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """Runs of texts of about BATCH_BYTES together, with their bounds; only one run at a time is made into strings."""
    begin = size = 0
    for k, n in enumerate(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).tolist()):
        size += n
        if size >= BATCH_BYTES:
            yield begin, k + 1, texts.slice(begin, k + 1 - begin).to_pylist()
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts), texts.slice(begin).to_pylist()


def encode(documents: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """documents with a column of token ids (array of int) after the others; a null or empty text has no ids.

    A column named like `into` is replaced. Special tokens' strings in a text become their ids.
    Repeated rows each keep their row; an empty table gives none.
    """
    base = documents.drop(into)
    schema = base.select("*", F.array(F.lit(0)).alias(into)).schema
    known = rules_by_task(documents.sparkSession, path)

    def run(batches):
        coder = encoder(path, known)
        for batch in batches:
            for a, b, texts in text_batches(batch.column(batch.schema.get_field_index(text))):
                counts, ids = coder.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                column = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, column], names=[*batch.schema.names, into])

    return base.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """tokens with a column of decoded text after the others; null ids give an empty text. A column named like `into` is replaced."""
    base = tokens.drop(into)
    schema = base.select("*", F.lit("").alias(into)).schema

    def run(batches):
        names = vocabulary(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            flat = column.flatten()
            if flat.null_count:
                column = pa.array([[i for i in x or [] if i is not None] for x in column.to_pylist()], pa.list_(pa.int64()))
                flat = column.flatten()
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            values = flat.to_numpy(zero_copy_only=False)
            texts = [names.decode(values[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return base.mapInArrow(run, schema)


def digests(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded text), and if asked for ids, the array of ids.

    A null text counts as empty and gives the digests of the empty string; repeated rows and null
    doc_ids each give their own row; other columns are ignored.
    """
    more = [F.array(F.lit(0)).alias("ids")] if keep_ids else []
    schema = documents.select(
        F.col(doc_id).alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"), *more
    ).schema

    known = rules_by_task(documents.sparkSession, path)

    def run(batches):
        names, coder = vocabulary(path), encoder(path, known)
        for batch in batches:
            for a, b, texts in text_batches(batch.column(1)):
                counts, ids = coder.encode(texts)
                ends = np.cumsum(counts).tolist()
                rows = [ids[x:y] for x, y in zip([0, *ends], ends)]
                of_ids = [hashlib.sha256(" ".join(names.numbers[r].tolist()).encode()).hexdigest() for r in rows]
                of_text = [hashlib.sha256(names.decode(r).encode("utf-8")).hexdigest() for r in rows]
                columns = {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return documents.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, schema)
