"""Token ids in binary files, with document boundaries as Elias-Fano sequences.

A file holds documents with ascending ids: a header, the documents' ids and the boundaries of their
tokens (each an Elias-Fano sequence), then the token ids one after another as little-endian
unsigned integers of 2 bytes where the vocabulary has at most 65,536 entries, else of 4.

An Elias-Fano sequence of n ascending numbers below u keeps the low floor(log2(u / n)) bits of each
packed, and the high parts as set bits of a bit vector in which the i-th number sets bit high + i.
select(i) finds the i-th set bit from the counts kept for every 512 bits (32-bit numbers relative to
the file, so no table has a 64-bit entry) and returns the number.

    header  magic "LLEF0001", id bytes, documents without an id, documents, tokens, and the two
            sequences' byte lengths: 7 unsigned 64-bit numbers but the magic
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlight.llm import files
from loomlight.llm.bpe import text_batches
from loomlight.llm.shared import cut, scratch
from loomlight.llm.words import Encoder

MAGIC = b"LLEF0001"
BLOCK_BITS = 512
_FIRST = -(1 << 63)
#: Numbers handled at once; a multiple of 8, so that packed low bits end with a byte.
STEP = 8192
#: For each byte the places of its set bits in order.
_NTH_BIT = np.array([[*(k for k in range(8) if b >> k & 1), *[0] * (8 - b.bit_count())] for b in range(256)])
#: A file is closed once it has this many tokens.
FILE_TOKENS = 4 << 20


class EliasFano:
    """Ascending non-negative numbers. Built by of(), read back by parse()."""

    def __init__(self, n: int, low_bits: int, base: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.base, self.low, self.high = n, low_bits, base, low, high
        per_byte = np.bitwise_count(high).astype(np.uint32)
        pad = -len(per_byte) % (BLOCK_BITS // 8)
        blocks = np.pad(per_byte, (0, pad)).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint32)
        self.before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(blocks, dtype=np.uint32)])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, base = len(values), int(values[0]) if len(values) else 0
        span = int(values[-1]) - base + 1 if n else 0
        low_bits = max(0, (span // n).bit_length() - 1) if n else 0
        low, bits = [], np.zeros(((span - 1) >> low_bits) + n if n else 0, np.uint8)
        for k in range(0, n, STEP):
            rest = values[k : k + STEP] - base
            low.append(np.packbits(((rest[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little"))
            bits[(rest >> low_bits) + np.arange(k, k + len(rest))] = 1
        return cls(n, low_bits, base, np.concatenate(low) if low else np.empty(0, np.uint8), np.packbits(bits, bitorder="little"))

    def dump(self) -> bytes:
        return struct.pack("<QQqQQ", self.n, self.low_bits, self.base, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def parse(cls, data: bytes) -> EliasFano:
        n, low_bits, base, low, high = struct.unpack_from("<QQqQQ", data)
        at = struct.calcsize("<QQqQQ")
        return cls(n, low_bits, base, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i) -> np.ndarray:
        """The numbers at the given places: the block of 512 bits by the counts, the byte by its bits' sums, the bit by a table."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), STEP):
            out[k : k + STEP] = self._select(i[k : k + STEP])
        return out

    def _select(self, i: np.ndarray) -> np.ndarray:
        width = BLOCK_BITS // 8
        block = np.searchsorted(self.before, i, side="right") - 1
        at = np.minimum(block[:, None] * width + np.arange(width), len(self.high) - 1)
        upto = np.cumsum(np.bitwise_count(self.high[at]), axis=1, dtype=np.uint16)
        rank = i - self.before[block]
        byte = (upto <= rank[:, None]).sum(axis=1)
        rows = np.arange(len(i))
        within = rank - np.where(byte > 0, upto[rows, byte - 1], 0)
        place = (block * width + byte) * 8 + _NTH_BIT[self.high[at[rows, byte]], within]
        return self.base + (((place - i) << self.low_bits) | self._low(i))


def write_file(uri: str, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, id_bytes: int):
    """doc_ids ascending, those without one first."""
    nulls = sum(x is None for x in doc_ids)
    known = EliasFano.of(np.array(doc_ids[nulls:], np.int64)).dump()
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(counts)])).dump()
    with files.publish(uri) as out:
        out.write(MAGIC + struct.pack("<6Q", id_bytes, nulls, len(doc_ids), len(ids), len(known), len(bounds)))
        out.write(known + bounds)
        out.write(ids.astype(f"<u{id_bytes}").tobytes())


class TokenFile:
    """One file, read through its index."""

    def __init__(self, uri: str):
        data = files.read(uri)
        if data[:8] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        id_bytes, self.nulls, self.docs, tokens, known, bounds = struct.unpack_from("<6Q", data, 8)
        at = 8 + struct.calcsize("<6Q")
        self.known = EliasFano.parse(data[at : at + known])
        self.bounds = EliasFano.parse(data[at + known : at + known + bounds])
        self.ids = np.frombuffer(data, f"<u{id_bytes}", tokens, at + known + bounds)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + self.known.select(np.arange(self.known.n)).tolist()

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, found by two selects."""
        a, b = self.bounds.select([k, k + 1]).tolist()
        return self.ids[a:b]


@functools.lru_cache(maxsize=2)
def library_encoder(path: str, known: bytes) -> Encoder:
    """Words go to the tokenizers library's own model, many at once with spaces between; a word's ids end at the first entry with a word end.

    known: words.rules(path), made once. Words come normalised and are not normalised
    again: a letter lower-cased after composition may compose anew.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    names = tokenizer.get_vocab(with_added_tokens=True)
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    last = np.zeros(1 + max(names.values()), bool)
    last[[i for name, i in names.items() if name.endswith("</w>")]] = True
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def encode_words(words: list[str]) -> list[list[int]]:
        groups = [words[k : k + 2000] for k in range(0, len(words), 2000)]
        out = []
        for group, found in zip(groups, bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.int64)
            ends = (np.flatnonzero(last[ids]) + 1).tolist()
            if len(ends) != len(group):
                raise ValueError("the library splits these words otherwise")
            out += [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]
        return out

    return Encoder(encode_words, specials, known, tokenizer.normalizer.normalize_str)


def _bounds(documents: DataFrame, doc_id: str, parts: int) -> np.ndarray:
    """Ids that cut the documents into parts of about equal size, from a sketch of the ids alone; a frequent id is named several times."""
    if parts < 2:
        return np.empty(0, np.int64)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST))
    found = documents.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("b")).first().b
    return np.array(found or [], np.int64)


def encoded(documents: DataFrame, encoder: Callable[[], Encoder], end_id: int, id_bytes: int, parts: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part and ids (little-endian, end_id last) of every row; parts ascend with the ids, and rows of an id that fills several are dealt to these in turn."""
    bounds = _bounds(documents, doc_id, parts)

    def run(batches):
        dealt = 0
        for batch in batches:
            keys = batch.column(0).fill_null(_FIRST).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            part = (low + (dealt + np.arange(len(keys))) % (high - low + 1)).astype(np.int32)
            dealt += len(keys)
            for a, b, texts in text_batches(batch.column(1)):
                n, flat = encoder().encode(texts)
                if len(flat) and int(flat.max()) >> (8 * id_bytes):
                    raise ValueError(f"an id doesn't fit into {id_bytes} bytes")
                flat = np.insert(flat, np.cumsum(n), end_id).astype(f"<u{id_bytes}")
                offsets = np.concatenate([[0], np.cumsum(n + 1)]) * id_bytes
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(part[a:b]), column.cast(pa.binary())], names=["doc_id", "part", "ids"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part int, ids binary")


def write(documents: DataFrame, folder: str, encoder: Callable[[], Encoder], end_id: int, id_bytes: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts in ascending order of doc_id and returns the list of files, one row each, computed once.

    Null texts are empty; every document ends with end_id. Documents without an id come first,
    repeated ids stay next to each other and may be dealt to several tasks. An empty table gives no
    files. Only the files listed count: what a failed task leaves has a name that no list holds.
    Texts are encoded where they are read, once; only ids move, once.
    """

    def run(batches):
        part, ids, docs, counts, size, seq = TaskContext.get().partitionId(), [], [], [], 0, 0
        stem = f"{folder}/{part:06d}-{TaskContext.get().taskAttemptId()}"

        def close():
            flat, uri = np.frombuffer(b"".join(ids), f"<u{id_bytes}"), f"{stem}-{seq:06d}.tok"
            write_file(uri, docs, np.concatenate(counts), flat, id_bytes)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "uri": [uri], "n_docs": [len(docs)], "n_tokens": [len(flat)]})

        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids += rows
            docs += keys
            counts.append(np.fromiter(map(len, rows), np.int64, len(rows)) // id_bytes)
            size += int(counts[-1].sum())
            if size >= FILE_TOKENS:
                yield close()
                ids, docs, counts, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield close()

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded(documents, encoder, end_id, id_bytes, parts, doc_id, text).repartitionById(parts, "part").sortWithinPartitions("doc_id").select("doc_id", "ids")
    return cut(ordered.mapInArrow(run, "part long, seq long, uri string, n_docs long, n_tokens long"))


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files listed: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids as 32-bit numbers.

    The driver gets one total for each task that wrote, never one for each document or file.
    """
    totals = sorted((r.part, r.n) for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, upto = [], 0
    for part, n in totals:
        starts.append((part, upto))
        upto += n
    spark = manifest.sparkSession
    first = spark.createDataFrame(starts, "part long, first long")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = manifest.select("part", "uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("within"))
    placed = within.join(first, "part").select("uri", (F.col("first") + F.col("within")).alias("start"))
    tasks = max(1, spark.sparkContext.defaultParallelism * 2)

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(uri)
                bounds = f.bounds.select(np.arange(f.docs + 1))
                wide = f.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids(), pa.int64()), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return placed.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, encoder: Callable[[], Encoder], end_id: int, id_bytes: int = 4) -> DataFrame:
    """Writes documents to a new folder and reads its files back, every document found by select. What write says of nulls, repeats and empty tables holds."""
    return read(write(documents, scratch(documents.sparkSession, "tokens"), encoder, end_id, id_bytes))
