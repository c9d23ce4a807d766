"""Texts to token ids through a table of known words.

Texts are normalised and split with numpy over code points: one pass classifies characters and
marks where words begin. A rolling hash groups equal words, and every word is compared with the
first of its group, letter by letter; the table is looked up by the words themselves. Only words
that it lacks go to an encoder of words. It is emptied when it holds LIMIT words, which bounds a
task's memory and changes no result.

How the library classifies and lower-cases each code point is asked of the library itself, once for
each file (rules), and sent to the tasks. Texts with a code point on which Python's Unicode tables
may differ from the library's are normalised by the library.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Set beside the class of a code point on which the library and Python may differ.
ODD = 4
LIMIT = 400_000
#: Characters handled in one numpy pass; longer texts are cut where no word is torn.
PASS_CHARS = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: Borders at which a word always ends, whatever surrounds them, and across which nothing composes: white space, before a digit, from a digit to a letter, from a letter to a mark.
_CUT = re.compile(r"[ \n\t]|(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9\u4e00-\u9fa5])(?=[!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
#: The steps of a tokenizer file that this module follows; fixed values.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _check(spec: dict):
    """Raises ValueError for a tokenizer file with other steps than this module's."""
    wanted = {
        "normalizer": {"type": "Sequence", "normalizers": _NORMALIZERS},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, _BYTES]},
        "post_processor": None,
        "decoder": None,
    }
    for name, value in wanted.items():
        if spec.get(name) != value:
            raise ValueError(f"this tokenizer file's {name} is not one that is followed here")
    model = spec["model"]
    for name, value in {"type": "BPE", "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}.items():
        if (model.get(name) or False) != value:
            raise ValueError(f"this tokenizer file's model has another {name}")
    if model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix"):
        raise ValueError("this tokenizer file's model drops merges, or has other marks than word ends")
    if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens are only followed where they match as they stand")


def _plain(text: str, spaces: str = "") -> str:
    """What Python makes of the normalizer: NFC, white space as spaces, each character lower-cased on its own (no rule for a final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return (text.translate(dict.fromkeys(map(ord, spaces), " ")) if spaces else text).replace("Σ", "σ").lower()


def normalizer() -> Callable[[str], str]:
    """The library's normalizer of the files that rules() accepts, without loading one."""
    from tokenizers import Regex, normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]).normalize_str


@functools.lru_cache(maxsize=2)
def rules(path: str) -> bytes:
    """The class of every code point as the library sees it, with ODD where it may normalise otherwise than Python; packed. Raises ValueError for files with other steps."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        _check(json.load(f))
    tokenizer = Tokenizer.from_file(path)
    split, normal = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.normalizer.normalize_str
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for k in range(0, len(points), 1024):
        block = [chr(c) for c in points[k : k + 1024]]
        whole = "".join(block)
        if len(split("!" + whole)) == 1:
            continue
        if len(split("a" + whole)) == 1:
            out[points[k : k + 1024]] = LETTER
            continue
        # each character twice, a mark and a space: how the four are split tells the class
        ends = {a // 4: b - a for _, (a, b) in split(" ".join(c + c + "!" for c in block)) if a % 4 == 0}
        out[points[k : k + 1024]] = [{None: SPACE, 1: NUMBER, 2: LETTER, 3: OTHER}[ends.get(i)] for i in range(len(block))]
    spaces = "".join(map(chr, np.flatnonzero(out == SPACE).tolist()))

    def differ(chars: list[str], around: str):
        """Marks the characters that the library normalises otherwise, found by halving."""
        text = "!".join(around.replace("_", c) for c in chars)
        if normal(text) == _plain(text, spaces):
            return
        if len(chars) == 1:
            out[ord(chars[0])] |= ODD
            return
        differ(chars[: len(chars) // 2], around)
        differ(chars[len(chars) // 2 :], around)

    known = [chr(c) for c in points if unicodedata.category(chr(c)) != "Cn"]
    for k in range(0, len(known), 4096):
        differ(known[k : k + 4096], "_")
    moving = [c for c in known if unicodedata.combining(c) or unicodedata.decomposition(c)]
    for k in range(0, len(moving), 256):
        differ(moving[k : k + 256], "a_̖́")
    assigned = np.zeros(len(out), bool)
    assigned[[ord(c) for c in known]] = True
    out[~assigned] |= ODD
    return zlib.compress(out.tobytes())


_KNOWN: dict[str, bytes] = {}


def rules_by_task(spark: SparkSession, path: str) -> bytes:
    """rules(path), worked out in a task once for each file: the driver holds no tokenizer."""

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"rules": [rules(path)]})

    if path not in _KNOWN:
        _KNOWN[path] = bytes(spark.range(1, numPartitions=1).mapInArrow(run, "rules binary").first().rules)
    return _KNOWN[path]


@functools.lru_cache(maxsize=2)
def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


@functools.cache
def _weights() -> np.ndarray:
    """A mixed 64-bit value for every code point."""
    x = np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def split(text: str, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a normalised text, and for each the place in the list of its first equal: English contractions, runs of letters, single numbers, runs of anything else that isn't white space."""
    cp = _points(text)
    if not len(cp):
        return (np.empty(0, np.int64),) * 3
    kind = classes[cp] & 3
    begins = np.ones(len(cp), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == NUMBER
    for p in np.flatnonzero(cp == 39).tolist():
        if p + 1 < len(cp) and begins[p] and kind[p + 1] == LETTER:
            size = 2 if text[p + 1] in "stmd" else 3 if text[p + 1 : p + 3] in ("re", "ve", "ll") else 0
            if size:
                begins[p + 1] = False
                if p + size < len(cp):
                    begins[p + size] = True
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(cp))
    keep = kind[at] != SPACE
    at, ends = at[keep], ends[keep]
    up, down = _powers(1 << max(20, (len(cp) - 1).bit_length()))
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_weights()[cp] * up[: len(cp)], out=sums[1:])
    hashes = (sums[ends] - sums[at]) * down[at]
    return at, ends, _firsts(text, cp, at, ends, hashes)


def _firsts(text: str, cp: np.ndarray, at: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each word the place of the first that is equal; hashes only propose it, letters decide."""
    if not len(at):
        return np.empty(0, np.int64)
    codes, distinct = pd.factorize(hashes)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    first = first[codes]
    size = ends - at
    wrong = size != size[first]
    same = np.flatnonzero(~wrong & (first != np.arange(len(first))))
    n = size[same]
    if len(same):
        upto = np.cumsum(n)
        inside = np.arange(upto[-1]) - np.repeat(upto - n, n)
        unequal = cp[np.repeat(at[same], n) + inside] != cp[np.repeat(at[first[same]], n) + inside]
        wrong[same[np.logical_or.reduceat(unequal, upto - n)]] = True
    seen: dict[str, int] = {}
    for i in np.flatnonzero(wrong).tolist():
        first[i] = seen.setdefault(text[at[i] : ends[i]], i)
    return first


class Table:
    """Words with their ids in one flat array."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], limit: int | None = None):
        self.encode_words, self.limit = encode, limit
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.start, self.count = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.ids, self.used = np.empty(4096, np.uint32), 0

    def add(self, words: list[str], lists: list[Sequence[int]]):
        n, more = len(self.at), sum(map(len, lists))
        for name, size in (("start", n + len(lists)), ("count", n + len(lists)), ("ids", self.used + more)):
            old = getattr(self, name)
            if size > len(old):
                new = np.empty(max(size, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.count[n : n + len(lists)] = counts
        self.start[n : n + len(lists)] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + more] = np.fromiter((i for x in lists for i in x), np.uint32, more)
        self.used += more
        self.at.update(zip(words, range(n, n + len(lists))))

    def rows(self, text: str, at: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The table's row of each word; unknown words are encoded and added."""
        heads = np.flatnonzero(first == np.arange(len(first)))
        words = [text[a:b] for a, b in zip(at[heads].tolist(), ends[heads].tolist())]
        if len(self.at) + len(words) > (self.limit or LIMIT):
            self.clear()
        # a word that no hash brought together with its equal may be listed twice
        if new := list(dict.fromkeys(w for w in words if w not in self.at)):
            self.add(new, self.encode_words(new))
        out = np.empty(len(first), np.int64)
        out[heads] = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return out[first]


class Encoder:
    """Encodes batches of texts. specials: strings that stand for one id wherever they occur in a text as given. rules: what rules() gives; normal: the library's normalizer; limit: words of the table, LIMIT if not given."""

    def __init__(self, encode_words: Callable[[list[str]], list[Sequence[int]]], specials: dict[str, int], rules: bytes, normal: Callable[[str], str], limit: int | None = None):
        self.table, self.specials, self.classes, self.normal = Table(encode_words, limit), specials, _table(rules), normal
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return self.normal(text) if (self.classes[_points(text)] & ODD).any() else _plain(text)

    def pieces(self, texts: Sequence[str | None]) -> Iterator[tuple[int, str, int]]:
        """(index of the text, piece, -1) or (index of the text, "", id of a special)."""
        for k, text in enumerate(texts):
            for part in self.pattern.split(text or "") if self.pattern else [text or ""]:
                if part in self.specials:
                    yield k, "", self.specials[part]
                    continue
                at = 0
                while len(part) - at > PASS_CHARS and (found := _CUT.search(part, at + PASS_CHARS)):
                    yield k, self.normalise(part[at : found.start()]), -1
                    at = found.start()
                if at < len(part):
                    yield k, self.normalise(part[at:]), -1

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids one after another. Null and empty texts have none."""
        counts, out = np.zeros(len(texts), np.int64), []
        batch: list[tuple[int, str]] = []
        size = 0
        for k, piece, special in self.pieces(texts):
            if special >= 0 or size + len(piece) > PASS_CHARS:
                self._pass(batch, counts, out)
                batch, size = [], 0
            if special >= 0:
                counts[k] += 1
                out.append(np.array([special], np.uint32))
            else:
                batch.append((k, piece))
                size += len(piece) + 1
        self._pass(batch, counts, out)
        return counts, np.concatenate(out) if out else np.empty(0, np.uint32)

    def _pass(self, batch: list[tuple[int, str]], counts: np.ndarray, out: list[np.ndarray]):
        if not batch:
            return
        text = "\n".join(p for _, p in batch)
        at, ends, first = split(text, self.classes)
        if not len(at):
            return
        table = self.table
        rows = table.rows(text, at, ends, first)
        n = table.count[rows]
        upto = np.concatenate([[0], np.cumsum(n)])
        out.append(table.ids[np.repeat(table.start[rows] - upto[:-1], n) + np.arange(upto[-1])])
        offsets = np.cumsum([0, *(len(p) + 1 for _, p in batch)])
        cuts = upto[np.searchsorted(at, offsets)]
        np.add.at(counts, [k for k, _ in batch], np.diff(cuts))
