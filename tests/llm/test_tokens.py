"""Token ids against the tokenizers library; token files against its ids."""

import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomlight.llm import bpe, token_files, words
from tests.llm import nasty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def check(spark, library, rows):
    got = bpe.digests(spark.createDataFrame(rows, nasty.SCHEMA), PATH)
    found = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()), key=str)
    assert found == sorted(((i, *expected(library, t)) for i, t in rows), key=str)


def test_nasty_texts(spark, library):
    check(spark, library, nasty.rows(300))


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check(spark, library, [tuple(r) for r in docs.collect()])


def test_random_words(library):
    rng = random.Random(5)
    v = bpe.vocabulary(PATH)
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    for word, ids in zip(made, v.encode_words(made)):
        assert ids == library.encode(word, add_special_tokens=False).ids, word


def test_emptied_tables_and_short_passes_change_nothing(library, monkeypatch):
    monkeypatch.setattr(words, "LIMIT", 5)
    monkeypatch.setattr(words, "PASS_CHARS", 40)
    v = bpe.vocabulary(PATH)
    encoder, texts = words.Encoder(v.encode_words, v.specials, words.rules(PATH), library.normalizer.normalize_str), nasty.texts(200, 8)
    for _ in range(2):
        counts, ids = encoder.encode(texts)
        for text, n, end in zip(texts, counts.tolist(), np.cumsum(counts).tolist()):
            assert ids[end - n : end].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_texts_without_spaces_are_cut(library, monkeypatch):
    monkeypatch.setattr(words, "PASS_CHARS", 20)
    rng, v = random.Random(3), bpe.vocabulary(PATH)
    encoder = words.Encoder(v.encode_words, v.specials, words.rules(PATH), library.normalizer.normalize_str)
    parts = ["don't", "'re", "'", "'s", "x", "42", "7", "...", "-", "中文。", "中，", "！", "é", "e\u0301", "\u0301", "\u0338", "=", "ﬁ", "Σ", "①", "a", "_b", "<", "|"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 120)))
        counts, ids = encoder.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    pieces = [p for _, p, _ in encoder.pieces(["ab1c,d-" * 500])]
    assert max(map(len, pieces)) < 30 and "".join(pieces) == "ab1c,d-" * 500


def test_encode_and_decode_keep_columns(spark, library):
    df = nasty.extra(spark, nasty.rows(20))
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(out) == df.count()
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.n_tokens == "z"
    assert bpe.digests(spark.createDataFrame([], nasty.SCHEMA), PATH).collect() == []
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [None, 5])], "doc_id long, ids array<int>"), PATH).orderBy("doc_id").collect()[0].decoded == ""


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (5, 5), (1000, 1000), (3000, 10**9), (2000, 2100), (513, 1 << 40)):
        values = np.sort(rng.integers(0, top, n)) + 77
        e = token_files.EliasFano.parse(token_files.EliasFano.of(values).dump())
        assert e.select(np.arange(n)).tolist() == values.tolist()
        if n:
            at = rng.integers(0, n, 50)
            assert e.select(at).tolist() == values[at].tolist()
            assert len(e.dump()) * 8 <= n * (2 + max(0, np.log2((values[-1] - values[0] + 1) / n)) + 1) + 600


def test_token_files(spark, library):
    rows = [r for r in nasty.rows(60) if r[0] is not None]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = token_files.round_trip(spark.createDataFrame(rows, nasty.SCHEMA), functools.partial(token_files.library_encoder, PATH, words.rules(PATH)), 2, 2)
    want, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want


def test_token_files_without_ids_or_rows(spark):
    make = functools.partial(token_files.library_encoder, PATH, words.rules(PATH))
    assert token_files.round_trip(spark.createDataFrame([], nasty.SCHEMA), make, 2).collect() == []
    got = token_files.round_trip(spark.createDataFrame([(None, "a"), (5, "b"), (5, "b"), (None, None)], nasty.SCHEMA), make, 2).collect()
    assert len(got) == 4 and sorted(r.start for r in got if r.doc_id is None) in ([0, 1], [0, 2])


def test_a_document_is_found_by_select(spark, library, tmp_path):
    rows = [(k, f"text number {k}") for k in range(50)]
    files = token_files.write(spark.createDataFrame(rows, nasty.SCHEMA), f"file://{tmp_path}", functools.partial(token_files.library_encoder, PATH, words.rules(PATH)), 2).collect()
    f = token_files.TokenFile(files[0].uri)
    k = len(f.doc_ids()) - 1
    assert f.document(k).tolist() == [*library.encode(f"text number {f.doc_ids()[k]}", add_special_tokens=False).ids, 2]
