"""Ids are the library's for every code point, for words whose hashes collide, and only for files whose steps are followed."""

import json

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomlight.llm import bpe, token_files, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def agree(encoder, texts):
    library = Tokenizer.from_file(PATH)
    counts, ids = encoder.encode(texts)
    ends = np.cumsum(counts)
    for k, found in enumerate(library.encode_batch_fast(texts, add_special_tokens=False)):
        assert found.ids == ids[ends[k] - counts[k] : ends[k]].tolist(), ascii(texts[k][:80])


@pytest.fixture(params=["own", "library"])
def encoder(request):
    make = bpe.encoder if request.param == "own" else token_files.library_encoder
    return make(PATH, words.rules(PATH))


def test_every_code_point(encoder):
    """All but the planes of which no code point has ever been assigned, of which some."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or c % 97 == 0 or 0xE0000 <= c < 0xE0200)]
    agree(encoder, ["".join("a%sb %s%s!é%sΣ J%s " % ((chr(c),) * 5) for c in points[k : k + 500]) for k in range(0, len(points), 500)])


def test_words_of_one_hash(encoder):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 whatever the multiplier."""
    bits = [k.bit_count() & 1 for k in range(2048)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    classes = words._table(words.rules(PATH))
    at, ends, first = words.split(f"{one} {other} {one} {other}", classes)
    assert first.tolist() == [0, 1, 0, 1]
    agree(encoder, [f"{one} {other}", f"{other} x {one} {other}", other])


def test_letters_that_compose_after_lower_case(encoder):
    agree(encoder, ["J̌ T̈ H̱ W̊ Y̊ x", "ǰ ẗ", "ΑΣ Σ ΣΑ", "İI ı"])


@pytest.mark.parametrize("change", [("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("post_processor", {"type": "ByteLevel"})])
def test_other_files_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec[change[0]] = change[1]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        words.rules(str(tmp_path / "t.json"))


def test_select_over_many_blocks():
    rng = np.random.default_rng(3)
    for values in (np.cumsum(rng.integers(0, 3000, 30_000)), np.sort(rng.integers(0, 1 << 60, 20_000)), np.zeros(9000, np.int64)):
        e = token_files.EliasFano.parse(token_files.EliasFano.of(values).dump())
        at = rng.permutation(len(values))
        assert np.array_equal(e.select(at), values[at])


def test_a_frequent_id_is_dealt_to_several_files(spark, tmp_path):
    """Two thirds of the rows share an id or have none; files still ascend, and starts add up."""
    import functools

    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    make = functools.partial(token_files.library_encoder, PATH, words.rules(PATH))
    listed = token_files.write(docs, f"file://{tmp_path}", make, 2, 2).orderBy("part", "seq").collect()
    held = [token_files.TokenFile(r.uri).doc_ids() for r in listed]
    flat = [i for ids in held for i in ids]
    assert len(held) > 2 and flat == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert max(map(len, held)) < 200
    got = token_files.round_trip(docs, make, 2, 2).orderBy("start").collect()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
