"""Texts that break careless code."""

import random

FIXED = [
    None, "", " ", "\n\n\n", "a", "A B", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ ẞ", "éclair é", "it's we'll I'D they've 'tis ''s", "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endof text|>",
    "１２３ ४५६ Ⅷ ½ 12345", "  　x​‍y﻿", "🙂👩‍👩‍👧 ok🙂ok", "\x00\x01\x1f\x7f a\x00b", "a\u0085b c\x0bd\x0ce", "中文字符没有空格 日本語テキスト 한국어", "!!!???...---___", "don't" * 50, "x" * 5000, "ab " * 3000, "\U0010ffff ", "ﬁ ﬂ Ǆ ǅ ŉ ΐ",
]


def texts(n: int, seed: int = 1) -> list:
    rng = random.Random(seed)
    pieces = ["the", "of", "Running", "über", "naïve", "É", "123", "4.5", "!", "...", " ", "  ", "\n", "\t", "'s", "'RE", "foo_bar", "<|endoftext|>", "日本", "🙂", "é", "zq", "antidisestablishment", " ", "-", "http://x.y/z?q=1"]
    made = ["".join(rng.choice(pieces) + rng.choice(["", "", " "]) for _ in range(rng.randrange(40))) for _ in range(n)]
    return FIXED + made


def rows(n: int, seed: int = 1) -> list[tuple]:
    return [(k if k % 17 else k // 2, t) for k, t in enumerate(texts(n, seed))] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]


SCHEMA = "doc_id long, text string"
EXTRA = "doc_id long, text string, n_tokens string, score string, held_out string, fingerprint string, _text string, row string, key string, word string, n int, a string, t string, v int, base string, found string, n_words string, contaminated string, items string"


def extra(spark, data):
    """The rows with columns whose names clash with what operators make."""
    return spark.createDataFrame([(*r, *["z"] * 8, 1, "z", "z", 1, *["z"] * 5) for r in data], EXTRA)
