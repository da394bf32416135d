import base64
import random

import pytest
import tiktoken

from glyphmill.llm.encode import DEFAULT, SPLIT, count_tokens, encode_texts, encoder


@pytest.fixture(scope="module")
def other():
    with open(DEFAULT, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def test_random_and_hard_texts(other):
    rng, enc = random.Random(3), encoder(DEFAULT)
    texts = ["".join(rng.choice("aabcdetsin  '.é中ب\n\t0123🙂<|endoftext|>ＡａⅧ\u200b") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["a" * 30_000, "ab" * 9_000, " " * 5_000, "\n \n", "don't'll <|endoftext|>", "漢" * 4_000]
    for x in texts:
        assert enc.encode(x) == other.encode_ordinary(x)


def test_rows_nulls_and_repeats(spark, other):
    rows = [(1, "Hello world", 5), (2, None, 6), (3, "", 7), (1, "Hello world", 8), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in encode_texts(df, "doc_id", "text").collect()), key=str)
    hello = other.encode_ordinary("Hello world")
    assert got == sorted([(1, hello), (2, []), (3, []), (1, hello), (None, other.encode_ordinary("x"))], key=str)
    assert sorted(r.tokens for r in count_tokens(df, "doc_id", "text").collect()) == [0, 0, 1, len(hello), len(hello)]
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
