"""Prefix BPE against tiktoken, and edits against encoding anew."""

import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from marginalia.llm import bpe

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
ODD = ["", " ", "a" * 5000, " " * 3000 + "x", "ab" * 4000, "中文" * 1500, "\n" * 300, "1" * 777, "it's we'll 'x <|endoftext|>", "\U0001f600́\x00\x7f�"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, PATTERN, words=1000)


@pytest.fixture(scope="module")
def given():
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_ids_of_odd_texts(encoder, given):
    rng, tokens = random.Random(5), list(RANKS)
    texts = ODD + [b"".join(rng.choices(tokens, k=rng.randrange(1, 9))).decode("utf-8", "replace") for _ in range(2000)]
    texts += [bytes(rng.choices(b"abcdeaaaa  '\xc3\xa9\n", k=rng.randrange(1, 40))).decode("utf-8", "replace") for _ in range(2000)]
    for t in texts:
        assert encoder.encode(t) == packed(given.encode_ordinary(t)), t
        assert bpe.decoded(encoder.encode(t), encoder.vocabulary.bytes_of) == t.encode()
    assert len(encoder.words) <= 1000


def test_ranks_with_tokens_that_joins_never_reach():
    letters = {bytes([b]): b for b in range(256)}
    rng = random.Random(6)
    for trial in range(60):
        more = {bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(rng.randrange(1, 25))}
        ranks = letters | {t: 256 + k for k, t in enumerate(rng.sample(sorted(more), len(more)))}
        own, given = bpe.Encoder(ranks, PATTERN), tiktoken.Encoding(f"t{trial}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for _ in range(150):
            t = "".join(rng.choices("abc ", k=rng.randrange(1, 14)))
            assert own.encode(t) == packed(given.encode_ordinary(t)), (ranks, t)


def test_every_prefix_has_its_last_token(encoder, given):
    rng = random.Random(7)
    for _ in range(40):
        word = "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 30)))
        prefixes = bpe.Prefixes(encoder.vocabulary)
        for k, c in enumerate(word):
            prefixes.append(c.encode())
            assert prefixes.ids() == given.encode_ordinary(word[: k + 1])
        for k in range(len(word) - 1, 0, -1):
            assert prefixes.cut(k).ids() == given.encode_ordinary(word[:k])
        assert bpe.Prefixes(encoder.vocabulary, prefixes.data, prefixes.last[1:]).append(word[1:].encode()).ids() == given.encode_ordinary(word)


def test_edits_equal_encoding_anew(encoder):
    rng = random.Random(8)
    for _ in range(2000):
        old, new = ("".join(rng.choices("ab1 '\n\tré,.中s'll ", k=rng.randrange(0, n))) for n in (60, 8))
        start = rng.randrange(len(old) + 1)
        end = rng.randrange(start, len(old) + 1)
        text, table, _ = encoder.edited(old, encoder.table(old), start, end, new)
        assert text == old[:start] + new + old[end:] and table == encoder.table(text)
    old = "some words here, " * 2000
    text, table, worked = encoder.edited(old, encoder.table(old), 17000, 17004, "other")
    assert table == encoder.table(text) and worked < 40
    text, table, worked = encoder.edited(old, encoder.table(old), len(old), len(old), "'re added")  # an append
    assert table == encoder.table(text) and worked < 40


def test_frames(spark, given):
    rows = [(1, "two words", "x"), (1, "two words", "x"), (None, None, "y"), (2, "", None), (3, "é" * 60_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 string")
    both = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH)
    assert both.columns == ["doc_id", "text", "c0", "_ids", "_bytes"]
    found = both.collect()
    assert len(found) == 5
    for r in found:
        assert bytes(r._ids) == packed(given.encode_ordinary(r.text or "")) and bytes(r._bytes).decode() == (r.text or "")
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0
    again = bpe.encode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)  # the added name is in use already
    assert again.columns == ["doc_id", "text", "c0", "_ids"]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(bytearray(b"\xff\xff\xff\x7f"),)], "_ids binary"), PATH).collect()
    assert bpe.decode(spark.createDataFrame([(None,)], "_ids binary"), PATH).first()._bytes is None
