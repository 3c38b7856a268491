"""Long texts are worked through in parts; the parts must not show."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from tracewell.llm import byte_bpe, grams, token_counts, words
from tracewell.llm.common import text_bytes


def test_words_in_parts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "é", " ", ".", "xyz"]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", "q" * 9000, "ab", "ab"]
    data, offsets = text_bytes(pa.array(texts))
    whole = words.split_words(data, offsets)
    for limit in (1, 3, 7, 50, 1000):
        parts = words.split_words(data, offsets, limit)
        assert (parts.hashes == whole.hashes).all() and (parts.first == whole.first).all()


def test_grams_in_parts():
    data, offsets = text_bytes(pa.array(["abc abd é " * 50]))
    whole = grams.text_grams(data, offsets, 5)
    for limit in (1, 2, 5, 37):
        parts = grams.text_grams(data, offsets, 5, limit)
        assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(whole, parts, strict=True))


def test_tokens_in_parts():
    rng = random.Random(2)
    alphabet = ["a", "the", " ", "  ", "\n", "'s", "1", "é", "!", "<|endoftext|>", " b", "tion"]
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    own = byte_bpe.codec(path, pattern)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
    counter, library = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        parts = list(byte_bpe.chunks(text, 5))
        assert "".join(parts) == text
        assert [i for p in parts for i in theirs.encode_ordinary(p)] == theirs.encode_ordinary(text)
        assert sum(counter.count(p) for p in parts) == len(library.encode(text, add_special_tokens=False).ids)
    long = "some words and more of them, it's 12 " * 40_000
    ids = own.encode(long)
    assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(long) and own.decode(ids) == long.encode()
    total, (pieces, counts) = counter.count_and_start(long, 100)
    assert total == len(library.encode(long, add_special_tokens=False).ids)
    assert token_counts.PrefixTable(counter, long, (pieces, counts)).cut(100) == token_counts.PrefixTable(counter, long[:5000]).cut(100)
