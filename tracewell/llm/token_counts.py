"""Exact token counts at every prefix of a text, by dynamic programming over its bytes.

A sequence of byte-pair tokens is the encoding of its bytes just if each two
neighbours are, and every prefix of an encoding is the encoding of what it spells.
So each prefix has one last token: the token that ends there and may stand after the
last token of what is left before it.  The count at a prefix is then one more than at
the place where its last token begins.
"""

from __future__ import annotations

import functools
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tracewell.llm.byte_bpe import Splitter, byte_letters, chunks
from tracewell.llm.common import map_batches, slices

#: The pattern of the library's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker keeps; beyond it the store starts anew.  Longer pre-tokens are not kept.
CACHE_ENTRIES = 500_000
CACHE_PIECE = 64


def _library_class(name: str, every: str) -> set[str]:
    cut = pre_tokenizers.Split(Regex(name), "removed", invert=True)
    return {c for piece, _ in cut.pre_tokenize_str(every) for c in piece}


class PrefixCounter:
    """Counts for a byte-level BPE of the tokenizers library, from its JSON file.

    Added tokens are found in the text first, as the library does by default; each
    counts one token, a prefix that ends inside one counts it as ordinary text.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = not any((spec["normalizer"], model["dropout"], model["byte_fallback"], model.get("ignore_merges"), pre.get("add_prefix_space")))
        odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not plain or odd:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.vocab: dict[str, int] = model["vocab"]
        self.spelling = {i: t for t, i in self.vocab.items()}
        self.bpe = Tokenizer.from_file(path).model
        self.automaton = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.cut_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))).split if self.added else None
        self.split = Splitter(PATTERN, _library_class)
        self.spell = dict(enumerate(byte_letters()))
        self.fits: dict[int, bool] = {}
        self.whole: dict[str, int] = {}

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: stand first): whether their bytes encode as just these."""
        if len(self.fits) > 4 * CACHE_ENTRIES:
            self.fits.clear()
        tokens = self.bpe.tokenize((self.spelling[a] if a >= 0 else "") + self.spelling[b])
        known = self.fits[a << 20 | b] = [t.id for t in tokens] == ([a, b] if a >= 0 else [b])
        return known

    def piece_counts(self, piece: str) -> list[int]:
        """Counts at byte 0, 1, ... of one pre-token."""
        s = piece.encode().decode("latin-1").translate(self.spell)
        fits, counts, last = self.fits.get, [0], [-1]
        for end, (token, n) in self.automaton.iter(s):  # all tokens that end here, for one end after the other
            if end + 1 == len(last):
                before = last[-n]
                fit = fits(before << 20 | token)
                if fit or fit is None and self._fit(before, token):
                    counts.append(counts[-n] + 1)
                    last.append(token)
        return counts

    def _piece(self, piece: str) -> int:
        n = self.whole.get(piece)
        if n is None:
            n = self.piece_counts(piece)[-1]
            if len(piece) <= CACHE_PIECE:
                if len(self.whole) > CACHE_ENTRIES:
                    self.whole.clear()
                self.whole[piece] = n
        return n

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """Pre-tokens with their counts, in order; an added token is a piece with count 1."""
        if self.cut_added is None or not any(a in text for a in self.added):
            for p in self.split(text):
                yield p, self._piece(p)
            return
        at = 0
        for part in self.cut_added(text):
            for p in self.split(part):
                yield p, self._piece(p)
            at += len(part)
            if at < len(text):
                token = next(a for a in sorted(self.added, key=len, reverse=True) if text.startswith(a, at))
                yield token, 1
                at += len(token)

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """Pre-tokens and their counts; the sum is the count at the last prefix."""
        if self.cut_added is not None and any(a in text for a in self.added):
            pieces, counts = zip(*self.pieces(text), strict=True)
            return list(pieces), list(counts)
        pieces = self.split(text)
        counts = list(map(self.whole.get, pieces))
        return pieces, list(map(self._piece, pieces)) if None in counts else counts

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(sum(self.counts(part)[1]) for part in chunks(text))

    def count_and_start(self, text: str, limit: int) -> tuple[int, tuple[list[str], list[int]]]:
        """Tokens of the whole text, and its first pre-tokens with their counts, enough for ``limit`` tokens."""
        total, pieces, counts = 0, [], []
        for part in chunks(text):
            p, c = self.counts(part)
            total += sum(c)
            if len(pieces) <= limit:  # a pre-token is a token at least
                pieces += p[: limit + 1]
                counts += c[: limit + 1]
        return total, (pieces[: limit + 1], counts[: limit + 1])


class PrefixTable:
    """Counts at all prefixes of one text, answering without encoding again.

    A cut between pre-tokens, or inside one, counts what the library gives for the
    text up to the cut.  Two kinds of cut change the pre-tokens before them and are
    counted so: inside a run of white space, whose last space else goes to the next
    word, and inside a contraction such as 'll.
    """

    def __init__(self, counter: PrefixCounter, text: str, counted: tuple[list[str], list[int]] | None = None):
        self.counter, self.text = counter, text
        self.found, counts = counted or counter.counts(text)
        self.starts = [0, *accumulate(map(len, self.found))]  # in characters
        self.sums = [0, *accumulate(counts)]

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        if not 0 <= chars <= len(self.text):
            raise IndexError(chars)
        k = max(0, bisect_left(self.starts, chars) - 1)
        run = chars
        while run and regex.match(r"\p{White_Space}", self.text[run - 1]):
            run -= 1
        if chars - run > 1 or (run < chars < len(self.text) and chars < self.starts[k + 1]):
            return self.at(run) + self.counter.piece_counts(self.text[run:chars])[-1]
        if chars == self.starts[k]:
            return self.sums[k]
        inner, piece = chars - self.starts[k], self.found[k]
        if inner == len(piece):
            return self.sums[k + 1]
        if piece in self.counter.added:
            part = max((self.starts[i + 1] for i in range(k) if self.found[i] in self.counter.added), default=0)
            return self.sums[bisect_left(self.starts, part)] + sum(map(self.counter._piece, self.counter.split(self.text[part:chars])))
        if piece in ("'re", "'ve", "'ll") and inner == 2:
            return self.sums[k] + 2
        return self.sums[k] + self.counter.piece_counts(piece)[len(piece[:inner].encode())]

    def cut(self, budget: int) -> int:
        """Characters of the longest prefix of ``budget`` tokens at most, among the cuts
        inside the last pre-token that begins within the budget and at its ends."""
        k = bisect_left(self.sums, budget) if budget > 0 else 0
        if k >= len(self.sums):
            return len(self.text)
        if self.sums[k] == budget or not k:
            return self.starts[k]
        low, high = self.starts[k - 1], self.starts[k]
        return next(c for c in range(high, low - 1, -1) if self.at(c) <= budget)


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One counter for each worker process."""
    return PrefixCounter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars``.

    Counts are of the whole text (null: empty), as the library gives them without
    added begin and end tokens.  ``fit_chars`` is the length in characters of the part
    that fits in ``limit`` tokens, read from the prefix table.  ``path`` is read on
    the executors.  Repeated rows give repeated rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, fit = [], []
            for t in texts:
                n, first = own.count_and_start(t, limit)
                counts.append(n)
                fit.append(len(t) if counts[-1] <= limit else PrefixTable(own, t, first).cut(limit))
            out = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], [key, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return map_batches(df.select(F.col(key).cast("long").alias(key), text), run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
