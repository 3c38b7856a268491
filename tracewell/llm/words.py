"""Words of many texts at once, as positions and 64-bit hashes, without a Python loop."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tracewell.llm.common import splitmix64

#: A-Z lower-cased; a word is a longest run of 0-9, a-z and all bytes of non-ASCII characters.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_VALUE = splitmix64(np.arange(256, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 64) - 1, _BASE)]))
    return _powers


@dataclass
class Words:
    """``hashes`` of the words of all texts in order; those of text i are ``first[i]`` to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offsets: np.ndarray, limit: int = 4 << 20) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased texts, hashed.

    Two words have equal hashes if they are equal, and else with a chance of about
    2**-64.  More than ``limit`` bytes are worked through in parts that end where no
    word goes on.
    """
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data) and _IN_WORD[_LOWER[data[end]]]:
            ahead = np.flatnonzero(~_IN_WORD[_LOWER[data[end : end + 4096]]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + 4096)
        cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end)] - at
        own, found = _split_part(data[at:end], cuts)
        starts.append(own + at)
        hashes.append(found)
        at = end
    if not starts:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    return Words(np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets))


def _split_part(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes; a word ends at a cut in any case."""
    low = _LOWER[data]
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = _IN_WORD[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    letters = low[inside[:-1]]
    at = np.cumsum(inside[:-1])[starts] - 1  # of each word's first letter among the letters
    lengths = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_VALUE[letters] * _power_table(int(lengths.max()))[place], at)
    return starts, splitmix64(sums ^ lengths.astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (texts are not told apart)."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = splitmix64(out ^ hashes[i : i + n])
    return out


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``size`` words of each text, sorted, and the n + 1 bounds of the texts.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    counts = np.diff(words.first)
    run = windows(words.hashes, size)
    text = words.text_of
    last = words.first[1:][text] - size if len(text) else text
    keep = np.flatnonzero(np.arange(len(text)) <= last)
    short = np.flatnonzero((counts > 0) & (counts < size))
    own = []
    for i in short:
        h = words.hashes[words.first[i] : words.first[i + 1]]
        own.append(windows(h, len(h))[0] ^ np.uint64(len(h)))
    owner = np.concatenate([text[keep], short])
    value = np.concatenate([run[keep], np.array(own, np.uint64)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[fresh], value[fresh]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))
