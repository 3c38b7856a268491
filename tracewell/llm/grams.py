"""Byte n-grams of many texts at once, packed into 64-bit integers."""

from __future__ import annotations

import numpy as np

#: What stands before a text: newlines, as many as a context is long.
PAD = 10


def gram_keys(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """For each byte the integer of the last ``size`` bytes, itself the lowest; texts don't run into each other."""
    before = size - 1
    counts = np.diff(offsets)
    shift = np.repeat(before * np.arange(1, len(counts) + 1), counts)
    place = np.arange(len(data)) + shift
    padded = np.full(len(data) + before * len(counts), PAD, np.uint8)
    padded[place] = data
    keys = np.zeros(len(padded) - before if len(padded) else 0, np.uint64)
    for i in range(size):
        keys <<= np.uint64(8)
        keys |= padded[i : i + len(keys)]
    return keys[place - before]


def distinct_by_text(keys: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, times) of each distinct gram of each text, in order.  Up to 7 bytes: the text's number has the rest."""
    counts = np.diff(offsets)
    bits = np.uint64(8 * size)
    if len(counts) >= 1 << (64 - 8 * size):
        raise ValueError("too many texts in one slice")
    marked = np.repeat(np.arange(len(counts), dtype=np.uint64) << bits, counts) | keys
    found, times = count_keys(marked)
    return (found >> bits).astype(np.int64), found & ((np.uint64(1) << bits) - np.uint64(1)), times


def text_grams(data: np.ndarray, offsets: np.ndarray, size: int, limit: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``distinct_by_text`` of the grams of all texts; one long text by itself is worked through in parts."""
    if len(data) <= limit or len(offsets) != 2:
        return distinct_by_text(gram_keys(data, offsets, size), offsets, size)
    keys, times = long_text_grams(data, size, limit)
    return np.zeros(len(keys), np.int64), keys, times


def long_text_grams(data: np.ndarray, size: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of one text and how often each comes, with memory for a part and the distinct grams."""
    held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(data), limit):
        before = min(at, size - 1)
        part = data[at - before : at + limit]
        keys = gram_keys(part, np.array([0, len(part)]), size)[before:]  # the first have their true context
        held = add_counts(held, count_keys(keys))
    return held


def count_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each comes."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def add_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of sorted keys and counts, summed."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], np.concatenate([a[1], b[1]])[order]
    if not len(keys):
        return keys, times
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def look_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a sorted table and whether they are there; a missing key has place 0."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys
