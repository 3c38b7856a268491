"""Benchmark decontamination with suffix arrays over the words of the training texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ddl, map_batches, slices, splitmix64, text_bytes
from tracewell.llm.words import Words, split_words

#: Benchmark text that one block of test suffixes holds; more is worked through in blocks.
BLOCK_BYTES = 8 << 20

SCHEMA = "n_words long, n_hit long, item_ids array<string>, matches array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


@dataclass
class Windows:
    """The test windows of one size.

    ``rows`` has each distinct window; the test suffixes that begin with window i are
    ``starts[bounds[i]:bounds[i + 1]]``, sorted as suffixes; ``sets[i]`` numbers the set
    of items that hold it.
    """

    rows: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray
    sets: np.ndarray


@dataclass
class Tests:
    """Benchmark words end to end, and the windows that start test suffixes."""

    names: list[str]  # of the items
    ranks: np.ndarray  # for each benchmark word its hash's place in ``singles``, from 1
    end_of: np.ndarray  # for each benchmark word, where its item ends
    item_of: np.ndarray
    first: np.ndarray
    sizes: dict[int, Windows]
    item_sets: list[frozenset[str]]  # each different set of items that a window has
    pairs: np.ndarray  # hashes of two neighbouring words of an item, sorted
    singles: np.ndarray


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix64(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _suffix_ranks(ranks: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, each read to its item's end; equal ones share a place.

    Prefix doubling: what is sorted by k words is sorted by 2k from the places at k words' distance.
    """
    place, k, longest = ranks, 1, int((end_of - np.arange(len(ranks))).max(initial=0))
    while k < longest:
        later = np.arange(len(ranks)) + k
        second = np.where(later < end_of, place[np.minimum(later, len(ranks) - 1)], 0)
        order = np.lexsort((second, place))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (place[order][1:] != place[order][:-1]) | (second[order][1:] != second[order][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh)
        k *= 2
    return place


def index_tests(items: pa.Table, size: int) -> Tests:
    """Test suffixes of items (item_id as text, text): one for each word that begins a window."""
    items = items.sort_by([("item_id", "ascending"), ("text", "ascending")])
    names = items.column("item_id").to_pylist()
    words = split_words(*text_bytes(items.column("text").combine_chunks()))
    text = words.text_of
    end_of = words.first[1:][text] if len(text) else text
    need = np.minimum(size, np.diff(words.first))[text] if len(text) else text
    starts = np.flatnonzero(np.arange(len(text)) + need <= end_of)
    singles, ranks = np.unique(words.hashes, return_inverse=True)
    ranks = ranks.ravel() + 1
    place = _suffix_ranks(ranks, end_of)
    sizes, numbers = {}, {}
    for m in np.unique(need[starts]).tolist() if len(starts) else []:
        own = starts[need[starts] == m]
        own = own[np.lexsort((own, place[own]))]
        rows = words.hashes[own[:, None] + np.arange(m)]
        bounds = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
        ends = np.append(bounds, len(own))
        sets = [frozenset(names[i] for i in text[own[a:b]].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        sizes[m] = Windows(rows[bounds], own, ends, np.array([numbers.setdefault(x, len(numbers)) for x in sets], np.int64))
    near = np.flatnonzero(text[1:] == text[:-1]) if len(text) else text
    return Tests(names, ranks, end_of, text, words.first, sizes, list(numbers), np.unique(_pair(words.hashes[near], words.hashes[near + 1])), singles)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def suffix_array(words: Words, text: np.ndarray, size: int, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that may begin with a window of ``size`` words, sorted by these words; and the sorted columns.

    A suffix can begin with a test window only if each two neighbouring words of its
    first ``size`` are neighbours in the benchmark, so the others are left out: no test
    suffix's search would end at them.
    """
    h = words.hashes
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros((size, 0), np.uint64)
    if size == 1:
        keep = np.flatnonzero(_member(h, tests.singles))
    else:
        good = _member(h, tests.singles)
        pair = np.flatnonzero(good[1:] & good[:-1] & (text[1:] == text[:-1]))
        linked = np.zeros(len(h), np.int64)
        linked[pair[_member(_pair(h[pair], h[pair + 1]), tests.pairs)] + 1] = 1  # word i follows i - 1
        upto = np.cumsum(linked)
        keep = np.flatnonzero(upto[size - 1 :] - upto[:n] == size - 1)
    columns = h[keep[None, :] + np.arange(size)[:, None]]
    order = np.lexsort(columns[::-1])
    return keep[order], columns[:, order]


def _bound(column: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, after: bool) -> np.ndarray:
    """Binary search in column[low:high] for all values together."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = column[np.minimum(mid, len(column) - 1)]
        right = open_ & ((at <= value) if after else (at < value))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def search(columns: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test window the range of the suffix array that begins with it, a word at a time."""
    low = np.zeros(len(rows), np.int64)
    high = np.full(len(rows), columns.shape[1], np.int64)
    live = np.arange(len(rows))
    for k in range(columns.shape[0]):
        a = _bound(columns[k], low[live], high[live], rows[live, k], False)
        b = _bound(columns[k], a, high[live], rows[live, k], True)
        low[live], high[live] = a, b
        live = live[a < b]
        if not len(live):
            break
    return low, high


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each i and each j from low[i] to high[i]."""
    counts = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), counts)
    return which, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]


def _longest(words: Words, tests: Tests, own: Windows, window: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a test suffix, words) of the longest match that begins at each place, where a window begins.

    The test suffixes that begin with what has matched so far are a range; the next
    word of the document narrows it by two binary searches.
    """
    low, high = own.bounds[window].copy(), own.bounds[window + 1].copy()
    length, live = np.full(len(place), size), np.arange(len(place))
    ends = words.first[1:][words.text_of[place]]

    def bound(a: np.ndarray, b: np.ndarray, value: np.ndarray, after: bool, step: int) -> np.ndarray:
        a, b = a.copy(), b.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            start = own.starts[np.minimum(mid, len(own.starts) - 1)]
            at = start + step
            there = np.where(at < tests.end_of[start], tests.ranks[np.minimum(at, len(tests.ranks) - 1)], 0)
            right = open_ & ((there <= value) if after else (there < value))
            a = np.where(right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)
        return a

    step = size
    while len(live := live[place[live] + step < ends[live]]):
        word = words.hashes[place[live] + step]
        value = np.searchsorted(tests.singles, word)
        known = tests.singles[np.minimum(value, len(tests.singles) - 1)] == word
        live, value = live[known], value[known] + 1
        a = bound(low[live], high[live], value, False, step)
        b = bound(a, high[live], value, True, step)
        some = a < b
        live = live[some]
        low[live], high[live] = a[some], b[some]
        step += 1
        length[live] = step
    return own.starts[low], length


@dataclass
class Found:
    """Matches in one slice of documents, as columns, and the item sets of each document."""

    columns: list[list[np.ndarray]]  # text, place, words, item name, item word
    items: set[tuple[int, frozenset[str]]]


def find(words: Words, tests: Tests, hit: np.ndarray, found: Found) -> None:
    """Adds to ``found`` the longest match of each word that begins a window; ``hit`` counts up at window words.

    A place has one match and a document each item set once, however many items share a window.
    """
    text = words.text_of
    edge = np.zeros(len(hit) + 1, np.int64)
    for size, own in tests.sizes.items():
        suffixes, columns = suffix_array(words, text, size, tests)
        if not len(suffixes):
            continue
        window, at = _spread(*search(columns, own.rows))
        if not len(window):
            continue
        place = suffixes[at]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + size, -1)
        for doc, number in np.unique(np.stack([text[place], own.sets[window]]), axis=1).T.tolist():
            found.items.add((doc, tests.item_sets[number]))
        test, length = _longest(words, tests, own, window, place, size)
        item = tests.item_of[test]
        found.columns.append([text[place], place, length, np.array(tests.names, object)[item], test - tests.first[item]])
    hit += np.cumsum(edge)[:-1]


def _outermost(found: Found, first: np.ndarray, rows: int) -> list[list[dict]]:
    """For each document its matches that lie in no other."""
    out: list[list[dict]] = [[] for _ in range(rows)]
    if not found.columns:
        return out
    text, place, length, name, word = (np.concatenate(c) for c in zip(*found.columns, strict=True))
    reach = -1
    for i in np.lexsort((-length, place)).tolist():  # a match ends in its document, so places tell documents apart
        if place[i] + length[i] > reach:
            reach = int(place[i] + length[i])
            out[text[i]].append({"item_id": name[i], "item_word": int(word[i]), "doc_word": int(place[i] - first[text[i]]), "n_words": int(length[i])})
    return out


def contamination(df: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", item_key: str = "item_id", item_text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each document its words, the words inside a benchmark window, and the longest matches.

    The columns to carry, ``n_words``, ``n_hit``, ``item_ids`` (distinct, sorted as strings) and
    ``matches``: item, place in the item, place in the document and length in words of
    the longest verbatim matches, those that lie in no other; of items that match as
    far, one is named.  A window is ``size`` consecutive words of an item; an item of
    fewer words, but not none, is one window.

    A shard is a slice of a partition: its suffix array is built in memory and every
    test suffix is searched in it.  Documents are not shuffled.  Test suffixes are sent
    in blocks of ``BLOCK_BYTES`` of benchmark text, and a worker holds one block at a
    time.  Null texts have no words; items of a null id are called ``null``; repeated
    rows give repeated rows, repeated items one id.
    """
    spark = df.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_key).cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    blocks = []
    for i in range(n_blocks):
        own = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i)
        blocks.append(spark.sparkContext.broadcast(index_tests(own.toArrow(), size)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            words = split_words(*text_bytes(batch.column(0)))
            hit, found = np.zeros(len(words.hashes), np.int64), Found([], set())
            for block in blocks:
                find(words, block.value, hit, found)
                if len(blocks) > 1:
                    del block._value
            sums = np.concatenate([[0], np.cumsum(hit > 0)])
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for doc, names in found.items:
                items[doc] |= names
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(sums[words.first[1:]] - sums[words.first[:-1]], pa.int64()),
                    pa.array(map(sorted, items), pa.list_(pa.string())),
                    pa.array(_outermost(found, words.first, batch.num_rows), _MATCHES),
                ],
                [*carry, "n_words", "n_hit", "item_ids", "matches"],
            )

    return map_batches(df.select(F.col(text).alias("__text"), *carry), run, f"{ddl(df, list(carry))}, {SCHEMA}")


_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))


def is_contaminated() -> F.Column:
    """A twentieth of the words, one at least, are inside benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
