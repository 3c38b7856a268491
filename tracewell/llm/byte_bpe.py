"""Byte-level BPE encoding and decoding with a sentencepiece model made from the vocabulary."""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, slices

#: Pre-tokens whose ids a worker keeps; beyond it the store starts anew.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are not kept.
CACHE_PIECE = 64


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of lines ``base64 rank``; ranks must be 0, 1, 2 ..."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens) or len(set(tokens)) != len(tokens):
        raise ValueError(f"{path}: ranks have gaps or tokens repeat")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: length-delimited, 32-bit float or varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks.

    Each piece is its token's bytes as letters, scored by the negative rank, so the
    best-scored merge is the one of least rank.  Normalisation is the identity and
    adds no prefix.  The model format demands an unknown piece; it comes last and is
    never met, since all 256 bytes are pieces.
    """
    letters = byte_letters()
    spell = lambda t: "".join(map(letters.__getitem__, t)).encode()
    pieces = [_field(1, _field(1, spell(t)) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, float(-len(tokens))) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def code_point_ranges(inside: set[str]) -> str:
    """These code points as the ranges of a character class."""
    points, out = sorted(map(ord, inside)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Splitter:
    """Cuts texts into pre-tokens by a pattern of \\p{L}, \\p{N}, \\s and \\S.

    The regex module may know a later Unicode version than the library whose results
    count.  ``members(name, every)`` gives that library's members of a class among all
    code points; texts with a character on which both differ take a pattern in which
    the classes are spelled out.
    """

    def __init__(self, pattern: str, members: Callable[[str, str], set[str]]):
        # White space is Unicode's property: Python's \\s would add U+001C to U+001F.
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        theirs = {name: members(name, every) for name in (r"\p{L}", r"\p{N}")}
        self.differ = set().union(*(own ^ set(regex.findall(name, every)) for name, own in theirs.items()))

        def spelled(found: regex.Match) -> str:
            out = found[0]
            for name, own in theirs.items():
                out = out.replace(name, code_point_ranges(own))
            return out if out.startswith("[") else f"[{out}]"

        self.fast = regex.compile(pattern).findall
        self.exact = regex.compile(regex.sub(r"\[[^\]]*\]|\\p\{[LN]\}", spelled, pattern)).findall

    def __call__(self, text: str) -> list[str]:
        return self.fast(text) if text.isascii() or self.differ.isdisjoint(text) else self.exact(text)


_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def chunks(text: str, size: int = 1 << 18) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut where pre-tokens end in any case: before a lone space between letters.

    A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > 2 * size and (found := _CUT.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def _tiktoken_class(name: str, every: str) -> set[str]:
    own = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(bytes(own.encode_ordinary(every)).decode())


class _Kept(dict):
    """Little-endian ids of pre-tokens, worked out when first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= CACHE_PIECE:
            self[piece] = ids
        return ids


class Codec:
    """Encodes whole texts to ids and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.split = Splitter(pattern, _tiktoken_class)
        self.spell = {b: c for b, c in enumerate(byte_letters())}
        self.kept = _Kept(self._encode_piece)

    def _encode_piece(self, piece: str) -> bytes:
        """Little-endian ids of a pre-token; one that is a token is that token."""
        rank = self.ranks.get(raw := piece.encode())
        if rank is not None:
            return struct.pack("<I", rank)
        ids = self.model.encode(raw.decode("latin-1").translate(self.spell))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._encode, chunks(text)))

    def _encode(self, text: str) -> bytes:
        if len(self.kept) > CACHE_ENTRIES:
            self.kept.clear()
        return b"".join(map(self.kept.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        numbers, step = np.frombuffer(ids, "<u4"), 1 << 18
        return b"".join([b"".join(map(self.tokens.__getitem__, numbers[i : i + step].tolist())) for i in range(0, len(numbers), step)])


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """Each row's key and ``ids``, the whole text's ids as little-endian unsigned 32-bit integers (null: none).

    With ``decode`` also ``decoded``, the bytes that the ids stand for, read from the
    ids in the same pass.  ``path`` is read on the executors: a vocabulary file that
    every machine has.  Repeated rows give repeated rows.  A long text is one row's
    work; memory is a few times its size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, 1):
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = {key: batch.column(0), "ids": pa.array(ids, pa.binary())}
            if decode:
                columns["decoded"] = pa.array(map(own.decode, ids), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"{key} long, ids binary" + (", decoded binary" if decode else "")
    return map_batches(df.select(F.col(key).cast("long").alias(key), text), run, schema)


def decode_ids(df: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Each row's key, ``ids`` and ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, 1):
            out = [own.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [key, "ids", "decoded"])

    return map_batches(df.select(F.col(key).cast("long").alias(key), "ids"), run, f"{key} long, ids binary, decoded binary")
