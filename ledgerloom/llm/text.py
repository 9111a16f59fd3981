"""Arrow columns of text as byte arrays: words, hashes and bit counts without a
Python loop over words.

A batch is worked through in pieces of whole documents with a bounded number of
bytes, so the arrays stay small whatever Spark puts into a batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 20
#: Odd multiplier of the polynomial hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass
class Piece:
    """Whole documents: row ``first + i`` holds bytes ``offsets[i]:offsets[i + 1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    #: The document of each word, as a place in the piece.
    row: np.ndarray


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return content[places[0] : places[-1]], places - places[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    data, offsets = column_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        start = offsets[first]
        yield Piece(first, data[start : offsets[last]], offsets[first : last + 1] - start)
        first = last


def find_words(piece: Piece, member: np.ndarray) -> Words:
    """Maximal runs of member bytes; no run crosses two documents."""
    inside = np.zeros(len(piece.data) + 1, bool)
    inside[:-1] = member[piece.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = piece.offsets[:-1]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    # A run ends where the next begins or at the first byte outside.
    stop = np.zeros(len(inside) + 1, bool)
    stop[1:-1] = inside[:-1] & (~inside[1:] | begins[1:])
    ends = np.flatnonzero(stop)
    return Words(starts, ends, np.searchsorted(piece.offsets, starts, "right") - 1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``data[start:end]`` for all spans, by prefix sums of a polynomial."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)), out=sums[1:])
    shift = _powers(INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


def hash_text(text: str) -> int:
    """``hash_spans`` of one whole text."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])


#: The five primes of XXH64.
PRIMES = tuple(
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of ``data[start:end]`` for all spans; spans of one length are hashed together."""
    one, two, three, four, five = PRIMES
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    # Eight and four bytes from any place on.
    eight = np.lib.stride_tricks.as_strided(padded.view(), (len(data) + 1, 8), (1, 1)).view(np.uint64)[:, 0]
    lengths = ends - starts
    narrow = lengths.astype(np.uint16) if len(lengths) and lengths.max() < 1 << 16 else lengths
    order = np.argsort(narrow, kind="stable")
    sizes, firsts = np.unique(lengths[order], return_index=True)
    out = np.empty(len(starts), np.uint64)
    start = np.uint64(seed)

    def turn(value: np.ndarray, lane: np.ndarray) -> np.ndarray:
        return _rotl(value + lane * two, 31) * one

    with np.errstate(over="ignore"):
        for size, rows in zip(sizes.tolist(), np.split(order, firsts[1:])):
            at, done = starts[rows], 0
            if size >= 32:
                sums = [np.full(len(rows), x, np.uint64) for x in (start + one + two, start + two, start, start - one)]
                while done + 32 <= size:
                    sums = [turn(v, eight[at + done + 8 * k]) for k, v in enumerate(sums)]
                    done += 32
                h = _rotl(sums[0], 1) + _rotl(sums[1], 7) + _rotl(sums[2], 12) + _rotl(sums[3], 18)
                for v in sums:
                    h = (h ^ turn(np.zeros_like(v), v)) * one + four
            else:
                h = np.full(len(rows), start + five, np.uint64)
            h += np.uint64(size)
            while done + 8 <= size:
                h = _rotl(h ^ turn(np.zeros_like(h), eight[at + done]), 27) * one + four
                done += 8
            if done + 4 <= size:
                h = _rotl(h ^ ((eight[at + done] & np.uint64(0xFFFFFFFF)) * one), 23) * two + three
                done += 4
            while done < size:
                h = _rotl(h ^ (padded[at + done].astype(np.uint64) * five), 11) * one
                done += 1
            h = (h ^ (h >> np.uint64(33))) * two
            h = (h ^ (h >> np.uint64(29))) * three
            out[rows] = h ^ (h >> np.uint64(32))
    return out


LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit value per document: the bits set in more than half of its hashes.

    ``hashes`` holds ``counts[i]`` values of document i one after another; a document
    without any gets 0.
    """
    result = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return result
    sizes = counts[some]
    begins = np.cumsum(sizes) - sizes
    # Blocks of at most 255 rows: one-byte counters cannot overflow.
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(begins, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    for k in range(8):
        counters = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts)
        totals = np.add.reduceat(counters.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        for byte in range(8):
            result[some] |= (2 * totals[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + k)
    return result


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def squeeze(piece: Piece, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank after each: bytes, starts and ends."""
    keep = np.zeros(len(piece.data) + 1, np.int8)
    keep[words.starts] += 1
    keep[words.ends] -= 1
    inside = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
    lengths = words.ends - words.starts
    starts = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    gaps = np.ones(len(out), bool)
    gaps[starts + lengths] = False
    out[gaps] = piece.data[inside]
    return out, starts, starts + lengths


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()


def members(outside: list[tuple[int, int]]) -> np.ndarray:
    """Byte table that is true except in the given inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in outside:
        table[low : high + 1] = False
    return table


#: Words split at ASCII white space.
BLANK = members([(0x20, 0x20), (0x09, 0x0D)])
