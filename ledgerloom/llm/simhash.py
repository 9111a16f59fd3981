"""SimHash near-duplicates: fuzzy keys from the binary Golay code, join and verify.

A document's fingerprint has a bit set where more than half of its word shingles'
XXH64 values have it. Fingerprints that differ in at most ``RADIUS`` (2) bits are
linked, and a component takes the smallest document id in it.

Candidates: the 64 bits fall into three segments of 22, 21 and 21 bits. Two
differing bits leave at least one segment intact (pigeonhole), and the segment
after it differs in at most two bits. That one is padded to the 23 bits of the
perfect Golay code and decoded together with its 23 one-bit neighbours: two values
at distance 2 have a value at distance 1 from both, which lies in one codeword's
sphere, so they share a codeword index. A key is the intact segment with such an
index: about five keys per segment, none of them lossy. Pairs of a bucket are
verified by their differing bits.

Defined cases: null or wordless text has fingerprint 0 and is linked like any other;
rows that repeat an id stay rows of their own; a null id never names a component
unless the whole component has none.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import bucket_links, components, near_prints
from ledgerloom.llm.text import BLANK, LOWER, Piece, find_words, majority_bits, pieces, squeeze, xxh64_spans
from ledgerloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS, SHINGLE, SEED = 2, 3, 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the (23, 12) Golay code.
GENERATOR, CODE_BITS, INDEX_BITS = 0b101011100011, 23, 12


def shingle_hashes(piece: Piece, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the word shingles of a piece's documents, and their number per document."""
    words = find_words(piece, BLANK)
    data, starts, ends = squeeze(Piece(piece.first, LOWER[piece.data], piece.offsets), words)
    counts = np.bincount(words.row, minlength=len(piece))
    # A shingle ends width - 1 words on, or at the last word of a shorter text.
    last = np.cumsum(counts) - 1
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    rows = np.repeat(np.arange(len(piece)), shingles)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    first = (last - counts + 1)[rows] + place
    final = np.minimum(first + width - 1, last[rows])
    return xxh64_spans(data, starts[first], ends[final], SEED), shingles


def piece_prints(piece: Piece, width: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a piece's documents: majority bits of their shingles' XXH64 (seed 42)."""
    return majority_bits(*shingle_hashes(piece, width))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, print long): one row per row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [piece_prints(p, width) for p in pieces(batch.column("text"))]
            values = np.concatenate([np.zeros(0, np.uint64), *prints])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "print": pa.array(values.view(np.int64))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print long")


def _remainders(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    values = values.copy()
    for bit in range(CODE_BITS - 1, CODE_BITS - INDEX_BITS - 1, -1):
        high = (values >> bit) & 1
        values ^= high * (GENERATOR << (bit - (CODE_BITS - INDEX_BITS)))
    return values


def error_patterns() -> np.ndarray:
    """The pattern of at most three errors for each of the 2,048 remainders."""
    single = 1 << np.arange(CODE_BITS)
    patterns = [np.zeros(1, np.int64), single]
    i, j = np.triu_indices(CODE_BITS, 1)
    patterns.append(single[i] | single[j])
    k = np.arange(CODE_BITS)
    triple = (single[i][:, None] | single[j][:, None] | single[None, :])[j[:, None] < k[None, :]]
    every = np.concatenate([*patterns, triple])
    table = np.zeros(1 << (CODE_BITS - INDEX_BITS), np.int64)
    table[_remainders(every)] = every
    return table


def nearby_indices(values: np.ndarray) -> np.ndarray:
    """Codeword indices of 23-bit values and of their one-bit neighbours: (n, 24), sorted by row."""
    around = values[:, None] ^ np.concatenate([[0], 1 << np.arange(CODE_BITS)])[None, :]
    words = around ^ error_patterns()[_remainders(around)]
    return np.sort(words >> (CODE_BITS - INDEX_BITS), axis=1)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) for all keys of uint64 fingerprints; a place never has a key twice."""
    places, keys = [], []
    parts = [((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    for intact in range(len(SEGMENTS)):
        indices = nearby_indices(parts[(intact + 1) % len(SEGMENTS)])
        new = np.ones(indices.shape, bool)
        new[:, 1:] = indices[:, 1:] != indices[:, :-1]
        place, column = np.nonzero(new)
        places.append(place)
        keys.append((((intact << 22) | parts[intact][place]) << INDEX_BITS) | indices[place, column])
    return np.concatenate(places), np.concatenate(keys)


def fuzzy_keys(classes: DataFrame) -> DataFrame:
    """(key, print): the Golay keys of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("print").to_numpy()
            for start in range(0, len(values), 20_000):
                part = values[start : start + 20_000]
                place, key = golay_keys(part.view(np.uint64))
                yield pa.record_batch({"key": pa.array(key), "print": pa.array(part[place])})

    return classes.select("print").mapInArrow(run, "key long, print long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, print, component_id) for every row of ``docs(doc_id, text)``.

    ``radius`` may be 0, 1 or 2: the keys find every pair up to two differing bits.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"keys cover 0 to {RADIUS} differing bits")
    prints = materialize(fingerprints(docs), "prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    links = bucket_links(fuzzy_keys(classes), "key", "print", ["print"], near_prints(radius))
    found = components(links)
    linked = classes.join(found.withColumnRenamed("node", "print"), "print", "left")
    # Unlinked fingerprints are components of their own.
    roots = linked.withColumn("root", F.ifnull("root", "print"))
    least = roots.filter("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def hex_print(column: str):
    """16 lowercase hexadecimal digits of a 64-bit value."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each group.

    Rows that repeat an id are one document; a row without id stays.
    """
    groups = near_duplicates(docs, radius)
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi")
    repeated = docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1")
    if not repeated.isEmpty():
        chosen = chosen.dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.filter("doc_id is null")).select(*docs.columns)
