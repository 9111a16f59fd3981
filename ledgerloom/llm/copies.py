"""Near copies: documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates meet by SimHash first: the fingerprints of all whole texts are linked as in ``simhash``,
by Golay keys and at most two differing bits, and an exact check follows. A pair at the bound differs in about ten of the 64 bits of a SimHash, too many for
pigeonhole keys, so candidates also meet on ``BANDS`` (30) keys of ``ROWS`` (5) minimum hashes
each. A pair at the bound shares no key with probability (1 - 0.8^5)^30, about 7 in a
million; a more similar one far less often. Documents with equal sets of shingles are one
class. Classes that share keys form candidate groups; only these groups' texts are read
again, and in a group every pair that shares a key or has near fingerprints is compared by its
exact similarity.

Defined cases: null and wordless text have no shingles and are alike; a text of fewer than
five words is one shingle. One row of each component stays, the first by (doc_id, hash of
the text), null ids last: different texts under one id are told apart, and copies without
an id are reduced like all others. Of rows that share both, the least by all columns stays.
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
from ledgerloom.llm.simhash import RADIUS, fuzzy_keys, piece_prints, shingle_hashes
from ledgerloom.llm.tables import BROADCAST_ROWS
from ledgerloom.llm.text import Piece, mix, pieces, signed
from ledgerloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SIMILARITY, ROWS, BANDS = 5, 0.8, 5, 30
#: Odd multipliers of the minimum hashes.
FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingles of each document, ascending, one document after another."""
    hashes, counts = shingle_hashes(piece, SHINGLE)
    rows = np.repeat(np.arange(len(piece)), counts)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.bincount(rows[new], minlength=len(piece))


def piece_bands(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, bands): one hash of each set, and its ``BANDS`` keys; an empty set has zeros."""
    keys, bands = np.zeros(len(counts), np.uint64), np.zeros((len(counts), BANDS), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.cumsum(counts[some]) - counts[some]
        keys[some] = mix(np.add.reduceat(mix(hashes), starts) + counts[some].astype(np.uint64))
        for band in range(BANDS):
            value = np.full(len(some), band + 1, np.uint64)
            for factor in FACTORS[band * ROWS : (band + 1) * ROWS]:
                value = mix(value * FACTORS[0] + np.minimum.reduceat(hashes * factor, starts))
            bands[some, band] = value
    return keys, bands


def banded(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, bands, print): a row per row of ``docs(doc_id, text)``; ``mark`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                keys, bands = piece_bands(*shingle_sets(piece))
                part = batch.slice(piece.first, len(piece))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "mark": part.column("mark"),
                        "key": pa.array(signed(keys)),
                        "bands": pa.array([b.tobytes() for b in bands], pa.binary()),
                        "print": pa.array(signed(piece_prints(piece))),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(run, f"doc_id {kind}, mark long, key long, bands binary, print long")


def band_keys(classes: DataFrame) -> DataFrame:
    """(bucket, key): every class with shingles once for each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
            filled = bands.any(axis=1)
            yield pa.record_batch({"bucket": pa.array(bands[filled].reshape(-1)), "key": pa.array(np.repeat(keys[filled], BANDS))})

    return classes.select("key", "bands").mapInArrow(run, "bucket long, key long")


def same_bucket(values: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.ones(len(left), bool)


def similar_sets(values: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs that share a band or have near fingerprints, and have the similarity."""
    sets, bands = values["shingles"], values["bands"]
    good, near = np.zeros(len(left), bool), near_prints(RADIUS)(values, left, right)
    for place, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
        if near[place] or (np.frombuffer(bands[i], np.uint64) == np.frombuffer(bands[j], np.uint64)).any():
            good[place] = jaccard(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[j], np.uint64)) >= SIMILARITY - 1e-12
    return good


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two ascending sets that are not empty; 0 if their sizes rule out ``SIMILARITY``."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < SIMILARITY * len(large) - 1e-9:
        return 0.0
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[place] == small).sum())
    return common / (len(a) + len(b) - common)


def with_sets(texts: DataFrame) -> DataFrame:
    """(bucket, key, bands, print, shingles) for ``texts(bucket, key, bands, print, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                hashes, counts = shingle_sets(piece)
                own = np.split(hashes, np.cumsum(counts)[:-1])
                part = batch.slice(piece.first, len(piece)).select(["bucket", "key", "bands", "print"])
                yield pa.record_batch([*part.columns, pa.array([s.tobytes() for s in own], pa.binary())], names=[*part.schema.names, "shingles"])

    kinds = "bucket long, key long, bands binary, print long, shingles binary"
    return texts.select("bucket", "key", "bands", "print", "text").mapInArrow(run, kinds)


def print_links(rows: DataFrame) -> DataFrame:
    """(a, b): the classes of ``rows(key, print)`` that fingerprints link, each with the least of its component."""
    named = rows.distinct()
    prints = fuzzy_keys(named.select("print").distinct())
    near = components(bucket_links(prints, "key", "print", ["print"], near_prints(RADIUS)))
    met = named.join(near.select(F.col("node").alias("print"), F.col("root").alias("near")), "print", "left")
    met = met.select("key", F.ifnull("near", "print").alias("near")).distinct()
    least = met.groupBy("near").agg(F.min("key").alias("b"), F.max("key").alias("most")).filter("b < most")
    return met.join(least, "near").select(F.col("key").alias("a"), "b")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, root) for every row of ``docs(doc_id, text)``: rows linked over any number of steps share a root."""
    rows = materialize(banded(docs), "banded")
    classes = rows.groupBy("key").agg(
        F.min("bands").alias("bands"),
        F.min("print").alias("print"),
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first"),
    )
    classes = materialize(classes, "classes")
    by_bands = bucket_links(band_keys(classes), "bucket", "key", [], same_bucket)
    met = components(print_links(rows.select("key", "print")).unionByName(by_bands))
    candidates = classes.join(met.select(F.col("node").alias("key"), F.col("root").alias("bucket")), "key")
    candidates = materialize(
        candidates.select("bucket", "key", "bands", "print", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")), "candidates"
    )
    # Texts of candidates only; they are broadcast if they are counted to be few.
    few = candidates.count() <= BROADCAST_ROWS
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).join(F.broadcast(candidates) if few else candidates, same)
    # Rows that repeat an id and a text have one set.
    sets = with_sets(texts).groupBy("bucket", "key").agg(*[F.min(c).alias(c) for c in ("bands", "print", "shingles")])
    linked = components(bucket_links(sets, "bucket", "key", ["bands", "print", "shingles"], similar_sets))
    found = rows.join(linked.withColumnRenamed("node", "key"), "key", "left")
    return found.select("doc_id", "mark", F.ifnull("root", "key").alias("root"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The first row of each component, with all columns of ``docs``."""
    groups = near_copies(docs)
    first = groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    chosen = materialize(first.select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"), "n"), "chosen")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    kept = docs.join(chosen.select("_id", "_mark"), same, "left_semi")
    # Rows of one component that repeat the id and the text of its first row.
    repeated = groups.groupBy("doc_id", "mark").count().filter("count > 1").join(
        chosen.filter("n > 1"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi"
    )
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    least = kept.groupBy("doc_id", F.xxhash64("text").alias("_mark")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return least.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
