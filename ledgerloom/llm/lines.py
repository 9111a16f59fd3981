"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity.

A line is normalised to its words (runs of ASCII letters and of anything beyond
ASCII) in lower case, so case, digits, punctuation and spacing make no difference. A
line without words is never a duplicate. Equal normalised lines are one class.

Distinct classes get a 64-bit SimHash over their words. Two fingerprints that differ
in at most ``RADIUS`` (3) of 64 bits agree in at least two of ``BLOCKS`` (5) blocks, so
classes meet on every pair of blocks. Classes linked that way form candidate groups;
only their members' texts are fetched, and within a group lines are linked if their
fingerprints are close and their edit similarity, 1 - distance / longer length, is at
least ``SIMILARITY`` (0.8). Large groups are compared by pairs of blocks again. Of each connected group the first occurrence (by document
id, then line number) in the whole table is kept, all others go.

Defined cases: null text is a document without lines; rows that repeat an id are
documents of their own, the first of them by row order keeps a shared line; null ids
come last.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import BUCKET, bucket_links, components, near_prints
from ledgerloom.llm.tables import BROADCAST_ROWS
from ledgerloom.llm.text import LOWER, Piece, find_words, hash_spans, majority_bits, members, pieces, squeeze
from ledgerloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS, SIMILARITY = 3, 0.8
#: Bits of the five blocks.
BLOCKS = (13, 13, 13, 13, 12)
#: Bits of a part of what is beside two blocks, at most 39 bits.
PART = 10
#: Numbers of buckets of parts begin with this bit; those of pairs are smaller.
FIRST_PARTS = 26 + PART + 2
#: Classes that a candidate group may have to be compared as a whole.
GROUP = 256
#: Classes of bytes whose counts are compared first, and how many pairs at a time.
LETTERS, SLICE = 32, 1 << 14
#: Words are runs of ASCII letters and of anything beyond ASCII.
WORD = members([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def piece_lines(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, starts, ends, number) of all lines of a piece's documents."""
    sizes = np.diff(piece.offsets)
    breaks = np.flatnonzero(piece.data == 0x0A)
    # A document that is not empty has one line more than breaks.
    filled = np.flatnonzero(sizes > 0)
    starts = np.sort(np.concatenate([piece.offsets[:-1][filled], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([piece.offsets[1:][filled], breaks]), kind="stable")
    lines = np.zeros(len(sizes), np.int64)
    lines[filled] = 1
    np.add.at(lines, np.searchsorted(piece.offsets, breaks, "right") - 1, 1)
    row = np.repeat(np.arange(len(sizes)), lines)
    number = np.arange(len(row)) - np.repeat(np.cumsum(lines) - lines, lines)
    return row, starts, ends, number


def normal_lines(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(row, number, key, print, normal text) of the lines with words."""
    row, starts, ends, number = piece_lines(piece)
    lowered = LOWER[piece.data]
    # Line breaks are no word bytes, so lines can be cut like documents.
    edges = np.append(starts, len(lowered))
    words = find_words(Piece(0, lowered, edges), WORD) if len(starts) else None
    if words is None or not len(words.starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), []
    data, first, last = squeeze(Piece(0, lowered, edges), words)
    counts = np.bincount(words.row, minlength=len(starts))
    has = np.flatnonzero(counts)
    final = np.cumsum(counts)[has] - 1
    begin = final - counts[has] + 1
    hashes = hash_spans(data, first, last)
    prints = majority_bits(hashes, counts)[has]
    keys = hash_spans(data, first[begin], last[final])
    texts = [data[i:j].tobytes() for i, j in zip(first[begin].tolist(), last[final].tolist())]
    return row[has], number[has], keys, prints, texts


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, row, mark, n_lines, line, key, print, normal): one row per line with words, and one per document without.

    ``mark`` is a hash of the text; ``normal`` is given at a class's first occurrence in
    each batch, null after that.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for piece in pieces(batch.column("text")):
                lines = np.bincount(piece_lines(piece)[0], minlength=len(piece))
                row, number, keys, prints, texts = normal_lines(piece)
                new = []
                for key, text in zip(keys.tolist(), texts):
                    new.append(None if key in seen else text)
                    seen.add(key)
                lacking = np.setdiff1d(np.arange(len(piece)), row)
                of = np.concatenate([row, lacking])
                absent = [None] * len(lacking)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(piece.first + of)),
                        "row": batch.column("row").take(pa.array(piece.first + of)),
                        "mark": batch.column("mark").take(pa.array(piece.first + of)),
                        "n_lines": pa.array(lines[of]),
                        "line": pa.array(number.tolist() + absent, pa.int64()),
                        "key": pa.array(keys.view(np.int64).tolist() + absent, pa.int64()),
                        "print": pa.array(prints.view(np.int64).tolist() + absent, pa.int64()),
                        "normal": pa.array(new + absent, pa.binary()),
                    }
                )

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", F.xxhash64("text").alias("mark"))
    return numbered.mapInArrow(
        run, f"doc_id {kind}, row long, mark long, n_lines long, line long, key long, print long, normal binary"
    )


def _dealt(members: DataFrame, buckets: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """``members`` once for each array of ``buckets`` of a batch, which becomes its column ``bucket``."""
    names = [c for c in members.columns if c != "bucket"]
    kinds = [f"`{c}` {members.schema[c].dataType.simpleString()}" for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in buckets(batch):
                yield pa.record_batch({"bucket": pa.array(bucket.view(np.int64)), **{c: batch.column(c) for c in names}})

    return members.mapInArrow(run, ", ".join(["bucket long", *kinds]))


def block_pairs(members: DataFrame) -> DataFrame:
    """``bucket`` and the columns of ``members``: every row once for each pair of the blocks of its ``print``."""

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        values = batch.column("print").to_numpy().view(np.uint64)
        shift, parts = 0, []
        for bits in BLOCKS:
            parts.append((values >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
            shift += bits
        for i in range(len(BLOCKS)):
            for j in range(i + 1, len(BLOCKS)):
                yield np.uint64((i * len(BLOCKS) + j) << 26) | (parts[i] << np.uint64(13)) | parts[j]

    return _dealt(members, buckets)


def beside_blocks(kind: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The bits of ``values`` beside their pair of blocks, ``kind``."""
    places, rest = np.cumsum([0, *BLOCKS[:-1]]), np.zeros(len(values), np.uint64)
    for i in range(len(BLOCKS)):
        for j in range(i + 1, len(BLOCKS)):
            mine, shift = np.flatnonzero(kind == i * len(BLOCKS) + j), 0
            for block in sorted(set(range(len(BLOCKS))) - {i, j}):
                bits = (values[mine] >> np.uint64(places[block])) & np.uint64((1 << BLOCKS[block]) - 1)
                rest[mine] |= bits << np.uint64(shift)
                shift += BLOCKS[block]
    return rest


def block_parts(members: DataFrame) -> DataFrame:
    """Rows of ``block_pairs`` dealt into smaller buckets: every row once for each part of its other blocks.

    The bits beside a pair of blocks are cut into ``RADIUS`` + 1 parts, so of two fingerprints that meet in a
    pair and differ in at most ``RADIUS`` bits some part is equal.
    """

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        values = batch.column("print").to_numpy().view(np.uint64)
        pair = batch.column("bucket").to_numpy().view(np.uint64)
        rest = beside_blocks((pair >> np.uint64(26)).astype(np.int64), values)
        for part in range(RADIUS + 1):
            value = (rest >> np.uint64(part * PART)) & np.uint64((1 << PART) - 1)
            yield (pair << np.uint64(PART + 2)) | np.uint64(part << PART) | value

    return _dealt(members, buckets)


def similar_lines(a: bytes, b: bytes, floor: float = SIMILARITY) -> bool:
    """Is 1 - edit distance / longer length, over bytes, at least ``floor``?"""
    longer = max(len(a), len(b))
    most = int((1.0 - floor) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    low = _agreement(a, b, "little")
    a, b = a[low:], b[low:]
    high = _agreement(a, b, "big")
    a, b = a[: len(a) - high], b[: len(b) - high]
    if max(len(a), len(b)) <= most:
        return True
    # Alike lines differ in a few words, which is seen without working out the distance.
    return _by_words(a, b, most) <= most or _distance(a, b, most) <= most


def _agreement(a: bytes, b: bytes, order: Literal["little", "big"]) -> int:
    """How many bytes are equal from the start (``little``) or from the end (``big``) on."""
    n = min(len(a), len(b))
    heads = (a[:n], b[:n]) if order == "little" else (a[len(a) - n :], b[len(b) - n :])
    apart = int.from_bytes(heads[0], order) ^ int.from_bytes(heads[1], order)
    # The lowest bit that differs is in the first byte that does.
    return ((apart & -apart).bit_length() - 1) // 8 if apart else n


# Where words part, how many of either text are replaced before they meet again: the fewest first.
MEETINGS = sorted(((s, t) for s in range(4) for t in range(4) if s or t), key=lambda m: (max(m), sum(m)))


def _by_words(a: bytes, b: bytes, most: float) -> int:
    """At least the edit distance, of one alignment of words; any number above ``most`` if it is above."""
    # With a space behind each word, the costs of stretches of words add up.
    x, y = a.split(b" "), b.split(b" ")
    i, j, cost = 0, 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        skipped = 1, 1
        for s, t in MEETINGS:
            if i + s < len(x) and j + t < len(y) and x[i + s] == y[j + t]:
                skipped = s, t
                break
        s, t = skipped
        cost += max(sum(map(len, x[i : i + s])) + s, sum(map(len, y[j : j + t])) + t)
        if cost > most:
            return cost
        i, j = i + s, j + t
    return cost + max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j)


def _distance(a: bytes, b: bytes, most: float = float("inf")) -> int:
    """Edit distance, or any number above ``most`` if it is above, by bit-parallel columns: integer bit i stands for place i of ``a``."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[int, int] = {}
    for i, byte in enumerate(a):
        places[byte] = places.get(byte, 0) | 1 << i
    full, last, left = (1 << len(a)) - 1, 1 << (len(a) - 1), len(b)
    # Where a column rises by one, and where it falls by one.
    rise, fall, distance = full, 0, len(a)
    for byte in b:
        match = places.get(byte, 0)
        diagonal = (((match & rise) + rise) ^ rise) | match | fall
        up = fall | ~(diagonal | rise) & full
        down = rise & diagonal
        distance += bool(up & last) - bool(down & last)
        left -= 1
        # Each column that is left lowers it by one at most.
        if distance - left > most:
            break
        up = (up << 1 | 1) & full
        rise = (down << 1 | ~(diagonal | up)) & full
        fall = up & diagonal
    return distance


def letter_counts(texts: np.ndarray) -> np.ndarray:
    """How often each text has each of ``LETTERS`` classes of bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer(b"".join(texts), np.uint8) % LETTERS
    cells = np.repeat(np.arange(len(texts)) * LETTERS, sizes) + letters
    return np.bincount(cells, minlength=len(texts) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


def may_be_similar(counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """False for pairs of texts that cannot be similar: letters of one that the other lacks cost an edit each."""
    good = np.zeros(len(left), bool)
    for start in range(0, len(left), SLICE):
        a, b = counts[left[start : start + SLICE]], counts[right[start : start + SLICE]]
        apart = np.maximum(np.maximum(a - b, 0).sum(axis=1), np.maximum(b - a, 0).sum(axis=1))
        longer = np.maximum(a.sum(axis=1), b.sum(axis=1))
        good[start : start + SLICE] = apart <= ((1.0 - SIMILARITY) * longer + 1e-9).astype(np.int64)
    return good


def first_meeting(bucket: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether pairs of fingerprints that differ in the bits ``apart`` meet in this bucket of ``block_pairs`` or
    ``block_parts`` first, of all buckets they share: pairs of blocks are in order, and so are parts."""
    parts = bucket >= 1 << FIRST_PARTS
    kind = np.where(parts, bucket >> (PART + 2), bucket) >> 26
    seen, first, second, shift = np.zeros(len(apart), np.int64), np.zeros(len(apart), np.int64), np.zeros(len(apart), np.int64), 0
    for block, bits in enumerate(BLOCKS):
        same = (apart >> np.uint64(shift)) & np.uint64((1 << bits) - 1) == 0
        seen += same
        first[same & (seen == 1)] = block
        second[same & (seen == 2)] = block
        shift += bits
    good = kind == first * len(BLOCKS) + second
    rest = beside_blocks(kind, apart)
    part = (bucket >> PART) & 3
    for earlier in range(RADIUS):
        equal = (rest >> np.uint64(earlier * PART)) & np.uint64((1 << PART) - 1) == 0
        good &= ~parts | (part <= earlier) | ~equal
    return good


def close_lines(values: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Close fingerprints and similar texts."""
    good, texts = near_prints(RADIUS)(values, left, right), values["normal"]
    near = np.flatnonzero(good)
    if len(near):
        # Counted once for all pairs of these rows.
        if "letters" not in values:
            values["letters"] = letter_counts(texts)
        good[near] = may_be_similar(values["letters"], left[near], right[near])
    for place in np.flatnonzero(good).tolist():
        good[place] = similar_lines(texts[left[place]], texts[right[place]])
    return good


def close_lines_once(values: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``close_lines`` in buckets of ``block_pairs``, each pair only where it meets first."""
    prints = values["print"].view(np.uint64)
    apart = prints[left] ^ prints[right]
    good = np.bitwise_count(apart) <= RADIUS
    near = np.flatnonzero(good)
    good[near] = first_meeting(values[BUCKET][left[near]], apart[near])
    near = np.flatnonzero(good)
    good[near] = close_lines(values, left[near], right[near])
    return good


def line_groups(table: DataFrame) -> DataFrame:
    """(key, root) for every class that is linked to another; ``table`` is a stored line table.

    Chains of close fingerprints grow into groups much faster than the table does. So a group of more than ``GROUP``
    classes is not compared as a whole: its members meet again on the pairs of blocks, with their texts.
    """
    classes = table.filter("key is not null").groupBy("key").agg(F.min("print").alias("print"))
    classes = materialize(classes, "classes")
    prints = block_pairs(classes.select("print").distinct())
    close = components(bucket_links(prints, "bucket", "print", ["print"], near_prints(RADIUS), block_parts))
    grouped = classes.join(close.withColumnRenamed("node", "print"), "print", "left")
    grouped = grouped.select("key", F.ifnull("root", "print").alias("bucket"))
    several = grouped.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    candidates = materialize(grouped.join(several.select("bucket", (F.col("n") > GROUP).alias("large")), "bucket"), "candidates")
    # Texts of candidate classes only; their keys are broadcast if they are counted to be few.
    few = candidates.count() <= BROADCAST_ROWS
    wanted = table.filter("normal is not null").select("key", "print", "normal").join(
        F.broadcast(candidates) if few else candidates, "key"
    )
    texts = wanted.groupBy("bucket", "large", "key").agg(F.min("print").alias("print"), F.min("normal").alias("normal"))
    texts = materialize(texts, "candidate_texts", "zstd")
    held = ["print", "normal"]
    small = bucket_links(texts.filter("not large").drop("large"), "bucket", "key", held, close_lines)
    dealt = block_pairs(texts.filter("large").select("key", *held))
    links = small.unionByName(bucket_links(dealt, "bucket", "key", held, close_lines_once, block_parts))
    return components(links).select(F.col("node").alias("key"), "root")


def kept_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored line table, kept (row, line)): one occurrence per group of lines."""
    table = materialize(line_table(docs), "lines")
    groups = line_groups(table)
    firsts = table.filter("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line")).alias("first")
    )
    grouped = firsts.join(groups, "key", "left").withColumn("root", F.ifnull("root", "key"))
    kept = grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.row", "first.line")
    return table, kept


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, mark, n_lines, dropped) for every row of ``docs(doc_id, text)``."""
    table, kept = kept_lines(docs)
    per_document = table.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "mark", "n_lines")], F.collect_list("line").alias("worded")
    )
    held = kept.groupBy("row").agg(F.collect_list("line").alias("kept"))
    joined = per_document.join(held, "row", "left")
    nothing = F.array().cast("array<bigint>")
    dropped = F.sort_array(F.array_except("worded", F.ifnull("kept", nothing)))
    return joined.select("doc_id", "row", "mark", "n_lines", dropped.alias("dropped"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, dropped) for every row of ``docs(doc_id, text)``; ``dropped`` holds line numbers from 0."""
    n_kept = F.col("n_lines") - F.size("dropped")
    return dropped_lines(docs).select("doc_id", "n_lines", n_kept.alias("n_kept"), "dropped")


def deduped_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines; other columns as they are.

    Rows are matched by id and text; of rows that repeat both, each takes the first one's lines.
    """
    found = dropped_lines(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    first = found.agg(F.min_by("dropped", "row").alias("_dropped"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    joined = docs.join(first, same, "left")
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("_dropped"), i.cast("long")))
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.concat_ws("\n", left))
    return joined.withColumn("text", text).select(*docs.columns)
