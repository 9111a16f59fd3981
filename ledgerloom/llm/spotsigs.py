"""Document fingerprints by SpotSigs.

A signature is an anchor (a very common word) with the chain of the next ``CHAIN``
content words, that is words that are no anchors. A document's fingerprint is the set
of its signatures' 32-bit hashes, written in hexadecimal in ascending order. Text
without any chain has one signature: the hash of its words, or of the bare text.

Fingerprints are compared by Jaccard similarity. Two sets of different lengths cannot
be more alike than the ratio of their lengths, so a comparison with a floor stops at
that bound, and stops again once too few signatures are left (``alike``).
``near_documents`` links whole corpora: fingerprints are partitioned by set length,
meet on their rarest signatures, and are compared with the floor.

Neighbours in id order: documents are dealt into ranges of ids; the first document of
each range is also sent to the range before it, so each task walks through its range
with every document and its successor, and the texts are shuffled once.

Defined cases: null text is empty; null ids come last, equal ids are ordered by text;
the document after the last is the first, for a single document itself.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import bucket_links, components
from ledgerloom.llm.text import LOWER, Piece, find_words, hash_spans, members, mix, pieces
from ledgerloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHAIN, CHUNK, COARSE, SIMILARITY = 2, 1 << 20, 256, 0.8
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from had has he in is it not of on or that the this to was were which with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "als auch auf das dem den der des die ein eine es für im in ist mit nicht sich sie und von zu "
    "al como con de del el en es la las lo los no para por que se su un una y"
)
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
WORD = members([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def anchor_hashes(anchors: str = ANCHORS) -> np.ndarray:
    words = [np.frombuffer(w.encode(), np.uint8) for w in sorted(set(anchors.split()))]
    ends = np.cumsum([len(w) for w in words])
    return np.sort(hash_spans(np.concatenate(words), ends - [len(w) for w in words], ends))


def piece_signatures(piece: Piece, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 32-bit signature), by row and then ascending, each once."""
    lowered = Piece(piece.first, LOWER[piece.data], piece.offsets)
    words = find_words(lowered, WORD)
    hashes = hash_spans(lowered.data, words.starts, words.ends)
    place = np.minimum(np.searchsorted(anchors, hashes), len(anchors) - 1)
    is_anchor = anchors[place] == hashes
    content = np.flatnonzero(~is_anchor)
    before = np.cumsum(~is_anchor)
    at = np.flatnonzero(is_anchor)
    value = hashes[at] * SPREAD[0]
    complete = np.ones(len(at), bool)
    # Past the last content word of a document a chain just ends; an empty one is none.
    for k in range(CHAIN):
        following = before[at] + k
        inside = following < len(content)
        index = content[np.where(inside, following, 0)] if len(content) else np.zeros(len(at), int)
        same = inside & (words.row[index] == words.row[at]) if len(words.row) else inside
        if k == 0:
            complete = same
        value = np.where(same, mix(value ^ hashes[index]) * SPREAD[1] + np.uint64(k), value) if len(hashes) else value
    row, signature = words.row[at][complete], (mix(value[complete]) >> np.uint64(32)).astype(np.uint32)
    # Texts without a chain: all their words in order, or the bare bytes.
    lacking = np.setdiff1d(np.arange(len(piece)), row)
    if len(lacking):
        whole = [
            int.from_bytes(hashlib.sha256(b" ".join(_words(lowered, i)) or _raw(lowered, i).tobytes()).digest()[:4], "big")
            for i in lacking.tolist()
        ]
        row, signature = np.concatenate([row, lacking]), np.concatenate([signature, np.array(whole, np.uint32)])
    joined = np.unique((row.astype(np.uint64) << np.uint64(32)) | signature)
    return (joined >> np.uint64(32)).astype(np.int64), (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _raw(piece: Piece, i: int) -> np.ndarray:
    return piece.data[piece.offsets[i] : piece.offsets[i + 1]]


def _words(piece: Piece, i: int) -> list[bytes]:
    own = _raw(piece, i)
    return np.where(WORD[own], own, np.uint8(0x20)).tobytes().split()


def signatures(texts: Sequence[str], anchors: np.ndarray) -> list[np.ndarray]:
    """Ascending signature sets of texts."""
    found = []
    for piece in pieces(pa.array(texts, pa.string())):
        row, signature = piece_signatures(piece, anchors)
        found += np.split(signature, np.searchsorted(row, np.arange(1, len(piece))))
    return found


def written(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def alike(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard similarity of ascending sets; 0 as soon as it is sure to be below ``floor``."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) < floor * len(large):
        return 0.0
    total, common, steps = len(small) + len(large), 0, 4 if floor > 0 else 1
    for part in np.array_split(small, steps):
        place = np.minimum(np.searchsorted(large, part), len(large) - 1)
        common += int((large[place] == part).sum())
        left = len(small) - int(np.searchsorted(small, part[-1], "right")) if len(part) else len(small)
        if common + left < floor * (total - common - left):
            return 0.0
    return common / (total - common)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first characters of the next one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _tree(value: Column, bounds: list[int], low: int, high: int) -> Column:
    """Place of the range of ``value``: how many of the descending bounds are at or above it."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value > F.lit(bounds[middle]), _tree(value, bounds, low, middle)).otherwise(_tree(value, bounds, middle + 1, high))


def range_of(docs: DataFrame, ranges: int) -> Column:
    """Number of the id range of a row, ascending as ids descend; null ids in the last."""
    doc_id = F.col("doc_id").cast("long")
    cuts = min(ranges, COARSE)
    marks = docs.agg(
        F.percentile_approx(doc_id, [i / cuts for i in range(1, cuts)] or [0.5], 10_000), F.min(doc_id), F.max(doc_id)
    ).first()
    if marks[1] is None:
        return F.lit(0)
    bounds = sorted({int(x) for x in marks[0]}, reverse=True)
    tops, lows = [int(marks[2]), *bounds], [*bounds, int(marks[1]) - 1]
    coarse = _tree(doc_id, bounds, 0, len(bounds))
    # Further division by arithmetic where more ranges are wanted than bounds are practical.
    finer = -(-ranges // (len(bounds) + 1))
    top, low = (F.element_at(F.array(*map(F.lit, x)), coarse + 1) for x in (tops, lows))
    width = F.greatest(F.ceil((top - low) / finer), F.lit(1))
    fine = F.least(F.floor((top - doc_id) / width), F.lit(finer - 1)) if finer > 1 else F.lit(0)
    return F.when(doc_id.isNull(), F.lit((len(bounds) + 1) * finer)).otherwise(coarse * finer + fine).cast("long")


def with_successors(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (range, tail, doc_id, text), sorted within ranges; a tail row is the successor of the range's last."""
    numbered = docs.select("doc_id", F.ifnull("text", F.lit("")).alias("text"), range_of(docs, ranges).alias("range"))
    firsts = numbered.groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()  # one row per range
    firsts = sorted((int(r["range"]), r["doc_id"]) for r in firsts)
    to = F.lit(None).cast("long")
    spark = docs.sparkSession
    sent = [(firsts[i][1], firsts[i][0], firsts[i - 1][0]) for i in range(len(firsts))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    also = spark.createDataFrame(sent, f"_first {kind}, _from long, _to long")
    marked = numbered.join(
        F.broadcast(also), (F.col("range") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left"
    )
    stays = F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))
    goes = F.struct(F.col("_to").alias("range"), F.lit(True).alias("tail"))
    copies = F.when(F.col("_to").isNull(), F.array(stays)).otherwise(F.array(stays, goes))
    spread = marked.select(F.explode(copies).alias("_c"), "doc_id", "text").select("_c.range", "_c.tail", "doc_id", "text")
    order = ["range", "tail", F.col("doc_id").desc_nulls_last(), "text"]
    return spread.repartition(F.col("range")).sortWithinPartitions(*order)


def compare_neighbours(docs: DataFrame, anchors: str = ANCHORS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row."""
    hashes = anchor_hashes(anchors)
    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(ids: list, texts: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        """Results of all but the last of consecutive documents."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, other = signatures(texts, hashes), signatures(changed, hashes)
        return pa.record_batch(
            [
                pa.array(ids[:-1], id_type),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([written(s) for s in own[:-1]], pa.string()),
                pa.array([written(s) for s in other], pa.string()),
                pa.array([alike(a, b) for a, b in zip(own, other)], pa.float64()),
                pa.array([alike(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, current, ended = 0, None, False
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            columns = (batch.column(c) for c in ("range", "tail", "doc_id", "text"))
            for place, tail, doc_id, text in zip(*columns):
                place = place.as_py()
                if place != current:
                    ids, texts, size, current, ended = [], [], 0, place, False
                if ended:
                    continue  # ids may repeat: only the first tail row follows
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                ended = tail.as_py()
                if ended or size >= CHUNK:
                    if len(texts) > 1:
                        yield work(ids, texts, id_type)
                        ids, texts = ids[-1:], texts[-1:]
                        size = len(texts[0])

    return with_successors(docs, ranges).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def fingerprints(docs: DataFrame, anchors: str = ANCHORS) -> DataFrame:
    """(doc_id, key long, signatures binary): the set of each row of ``docs(doc_id, text)`` and a hash of it."""
    hashes = anchor_hashes(anchors)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in signatures(batch.column("text").to_pylist(), hashes)]
            keys = [int.from_bytes(hashlib.sha256(s).digest()[:8], "big", signed=True) for s in sets]
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "key": pa.array(keys, pa.int64()), "signatures": pa.array(sets, pa.binary())}
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, signatures binary")


def near_documents(docs: DataFrame, similarity: float = SIMILARITY, anchors: str = ANCHORS) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs(doc_id, text)``: documents linked, over any number of
    steps, by fingerprints with Jaccard similarity of at least ``similarity`` share a class.

    Two such sets of n <= m signatures have n >= similarity * m, so they lie in the same or in
    neighbouring length partitions, and they share one of the n - ceil(similarity * n) + 1 rarest
    signatures of either.
    """
    rows = materialize(fingerprints(docs, anchors), "signatures")
    sets = materialize(rows.groupBy("key").agg(F.min("signatures").alias("signatures")), "sets")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(s, np.uint32) for s in batch.column("signatures").to_pylist()]
            sizes = [len(p) for p in parts]
            keys = np.repeat(batch.column("key").to_numpy(), sizes)
            flat = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int64)
            yield pa.record_batch({"key": pa.array(keys), "n": pa.array(np.repeat(sizes, sizes), pa.int64()), "signature": pa.array(flat)})

    spread = sets.mapInArrow(unpack, "key long, n long, signature long")
    rarity = spread.groupBy("signature").agg(F.count(F.lit(1)).alias("found"))
    ordered = spread.join(rarity, "signature").groupBy("key", "n").agg(
        F.sort_array(F.collect_list(F.struct("found", "signature"))).alias("rare")
    )
    prefix = F.slice("rare", 1, (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int"))
    partition = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similarity))
    met = ordered.select("key", F.explode(prefix).alias("_rare"), partition.alias("_part")).select(
        "key", F.explode(F.array("_part", F.col("_part") + 1)).alias("_part"), F.col("_rare.signature").alias("_signature")
    )
    members = met.select("key", F.xxhash64("_part", "_signature").alias("bucket")).distinct().join(sets, "key")

    def close(values: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        own = values["signatures"]
        pairs = ((np.frombuffer(own[i], np.uint32), np.frombuffer(own[j], np.uint32)) for i, j in zip(left, right))
        return np.array([alike(a, b, similarity) >= similarity for a, b in pairs], bool)

    found = components(bucket_links(members, "bucket", "key", ["signatures"], close))
    least = rows.select("doc_id", "key").join(found.select(F.col("node").alias("key"), "root"), "key", "left")
    rooted = least.withColumn("root", F.ifnull("root", "key"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rooted.join(named, "root").select("doc_id", "class_id")
