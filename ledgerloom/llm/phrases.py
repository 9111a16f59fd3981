r"""Phrase collocations: frequent runs of words that score high at their weakest cut.

Texts are lowered (A-Z) and split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into words
``[^\x20\x09]+``. Everything is counted per language (null: ``und``). A phrase has 2 to
``LONGEST`` words inside a piece and occurs ``LEAST`` times or more.

1. *Mergeable Misra-Gries summaries per hash partition.* Tasks count the grams of a bounded
   number of occurrences at a time; each hash partition (slot) of such a chunk is one summary.
   A slot's summaries meet in one task, which knows their mass, and are merged with a capacity
   above mass / LEAST: after a merge the count of the first gram beyond the capacity is taken
   from all. That takes less than LEAST from any gram, so every frequent one survives; those
   whose count with what was taken stays below LEAST are left out. The capacity is ``SPARE``
   times what the guarantee needs, so little is taken and few infrequent grams survive.
   Words and pairs go first, then longer grams all of whose pairs survived.
2. *Exact counts.* A second pass over all texts counts the grams whose bits are set in a map of
   ``MAP_BITS`` bits of the survivors, by their text, again first in the tasks and then per hash
   partition; only frequent ones leave it. The map has a fixed size whatever the
   corpus: when it fills up, more grams are counted in vain and dropped by their exact count.
3. *Scores.* Every cut of a phrase joins the counts of its two parts (frequent as well, being
   parts). Products are decimals of 38 digits.

Summaries hold the upper 48 bits of a gram's hash: grams that share them count together, so
an estimate can only be too high. In a piece of about 1 MB equal grams are found by 64 bits.
A slot is as large as its share of all chunks, and there are ``SLOTS`` for each shuffle
partition of the session, so memory stays bounded where that setting follows the data. Bits
of the map are combined by Spark before the driver reads its words (at most ``MAP_BITS`` / 64).

Defined cases: null text is empty; a null language and ``und`` are one; rows that repeat an id
count each; a text of any length is counted whole (its pieces of words pass through in one
task); ties in the score go to the more frequent, then the lesser phrase in UTF-8 order; an
empty table has no phrases; columns other than lang and text are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.text import LOWER, Piece, find_words, hash_spans, hash_text, members, mix, pieces, squeeze
from ledgerloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, LONGEST, SHARE, TOP = 100, 5, 100, 2000
#: Hash partitions for each shuffle partition; occurrences that a task counts together.
SLOTS, CHUNK = 4, 1_000_000
#: Capacity of a summary as a multiple of mass / LEAST.
SPARE = 8
#: Bits of the map of survivors (8 MB); a power of two.
MAP_BITS = 1 << 26
#: Phrases that a task of the second pass holds before it hands them on.
HELD = 300_000
KEY_BYTES = 6

SEPARATES = ~members([(0x0A, 0x0D)])
SEPARATES[np.frombuffer(b".,;:!?", np.uint8)] = True
WORD = ~SEPARATES
WORD[[0x09, 0x20]] = False


class Grams:
    """The words of a piece, and the hashes of all runs of words of each length."""

    def __init__(self, piece: Piece, languages: np.ndarray):
        """``languages``: a hash for every document of the piece."""
        piece = Piece(piece.first, LOWER[piece.data], piece.offsets)
        words = find_words(piece, WORD)
        cuts = np.cumsum(SEPARATES[piece.data], dtype=np.int32)
        self.row = words.row
        # Words of one run: no separator and no end of document between them.
        before = cuts[words.starts] if len(words.starts) else np.zeros(0, np.int32)
        self.breaks = np.cumsum(np.diff(before, prepend=0).astype(bool) | np.diff(words.row, prepend=-1).astype(bool))
        self.data, self.starts, self.ends = squeeze(piece, words)
        self.words = hash_spans(self.data, self.starts, self.ends)
        self.language = languages[words.row]

    def hashes(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, hashes) of the grams of 1, 2, ... words."""
        count = len(self.words)
        gram = mix(self.words ^ self.language)
        yield np.arange(count), gram
        for k in range(2, longest + 1):
            gram = gram[: max(count - k + 1, 0)]
            gram = mix(gram * np.uint64(3) + self.words[k - 1 :][: len(gram)])
            places = np.flatnonzero(self.breaks[: len(gram)] == self.breaks[k - 1 :][: len(gram)])
            yield places, gram[places]

    def phrase(self, place: int, k: int) -> bytes:
        return self.data[self.starts[place] : self.ends[place + k - 1]].tobytes()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Grams, list[str]]]:
    known: dict[str, int] = {}
    for batch in batches:
        names = batch.column("lang").to_pylist()
        hashes = np.array([known[n] if n in known else known.setdefault(n, hash_text(n)) for n in names], np.uint64)
        for piece in pieces(batch.column("text")):
            rows = slice(piece.first, piece.first + len(piece))
            yield Grams(piece, hashes[rows]), names[rows]


def spots(keys: np.ndarray) -> np.ndarray:
    """The bit of each gram's upper hash bits in the map."""
    return (mix(keys >> np.uint64(64 - 8 * KEY_BYTES)) & np.uint64(MAP_BITS - 1)).astype(np.int64)


def seen(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which grams may be among the survivors."""
    spot = spots(grams)
    return (bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) > 0


def wanted_grams(grams: Grams, longest: int, bits: np.ndarray | None) -> Iterator[np.ndarray]:
    """Hashes of the words and pairs; with a map, of the longer grams all of whose pairs are in it."""
    if bits is None:
        yield from (h for _, h in grams.hashes(min(2, longest)))
        return
    good = np.zeros(len(grams.words), bool)
    run = good
    for k, (places, hashes) in enumerate(grams.hashes(longest), 1):
        if k == 2:
            good[places] = seen(bits, hashes)
            run = good.copy()
        elif k > 2:
            # Places from which on k - 1 pairs are in the map.
            inside = max(len(run) - k + 2, 0)
            run[:inside] &= good[k - 2 :][:inside]
            run[inside:] = False
            yield hashes[run[places]]


def chunk_summaries(docs: DataFrame, slots: int, longest: int, bits: Broadcast | None) -> DataFrame:
    """(slot, keys, counts): exact counts of one chunk of occurrences, ascending by key, per hash partition."""

    def cut(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(parts) >> np.uint64(64 - 8 * KEY_BYTES), return_counts=True)
        slot = ((keys >> np.uint64(8 * KEY_BYTES - 32)) * np.uint64(slots)) >> np.uint64(32)
        edges = np.searchsorted(slot, np.arange(slots + 1).astype(np.uint64))
        packed = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
        held = np.minimum(counts, (1 << 32) - 1).astype(np.uint32)
        filled = np.flatnonzero(np.diff(edges))
        return pa.record_batch(
            {
                "slot": pa.array(filled, pa.int32()),
                "keys": pa.array([packed[edges[s] : edges[s + 1]].tobytes() for s in filled], pa.binary()),
                "counts": pa.array([held[edges[s] : edges[s + 1]].tobytes() for s in filled], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for grams, _ in _pieces(batches):
            for hashes in wanted_grams(grams, longest, bits.value if bits else None):
                waiting.append(hashes)
                held += len(hashes)
            if held >= CHUNK:
                yield cut(waiting)
                waiting, held = [], 0
        if held:
            yield cut(waiting)

    return docs.mapInArrow(run, "slot int, keys binary, counts binary")


class Summary:
    """A Misra-Gries summary: ascending keys, their counts, and what has been taken from any of them."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add an exact summary; what one gram beyond the capacity has is taken from all."""
        both, where = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, where[: len(self.keys)], self.counts)
        np.add.at(total, where[len(self.keys) :], counts)
        if len(both) > self.capacity:
            least = int(np.partition(total, len(total) - self.capacity - 1)[len(total) - self.capacity - 1])
            self.taken += least
            total -= least
            both, total = both[total > 0], total[total > 0]
        self.keys, self.counts = both, total

    def frequent(self, least: int) -> np.ndarray:
        return self.keys[self.counts + self.taken >= least]


def survivors(summaries: DataFrame, least: int) -> DataFrame:
    """(key): every gram that can occur ``least`` times, from all summaries of its slot."""

    def unpack(keys: bytes) -> np.ndarray:
        wide = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
        return wide.view(np.uint64)[:, 0]

    def merged(parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        mass = sum(int(np.frombuffer(c, np.uint32).sum(dtype=np.int64)) for _, c in parts)
        summary = Summary(SPARE * (mass // least) + 1)
        waiting, held = [], 0
        for i, (keys, counts) in enumerate(parts):
            waiting.append((unpack(keys), np.frombuffer(counts, np.uint32).astype(np.int64)))
            held += len(waiting[-1][0])
            # Several small summaries at once cost one sort.
            if held > 2 * summary.capacity or i == len(parts) - 1:
                summary.merge(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
                waiting, held = [], 0
        return pa.record_batch({"key": pa.array(summary.frequent(least).view(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts = None, []
        for batch in batches:
            for s, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("slot", "keys", "counts"))):
                if s != slot and parts:
                    yield merged(parts)
                    parts = []
                slot = s
                parts.append((keys, counts))
        if parts:
            yield merged(parts)

    return summaries.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "key long")


def bit_map(keys: DataFrame) -> np.ndarray:
    """The map of survivors; its words are combined by Spark, at most MAP_BITS / 64 of them are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = spots(batch.column("key").to_numpy().view(np.uint64) << np.uint64(64 - 8 * KEY_BYTES))
            bit = (np.uint64(1) << (spot & 63).astype(np.uint64)).view(np.int64)
            yield pa.record_batch({"word": pa.array(spot >> 6), "bits": pa.array(bit)})

    words = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def exact_counts(docs: DataFrame, slots: int, least: int, longest: int, bits: Broadcast) -> DataFrame:
    """(lang, k, phrase, n): counts by text of the grams in the map that occur ``least`` times; k = 0
    counts all words of a language.

    What a task has counted goes to the hash partitions in one row per language and slot: its
    phrases, parted by line feeds, which no word holds, and their counts.
    """

    def packed(counts: dict[tuple[str, int], dict[bytes, int]]) -> pa.RecordBatch:
        return pa.record_batch(
            {
                "slot": pa.array([slot for _, slot in counts], pa.int32()),
                "lang": pa.array([lang for lang, _ in counts], pa.string()),
                "phrases": pa.array([b"\n".join(c) for c in counts.values()], pa.binary()),
                "counts": pa.array([np.fromiter(c.values(), np.int64, len(c)).tobytes() for c in counts.values()], pa.binary()),
            }
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        counts: dict[tuple[str, int], dict[bytes, int]] = {}
        held = 0
        for grams, names in _pieces(batches):
            per_row = np.bincount(grams.row, minlength=len(names)).tolist()
            for name, n in zip(names, per_row):
                # The empty phrase stands for the language itself.
                whole = counts.setdefault((name, hash_text(name) % slots), {})
                whole[b""] = whole.get(b"", 0) + n
            for k, (places, hashes) in enumerate(grams.hashes(longest), 1):
                good = seen(table, hashes)
                known, first, number = np.unique(hashes[good], return_index=True, return_counts=True)
                places = places[good][first]
                slot = ((known >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
                for place, row, s, n in zip(places.tolist(), grams.row[places].tolist(), slot.tolist(), number.tolist()):
                    of_slot = counts.setdefault((names[row], s), {})
                    phrase = grams.phrase(place, k)
                    if phrase not in of_slot:
                        held += 1
                    of_slot[phrase] = of_slot.get(phrase, 0) + n
            if held > HELD:
                yield packed(counts)
                counts, held = {}, 0
        yield packed(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(lang: str, counts: dict[bytes, int]) -> pa.RecordBatch:
            kept = {p.decode(): n for p, n in counts.items() if n >= least or not p}
            return pa.record_batch(
                {
                    "lang": pa.array([lang] * len(kept), pa.string()),
                    "k": pa.array([p.count(" ") + 1 if p else 0 for p in kept], pa.int32()),
                    "phrase": pa.array(list(kept), pa.string()),
                    "n": pa.array(list(kept.values()), pa.int64()),
                }
            )

        at, counts = None, {}
        for batch in batches:
            for slot, lang, phrases, numbers in zip(*(batch.column(c).to_pylist() for c in ("slot", "lang", "phrases", "counts"))):
                if (slot, lang) != at and at:
                    yield frequent(at[1], counts)
                    counts = {}
                at = (slot, lang)
                for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(numbers, np.int64).tolist()):
                    counts[phrase] = counts.get(phrase, 0) + n
        if at:
            yield frequent(at[1], counts)

    partial = docs.mapInArrow(count, "slot int, lang string, phrases binary, counts binary")
    dealt = partial.repartition("slot").sortWithinPartitions("slot", "lang")
    return dealt.mapInArrow(add, "lang string, k int, phrase string, n long")


def frequent_grams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, k, phrase, n): exact counts of all runs of 1 to ``longest`` words that occur ``least``
    times, and with k = 0 of all words of each language. Stored in the shared folder."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.ifnull(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.ifnull("text", F.lit("")).alias("text"))
    slots = SLOTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    short = bit_map(survivors(chunk_summaries(texts, slots, longest, None), least))
    bits = short
    if longest > 2:
        shared = spark.sparkContext.broadcast(short)
        bits = short | bit_map(survivors(chunk_summaries(texts, slots, longest, shared), least))
    return materialize(exact_counts(texts, slots, least, longest, spark.sparkContext.broadcast(bits)), "grams")


def _words(first: int | F.Column, count: int | F.Column) -> F.Column:
    return F.array_join(F.slice("words", first, count), " ")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, n, score) of every phrase at its lowest-scoring cut."""
    # Stored on its own, so that its measured size decides how it is joined.
    whole = materialize(grams.filter("k = 0").select("lang", F.col("n").alias("_all")), "totals")
    phrases = grams.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"_first": _words(F.lit(1), F.col("cut")), "_rest": _words(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    for part, name in (("_first", "l"), ("_rest", "r")):
        cuts = cuts.join(grams.filter("k > 0").select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    # Whole numbers to the end: 1000 a n may pass 64 bits, the quotient is at most 1000 n.
    exact = F.expr("(1000 * cast(a as decimal(19,0)) * cast(_all as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cuts = cuts.join(whole, "lang").withColumn("score", exact)
    lowest = cuts.groupBy("lang", "k", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r", F.col("_all").alias("n"))).alias("at")
    )
    return lowest.select("lang", "k", "phrase", "a", "at.l", "at.r", "at.n", "at.score")


def independent(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """The phrases of which no longer one, however it fares itself, has ``share`` percent of the occurrences."""
    longer = phrases.filter("k > 2").select("lang", "k", "a", F.split("phrase", " ").alias("words"))
    lengths = longer.withColumn("_size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    places = lengths.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("_size") + 1)))
    inside = places.groupBy("lang", _words(F.col("_from"), F.col("_size")).alias("phrase")).agg(F.max("a").alias("_longer"))
    kept = F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a"))
    return phrases.join(inside, ["lang", "phrase"], "left").filter(kept).drop("_longer")


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """``phrases`` with ``rank``, the first ``top`` of each language; a language is ranked in parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = phrases.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    within = Window.partitionBy("lang", "_part").orderBy(*order)
    parts = parts.withColumn("_place", F.row_number().over(within)).filter(F.col("_place") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).drop("_part", "_place")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of ``docs(lang, text)``."""
    phrases = independent(scored(frequent_grams(docs, least, longest)), share)
    return best(phrases, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
