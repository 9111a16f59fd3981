"""Toxicity: class-conditional Kneser-Ney models over words.

Text is read as words: runs of ASCII letters, digits and two-byte characters, with A-Z
in lower case; a character of three or four bytes, as most scripts without blanks have,
is a word of its own. Each word follows the one before it, the first of a text a
boundary. Two models, one of toxic and one of ordinary text, give the probability of a
word after its predecessor. Their counts are a Spark table of all pairs of words of
every labelled training document, so the model grows with that text.

A pair counts once per document, so a document that repeats itself weighs like any
other. Each class discounts its pairs absolutely and backs off to its own Kneser-Ney
distribution of single words: in how many different contexts does a word occur in that
class? That one is discounted as well and backs off to counts both classes share:
``SHARED_COUNT`` for each word of the pooled vocabulary, in proportion to their text, so
a word that is rare in either class gets nearly the same probability from both. Pairs
of fewer than ``PAIR_MIN`` documents and words of one context are left to the backoff
altogether; the table holds the others.

A document is compared by its length-normalised log-likelihood ratio: over the whole
text, and over the sliding stretch of ``STRETCH`` words where it is largest. A
logistic calibration on labelled documents left out of the counts (one in five, a
bounded sample of ``SAMPLE``) turns both into a probability. Ratios are whole numbers
of 1 / ``UNIT``, so equal texts have equal scores wherever they lie.

A table of at most ``TABLE_ROWS`` rows (16 bytes each) is broadcast. Beyond that the
documents are dealt into parts of about ``PART_BYTES`` and stored, each part asks for its
distinct grams in a join, and documents and answers meet part by part: the same scores,
tested against each other.

Defined cases: null, empty and wordless texts get zero ratios; without labels, or with
one label only, the score is a constant; repeated rows and ids are scored row by row;
very long texts are read whole; other columns are kept by ``keep_clean`` as they are,
whatever their names.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.calibrate import Calibration, constant, fit
from ledgerloom.llm.tables import join_small, known_labels, remainder
from ledgerloom.llm.text import LOWER, Piece, hash_spans, members, mix, pieces
from ledgerloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Backoff counts of every vocabulary word, and of the words after every word, that both classes share.
SHARED_COUNT, CONTEXT_COUNT = 3.0, 5_000.0
#: Least documents of a stored pair and least contexts of a stored word.
PAIR_MIN, WORD_MIN = 5, 2
STRETCH, UNIT = 1, 1 << 16
#: Rows of the broadcast table: 16 bytes each, 64 MB at most.
TABLE_ROWS = 4_000_000
#: Bytes of text in a part where documents and answers meet.
PART_BYTES = 64 << 20
SAMPLE, HELD_OUT_OF, HELD_OUT, CALIBRATE_OF, THRESHOLD = 20_000, 4, 2, 5, 0.3
CLASSES = ("ordinary", "toxic")
#: ASCII letters, digits and everything beyond ASCII.
WORD = members([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
BOUNDARY = np.uint64(0x5DEECE66D)
PAIR = np.uint64(0xD6E8FEB86659FD93)


def word_stream(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of the word before it, row) over all documents of a piece."""
    data = LOWER[piece.data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD[data]
    wide = np.zeros(len(data) + 4, bool)
    leads = np.flatnonzero(data >= 0xE0)
    for k in range(3):
        wide[leads + k] = True
    wide[leads[data[leads] >= 0xF0] + 3] = True
    wide = wide[: len(data)]
    # A word begins after a gap, at a document, at a wide character and after one.
    begins = ~inside[:-2]
    begins[1:] |= wide[:-1] & ~wide[1:]
    begins[leads] = True
    edges = piece.offsets[:-1]
    begins[edges[edges < len(data)]] = True
    starts = np.flatnonzero(begins & inside[1:-1])
    # It ends where the next begins or at the first byte outside.
    stops = ~inside[2:]
    stops[:-1] |= begins[1:]
    ends = np.flatnonzero(stops & inside[1:-1]) + 1
    rows = np.searchsorted(piece.offsets, starts, "right") - 1
    words = hash_spans(data, starts, ends)
    before = np.full(len(words), BOUNDARY)
    same = rows[1:] == rows[:-1]
    before[1:][same] = words[:-1][same]
    return words, before, rows


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * PAIR + words)


def pair_counts(labelled: DataFrame) -> DataFrame:
    """(before, word, ordinary, toxic): documents of each class that hold a pair, for all pairs of ``labelled(label, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column("text")):
                words, before, rows = word_stream(piece)
                # Once per document.
                _, once = np.unique(mix(pair_keys(before, words) + rows.astype(np.uint64) * PAIR), return_index=True)
                words, before, rows = words[once], before[once], rows[once]
                toxic = label[piece.first + rows] > 0
                _, first, of = np.unique(pair_keys(before, words), return_index=True, return_inverse=True)
                counts = [np.bincount(of[own], minlength=len(first)) for own in (~toxic, toxic)]
                columns = [before[first].view(np.int64), words[first].view(np.int64), *counts]
                yield pa.record_batch([pa.array(c) for c in columns], ["before", "word", *CLASSES])

    partial = labelled.select("label", "text").mapInArrow(run, "before long, word long, ordinary long, toxic long")
    return partial.groupBy("before", "word").agg(*[F.sum(c).alias(c) for c in CLASSES])


def count_figures(least: int) -> list[Column]:
    """Per class: all counts, those of grams of fewer than ``least`` in all, other grams, grams with one and two."""
    rare = F.col("ordinary") + F.col("toxic") < least
    out = []
    for c in CLASSES:
        n = F.col(c)
        out += [
            F.ifnull(F.sum(n), F.lit(0)).alias(f"{c}_all"),
            F.ifnull(F.sum(F.when(rare, n)), F.lit(0)).alias(f"{c}_rare"),
            F.count(F.when(~rare & (n > 0), 1)).alias(f"{c}_grams"),
            F.count(F.when(n == 1, 1)).alias(f"{c}_1"),
            F.count(F.when(n == 2, 1)).alias(f"{c}_2"),
        ]
    return out


def discount(once: int, twice: int) -> float:
    """Kneser and Ney's estimate n1 / (n1 + 2 n2)."""
    return once / (once + 2 * twice) if once and twice else 0.75


def discounted(count: str, cut: float) -> Column:
    return F.col(count) - F.least(F.col(count), F.lit(cut))


def log_ratio(toxic: Column, ordinary: Column) -> Column:
    return F.round(F.log(toxic / ordinary) * UNIT).cast("int")


def gram_table(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(stored table (gram, ratio, back), ratio of a word that it lacks) from a stored table of pairs.

    ``ratio`` is log P(toxic) / P(ordinary) of a word by itself or of a pair; ``back``
    is what a word adds, as predecessor, to the ratio of a word it makes no stored pair with.
    """
    words = materialize(pairs.groupBy("word").agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in CLASSES]), "words")
    of_pairs = pairs.agg(*count_figures(PAIR_MIN)).first()
    of_words = words.agg(*count_figures(WORD_MIN), F.count(F.lit(1)).alias("words")).first()
    size = of_words["words"] + 1
    cut = {c: discount(of_pairs[f"{c}_1"], of_pairs[f"{c}_2"]) for c in CLASSES}
    word_cut = {c: discount(of_words[f"{c}_1"], of_words[f"{c}_2"]) for c in CLASSES}
    part = {c: (of_words[f"{c}_all"] + 1) / sum(of_words[f"{k}_all"] + 1 for k in CLASSES) for c in CLASSES}
    shared = {c: SHARED_COUNT * size * part[c] for c in CLASSES}
    total = {c: of_words[f"{c}_all"] + shared[c] for c in CLASSES}
    # What a word gets that is left to the backoff.
    floor = {c: (of_words[f"{c}_rare"] + word_cut[c] * of_words[f"{c}_grams"] + shared[c]) / size for c in CLASSES}
    often = words.filter(F.col("ordinary") + F.col("toxic") >= WORD_MIN).select(
        "word", *[((discounted(c, word_cut[c]) + F.lit(floor[c])) / F.lit(total[c])).alias(f"{c}_chance") for c in CLASSES]
    )
    singles = often.select(F.col("word").alias("gram"), log_ratio(F.col("toxic_chance"), F.col("ordinary_chance")).alias("ratio"))
    # Other contexts leave all they have to the backoff of both classes: nothing to add.
    contexts = pairs.groupBy("before").agg(*count_figures(PAIR_MIN)).filter("ordinary_grams + toxic_grams > 0")
    after = {c: CONTEXT_COUNT * part[c] for c in CLASSES}
    contexts = contexts.select(
        "before",
        *[(F.col(f"{c}_all") + F.lit(after[c])).alias(f"{c}_total") for c in CLASSES],
        *[(F.col(f"{c}_rare") + F.col(f"{c}_grams") * F.lit(cut[c]) + F.lit(after[c])).alias(f"{c}_mass") for c in CLASSES],
    )
    contexts = materialize(contexts, "contexts")
    backs = contexts.select(
        F.col("before").alias("gram"),
        log_ratio(F.col("toxic_mass") / F.col("toxic_total"), F.col("ordinary_mass") / F.col("ordinary_total")).alias("back"),
    )
    unseen = round(math.log(floor["toxic"] / total["toxic"] * total["ordinary"] / floor["ordinary"]) * UNIT)
    # The boundary is a predecessor only, and so may be a word of one context.
    singles = singles.join(backs, "gram", "full").select(
        "gram", F.ifnull("ratio", F.lit(unseen)).alias("ratio"), F.ifnull("back", F.lit(0)).alias("back")
    )
    joined = pairs.filter(F.col("ordinary") + F.col("toxic") >= PAIR_MIN).join(contexts, "before").join(often, "word", "left")
    chance = {c: F.ifnull(F.col(f"{c}_chance"), F.lit(floor[c] / total[c])) for c in CLASSES}
    found = {c: (discounted(c, cut[c]) + F.col(f"{c}_mass") * chance[c]) / F.col(f"{c}_total") for c in CLASSES}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("before", "word"))
            columns = [pa.array(pair_keys(before, word).view(np.int64)), batch.column("ratio"), pa.array(np.zeros(len(word), np.int32))]
            yield pa.record_batch(columns, ["gram", "ratio", "back"])

    double = joined.select("before", "word", log_ratio(found["toxic"], found["ordinary"]).alias("ratio"))
    double = double.mapInArrow(keys, "gram long, ratio int, back int")
    return materialize(singles.unionByName(double), "grams"), unseen


@dataclass(frozen=True)
class Grams:
    """A sorted gram table, or the part of it that some documents ask for."""

    keys: np.ndarray
    ratios: np.ndarray
    backs: np.ndarray
    unseen: int

    @staticmethod
    def of(gram: np.ndarray, ratio: np.ndarray, back: np.ndarray, unseen: int) -> Grams:
        order = np.argsort(gram)
        return Grams(gram[order], ratio[order], back[order], unseen)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, is it there) of each key."""
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return at, self.keys[at] == wanted

    def stream(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio, in 1 / UNIT, of each word after the one before it."""
        if not len(self.keys):
            return np.full(len(words), self.unseen, np.int64)
        at, known = self.find(words.view(np.int64))
        above, context = self.find(before.view(np.int64))
        pair, stored = self.find(pair_keys(before, words).view(np.int64))
        backed = np.where(known, self.ratios[at], self.unseen).astype(np.int64) + np.where(context, self.backs[above], 0)
        return np.where(stored, self.ratios[pair], backed)

    def features(self, column: pa.Array) -> np.ndarray:
        """(largest stretch, whole text) of normalised log-likelihood ratios per text."""
        found = np.zeros((len(column), 2))
        for piece in pieces(column):
            words, before, rows = word_stream(piece)
            sums = np.concatenate([[0], np.cumsum(self.stream(words, before))])
            lengths = np.bincount(rows, minlength=len(piece))
            some = np.flatnonzero(lengths)
            if not len(some):
                continue
            starts = (np.cumsum(lengths) - lengths)[some]
            sizes = lengths[some]
            low = np.maximum(np.arange(1, len(words) + 1) - STRETCH, np.repeat(starts, sizes))
            best = np.maximum.reduceat(sums[1:] - sums[low], starts)
            found[piece.first + some] = np.column_stack([best / (STRETCH * UNIT), (sums[starts + sizes] - sums[starts]) / (sizes * UNIT)])
        return found


@dataclass(frozen=True)
class ToxicityModel:
    table: DataFrame
    unseen: int
    #: The whole table, unless it is too large to broadcast.
    whole: Broadcast | None
    calibration: Calibration | None = None


def probability(calibration: Calibration, found: np.ndarray) -> np.ndarray:
    """The calibrated score of each row by itself: a matrix product rounds by the rows beside it."""
    scaled = (found - calibration.mean) / calibration.scale
    value = scaled[:, 0] * calibration.weights[0] + scaled[:, 1] * calibration.weights[1] + calibration.bias
    return 1.0 / (1.0 + np.exp(-np.clip(value, -30, 30)))


def load(table: DataFrame, unseen: int, limit: int = TABLE_ROWS) -> ToxicityModel:
    """A model without calibration; its table is broadcast if it is counted to have at most ``limit`` rows."""
    if table.count() > limit:
        return ToxicityModel(table, unseen, None)
    # As Arrow columns: rows would cost the driver some 500 bytes each.
    rows = table.toArrow()
    grams = Grams.of(*[rows.column(c).to_numpy() for c in ("gram", "ratio", "back")], unseen)
    return ToxicityModel(table, unseen, table.sparkSession.sparkContext.broadcast(grams))


def with_features(
    docs: DataFrame, model: ToxicityModel, finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str | object
) -> DataFrame:
    """``finish(batch, features)`` of all batches of ``docs``, which has a column ``text``."""
    whole, unseen = model.whole, model.unseen
    if whole is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finish(batch, whole.value.features(batch.column("text")))

        return docs.mapInArrow(run, schema)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            for piece in pieces(batch.column("text")):
                words, before, rows = word_stream(piece)
                of = np.tile(part[piece.first + rows], 3)
                grams = np.concatenate([words, before, pair_keys(before, words)])
                _, first = np.unique(mix(of.astype(np.uint64) * PAIR + grams), return_index=True)
                yield pa.record_batch([pa.array(of[first]), pa.array(grams[first].view(np.int64))], ["part", "gram"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = Grams.of(*[right.column(c).to_numpy() for c in ("gram", "ratio", "back")], unseen)
        out = [finish(b, grams.features(b.column("text"))) for b in map(pa.RecordBatch.from_struct_array, left.column("row").chunks)]
        return pa.Table.from_batches(out)

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // PART_BYTES + 1
    # Dealt by place, so rows that repeat everything spread as well; stored, so both readers see the same parts.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("part")
    dealt = materialize(docs.select(part, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "dealt")
    wanted = dealt.select("part", F.col("row.text").alias("text")).mapInArrow(asked, "part long, gram long").distinct()
    answers = wanted.join(model.table, "gram").select("part", "gram", "ratio", "back")
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(meet, schema)


def train(docs: DataFrame, labels: DataFrame, limit: int = TABLE_ROWS) -> ToxicityModel:
    """Counts over all labelled training documents, calibration on those left out of the counts."""
    known = known_labels(labels, "toxic").filter(remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE_OF))
    pairs = materialize(pair_counts(join_small(docs.select("doc_id", "text"), known.filter(fold != 0), "doc_id")), "pairs")
    model = load(*gram_table(pairs), limit)
    left_out = known.filter(fold == 0).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(SAMPLE)

    def finish(batch: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([batch.column("label"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["label", "best", "mean"])

    # At most SAMPLE labels: a proven bound.
    sample = docs.select("doc_id", "text").join(F.broadcast(left_out), "doc_id")
    rows = sorted(tuple(r) for r in with_features(sample, model, finish, "label int, best double, mean double").collect())
    if rows:
        values = np.array(rows, dtype=float)
        calibration = fit(values[:, 1:], values[:, 0])
    else:
        some = known.agg(F.avg("label")).first()[0]
        calibration = constant(2, 0.5 if some is None else float(some))
    return ToxicityModel(model.table, model.unseen, model.whole, calibration)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``."""
    calibration = model.calibration

    def finish(batch: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array(probability(calibration, found))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = with_features(docs.select("doc_id", "text"), model, finish, f"doc_id {kind}, score double")
    held_out = F.ifnull(remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with their columns."""
    calibration = model.calibration

    def finish(batch: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(probability(calibration, found) < threshold))

    return with_features(docs, model, finish, docs.schema)
