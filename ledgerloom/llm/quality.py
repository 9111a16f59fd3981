"""Quality classifier: two compression dictionaries and a calibrated size difference.

One zstandard dictionary is built from blocks of good text and one from blocks of
bad text. A document is cut into blocks, each is compressed with either dictionary,
and the normalised difference of the compressed sizes, together with the ratio to
the raw size that normalises it, becomes a probability by logistic calibration on
labelled documents that neither dictionary has seen. Every block of the whole text
counts.

The models are fitted on a bounded sample: at most ``SAMPLE`` labelled documents of
either label, chosen by the hash of their id, half for the dictionaries (at most
``BLOCKS`` blocks a document) and half for the calibration. Class weights in the
calibration come from the counts of all training labels.

Defined cases: null text counts as empty and gets the score of zero features; without
labels, or with one label only, the score is a constant.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.calibrate import Calibration, constant, fit
from ledgerloom.llm.tables import known_labels, remainder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE, BLOCKS, BLOCK, DICTIONARY, LEVEL = 3000, 8, 512, 65_536, 3
HELD_OUT_OF, THRESHOLD = 5, 0.3
FEATURES = 4


def blocks_of(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


@dataclass
class Compressors:
    """Good and bad dictionaries; the zstandard objects are made in each task."""

    good: bytes
    bad: bytes
    _ready: tuple = field(default=(), repr=False)

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "_ready": ()}

    def sizes(self, block: bytes) -> tuple[int, int]:
        if not self._ready:
            made = []
            for content in (self.good, self.bad):
                dictionary = zstandard.ZstdCompressionDict(content)
                dictionary.precompute_compress(level=LEVEL)
                made.append(
                    zstandard.ZstdCompressor(
                        level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False
                    )
                )
            self._ready = tuple(made)
        good, bad = self._ready
        return len(good.compress(block)), len(bad.compress(block))

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Size difference over size sum, compressed share, its square, largest block difference."""
        raw = good = bad = 0
        worst = -1.0
        for block in blocks_of(text):
            g, b = self.sizes(block)
            raw, good, bad = raw + len(block), good + g, bad + b
            if 2 * len(block) >= BLOCK:
                worst = max(worst, (g - b) / (g + b))
        if not raw:
            return 0.0, 1.0, 1.0, 0.0
        difference, share = (good - bad) / (good + bad), min(good / raw, 2.0)
        return difference, share, share * share, worst if worst > -1.0 else difference


@dataclass
class QualityModel:
    compressors: Compressors | None
    calibration: Calibration


def _sample(docs: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(doc_id, text, label, fold): at most ``size`` training documents of either label."""
    some = [known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for label in (0, 1)]
    chosen = some[0].unionByName(some[1]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)))
    # At most 2 * size rows: a proven bound.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> QualityModel:
    known = known_labels(labels, "quality").filter(remainder(F.col("doc_id"), HELD_OUT_OF) != 0)
    sample = _sample(docs, known, size)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_label, out_block = [], []
            for label, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("label", "doc_id", "text"))):
                parts = blocks_of(text)
                chosen = np.random.default_rng(abs(int(doc_id))).permutation(len(parts))[:BLOCKS]
                out_label += [label] * len(chosen)
                out_block += [parts[i] for i in sorted(chosen.tolist())]
            yield pa.record_batch({"label": pa.array(out_label, pa.int32()), "block": pa.array(out_block, pa.binary())})

    rows = sample.filter("fold = 1").select("label", "doc_id", "text").mapInArrow(cut, "label int, block binary").collect()
    material = {label: sorted(bytes(r["block"]) for r in rows if r["label"] == label) for label in (0, 1)}
    if not material[0] or not material[1]:
        total = sum(counts.values())
        return QualityModel(None, constant(FEATURES, counts.get(1, 0) / total if total else 0.5))
    compressors = Compressors(dictionary_of(material[1]), dictionary_of(material[0]))
    measured = _features(sample.filter("fold = 0").select("label", "text"), compressors, ["label"]).collect()
    if not measured:
        return QualityModel(compressors, constant(FEATURES, counts.get(1, 0) / sum(counts.values())))
    values = np.array([r["features"] for r in sorted(measured)], dtype=float)
    truth = np.array([r["label"] for r in sorted(measured)], dtype=float)
    share = {label: counts[label] / max(1, int((truth == label).sum())) for label in (0, 1)}
    weights = np.where(truth == 1, share[1], share[0])
    return QualityModel(compressors, fit(values, truth, weights * len(weights) / weights.sum()))


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary; of few samples, their text itself."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 4), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def _features(rows: DataFrame, compressors: Compressors, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(compressors.features(t.as_py())) for t in batch.column("text")]
            columns = {c: batch.column(c) for c in keep}
            yield pa.record_batch(columns | {"features": pa.array(found, pa.list_(pa.float64()))})

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, features array<double>")


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``."""
    compressors, calibration = model.compressors, model.calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((batch.num_rows, FEATURES))
            if compressors is not None:
                for i, text in enumerate(batch.column("text")):
                    values[i] = compressors.features(text.as_py())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(calibration(values))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    held_out = F.ifnull(remainder(F.col("doc_id"), HELD_OUT_OF) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
