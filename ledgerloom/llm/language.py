"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte is an input symbol. Two gated recurrent layers, one reading forwards and
one backwards, give each position a distribution over the languages; a document's
probabilities are the mean over its positions. The text is read in stretches of
``STRETCH`` bytes, so memory does not depend on a document's length, and every byte
of the whole text is labelled. Gates are hard sigmoids and states hard tangents.

The network is trained in numpy by backpropagation through time (Adam), on the
driver, from a bounded sample: at most ``SAMPLE`` stretches of each language, one
per training document, chosen by the hash of the document's id.

Defined cases: null text and text without a letter get ``und`` with score 0; so does
every text if there is nothing to learn from.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import remainder
from ledgerloom.llm.text import Piece, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Up to 1,000 a language, Spark drops all others of a hot one before the shuffle.
HIDDEN, STRETCH, SAMPLE, EPOCHS, BATCH, RATE, SEED = 8, 64, 1000, 12, 128, 0.01, 11
HELD_OUT_OF, UNKNOWN, BLANK_BYTE, GROUP = 5, "und", 0x20, 4096


@dataclass
class Direction:
    """One reading direction: rows of ``gate_in`` and ``state_in`` belong to the 256 bytes."""

    gate_in: np.ndarray
    state_in: np.ndarray
    gate_back: np.ndarray
    state_back: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.gate_in, self.state_in, self.gate_back, self.state_back]

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """Hidden states after each of the (time, batch) symbols: (time, batch, hidden)."""
        steps, width = symbols.shape
        out = np.empty((steps, width, HIDDEN), np.float32)
        h = np.zeros((width, HIDDEN), np.float32)
        for t in range(steps):
            gates = np.take(self.gate_in, symbols[t], axis=0)
            gates += h @ self.gate_back
            np.clip(gates, 0.0, 1.0, out=gates)
            state = h @ self.state_back
            state *= gates[:, HIDDEN:]
            state += np.take(self.state_in, symbols[t], axis=0)
            np.clip(state, -1.0, 1.0, out=state)
            # h = keep * h + (1 - keep) * state
            h = np.multiply(h - state, gates[:, :HIDDEN], out=out[t])
            h += state
        return out

    def gradients(self, symbols: np.ndarray, out: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time: ``wanted`` is the loss gradient at every state."""
        grads = [np.zeros_like(p) for p in self.parameters()]
        carry = np.zeros_like(out[0])
        for t in range(len(symbols) - 1, -1, -1):
            before = out[t - 1] if t else np.zeros_like(carry)
            linear = self.gate_in[symbols[t]] + before @ self.gate_back
            gates = np.clip(linear, 0.0, 1.0)
            keep, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            pushed = before @ self.state_back
            raw = pushed * reset + self.state_in[symbols[t]]
            state = np.clip(raw, -1.0, 1.0)
            dh = wanted[t] + carry
            dstate = dh * (1 - keep) * (np.abs(raw) < 1)
            dgates = np.concatenate([dh * (before - state), dstate * pushed], axis=1) * ((linear > 0) & (linear < 1))
            dpushed = dstate * reset
            np.add.at(grads[0], symbols[t], dgates)
            np.add.at(grads[1], symbols[t], dstate)
            grads[2] += before.T @ dgates
            grads[3] += before.T @ dpushed
            carry = dh * keep + dgates @ self.gate_back.T + dpushed @ self.state_back.T
        return grads


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Direction
    backward: Direction
    out_forward: np.ndarray
    out_backward: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.forward.parameters(), *self.backward.parameters(), self.out_forward, self.out_backward, self.bias]

    def positions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language probabilities at each of the (time, batch) positions, and both state series."""
        ahead = self.forward.states(symbols)
        back = self.backward.states(symbols[::-1])[::-1]
        logits = ahead.reshape(-1, HIDDEN) @ self.out_forward
        logits += np.ascontiguousarray(back).reshape(-1, HIDDEN) @ self.out_backward
        logits += self.bias
        # States are within 1, so logits are small; a bound keeps exp finite whatever the weights.
        np.clip(logits, -40.0, 40.0, out=logits)
        np.exp(logits, out=logits)
        logits /= logits @ np.ones((logits.shape[1], 1), np.float32)
        return logits.reshape(*symbols.shape, -1), ahead, back

    def pooled(self, piece: Piece) -> np.ndarray:
        """Mean probabilities over all positions of each document; zeros for an empty one."""
        sizes = np.diff(piece.offsets)
        counts = -(-sizes // STRETCH)
        rows = np.repeat(np.arange(len(sizes)), counts)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = piece.offsets[:-1][rows] + STRETCH * place
        ends = np.minimum(starts + STRETCH, piece.offsets[1:][rows])
        total = np.zeros((len(sizes), len(self.languages)))
        for low in range(0, len(rows), GROUP):
            first, last = starts[low : low + GROUP], ends[low : low + GROUP]
            at = first[None, :] + np.arange(STRETCH)[:, None]
            real = at < last[None, :]
            symbols = np.where(real, piece.data[np.minimum(at, len(piece.data) - 1)], np.uint8(BLANK_BYTE))
            found = self.positions(symbols)[0]
            found *= real[:, :, None]
            np.add.at(total, rows[low : low + GROUP], found.sum(axis=0))
        return total / np.maximum(sizes, 1)[:, None]


def _start(languages: list[str], rng: np.random.Generator) -> LanguageModel:
    def matrix(rows: int, columns: int, scale: float) -> np.ndarray:
        return (rng.normal(size=(rows, columns)) * scale).astype(np.float32)

    def direction() -> Direction:
        gates = matrix(256, 2 * HIDDEN, 0.1) + np.float32(0.5)
        return Direction(gates, matrix(256, HIDDEN, 0.3), matrix(HIDDEN, 2 * HIDDEN, 0.1), matrix(HIDDEN, HIDDEN, 0.3))

    width = len(languages)
    return LanguageModel(
        languages, direction(), direction(), matrix(HIDDEN, width, 0.3), matrix(HIDDEN, width, 0.3), np.zeros(width, np.float32)
    )


def learn(stretches: np.ndarray, target: np.ndarray, languages: list[str]) -> LanguageModel:
    """Fit on (n, STRETCH) byte rows; every position of a row carries the row's language."""
    rng = np.random.default_rng(SEED)
    model = _start(languages, rng)
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    step, steps = 0, EPOCHS * -(-len(target) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            symbols = np.ascontiguousarray(stretches[rows].T)
            found, ahead, back = model.positions(symbols)
            error = found
            error[:, np.arange(len(rows)), target[rows]] -= 1.0
            error /= error.shape[0] * error.shape[1]
            flat = error.reshape(-1, len(languages))
            grads = [
                *model.forward.gradients(symbols, ahead, error @ model.out_forward.T),
                *model.backward.gradients(symbols[::-1], back[::-1], (error @ model.out_backward.T)[::-1]),
                ahead.reshape(-1, HIDDEN).T @ flat,
                np.ascontiguousarray(back).reshape(-1, HIDDEN).T @ flat,
                flat.sum(axis=0),
            ]
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for value, grad, m, v in zip(model.parameters(), grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, size: int = SAMPLE) -> LanguageModel | None:
    """The network, from texts and languages of training documents; None without any."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).filter(remainder(F.col("doc_id"), HELD_OUT_OF) != 0)
    # One stretch per document, from a place that the id decides.
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.greatest(F.length("text") - STRETCH + 1, F.lit(1))) + 1
    cut = usable.select("doc_id", "lang", F.substring("text", place.cast("int"), F.lit(STRETCH)).alias("stretch"))
    ranked = cut.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    rows = sorted((r["lang"], r["stretch"]) for r in ranked.select("lang", "stretch").collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    stretches = np.full((len(rows), STRETCH), BLANK_BYTE, np.uint8)
    for i, (_, text) in enumerate(rows):
        raw = np.frombuffer(text.encode()[:STRETCH], np.uint8)
        stretches[i, : len(raw)] = raw
    return learn(stretches, np.array([languages.index(lang) for lang, _ in rows]), languages)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs(doc_id, text)``."""
    names = model.languages if model else [UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, len(names)))
            if model is not None:
                for piece in pieces(batch.column("text")):
                    found[piece.first : piece.first + len(piece)] = model.pooled(piece)
            known = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool) & (model is not None)
            best = found.argmax(axis=1)
            lang = [names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())]
            score = np.where(known, np.clip(found[np.arange(len(best)), best], 0.0, 1.0), 0.0)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    lettered = F.ifnull(F.col("text").rlike(r"\p{L}"), F.lit(False))
    marked = docs.select("doc_id", "text", lettered.alias("lettered"))
    held_out = F.ifnull(remainder(F.col("doc_id"), HELD_OUT_OF) == 0, F.lit(False))
    found = marked.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
