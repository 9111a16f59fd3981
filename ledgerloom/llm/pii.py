r"""Personal data: base rules, and a skip-chain conditional random field over each document.

*Base.* Four kinds, each with its own leftmost matches that do not overlap: e-mail and network
addresses, card and phone numbers. A match that fails its check (parts above 255, Luhn sum,
number of digits) is dropped; base spans always stay.

*Field.* The nodes of a document are its base spans, whose labels are observed, and all other
blank-separated tokens with a digit or ``@``. Potentials tie

- a node's label to its shape (digits, groups, dots, letters, brackets, signs),
- the labels of nodes that stand next to each other,
- the labels of *distant* nodes that repeat or resemble each other: equal letters and digits
  (``same``), or equal last seven digits, beginnings, or local parts (``similar``). Each node is
  linked to the one before it with the same key and to the last base span with that key, so links
  stay linear in the document.

Loopy belief propagation (sum-product, damped, to ``ROUNDS`` rounds) carries labels along the
links, so a mention that breaks the rules (``name(at)host``, a number without its ``+1``) is found
where the document names the same thing properly elsewhere, and a look-alike that nothing
supports is left alone. Tokens whose marginal reaches ``SURE`` become added spans; neighbours of
one label are one span.

*Training* by pseudo-likelihood in numpy. No labels are needed: documents of a sample
(``SAMPLE`` expected, by hash) get, behind their text, two invented base spans, damaged repeats
of these and of their own base spans (label: the kind), look-alikes and bare fragments (label:
none); all their other tokens are none. A token's row in the likelihood is its shape and the labels of its neighbours;
Spark counts equal rows, so the driver reads few.

Whole texts are searched, in one pass and without a shuffle; a lost task is run again. Time and
memory are linear in a text's length. Defined cases: null text is empty and has no spans; rows
that repeat an id, ties and equal texts are rows like all others (equal texts have equal
spans); two kinds at one place are both spans; an empty table gives an empty result and an
untrained field, which adds nothing; other columns are kept by ``masked_documents`` and left out by ``find``.
"""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
SAMPLE, ROUNDS, SURE = 20_000, 25, 0.5
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

# The patterns of the base rules. A match starts where a run of its first class does.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
AT = re.compile(r"\((?:at)\)|\[(?:at)\]|@", re.IGNORECASE)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` outwards, so that long words without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            end = domain.end()
        # The local part may not hold an @, so nothing before this one can start the next match.
        end = max(end, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) in code points, by start, then kind."""
    found: list[Span] = []
    if not ANY.search(text):
        return found
    found += [(start, 0, end) for start, end in emails(text)]
    for m in ADDRESS.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        # At most every second character of a match is none of its digits.
        if 14 <= m.end() - m.start() <= 37:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def letters_and_digits(token: str) -> str:
    return "".join(c for c in AT.sub("", token) if c.isalnum()).lower()


def shape(token: str) -> int:
    """Bits of a token's shape."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    groups = len(re.findall(r"[0-9]+", token))
    dots = len(re.findall(r"[0-9]\.(?=[0-9])", token))
    bits = [
        1 if digits == 0 else 2 if digits < 3 else 3 if digits == 3 else 4 if digits == 4 else 5 if digits < 8
        else 6 if digits < 10 else 7 if digits < 12 else 8 if digits < 14 else 9 if digits < 20 else 10,
        10 + min(groups, 6),
        17 + min(dots, 4),
        22 if not letters else 23 if letters < digits else 24,
    ]
    bits += [
        25 + i
        for i, seen in enumerate(
            (bool(AT.search(token)), "+" in token, "(" in token or ")" in token, bool(re.search("[0-9]-[0-9]", token)),
             "," in token, "_" in token or "=" in token, '"' in token, len(token) > 24)
        )
        if seen
    ]
    return 1 | sum(1 << b for b in bits)


SHAPES = 33
#: Kinds of links: neighbours, equal tokens, similar tokens.
NEXT, SAME, SIMILAR = range(3)


@dataclass
class Nodes:
    """The field of one text: base spans (observed) and tokens, in order, and their links."""

    start: list[int]
    end: list[int]
    #: Label of a base span, or -1.
    observed: list[int]
    shapes: list[int]
    links: list[tuple[int, int, int]]


def similar_keys(text: str, core: str) -> list[str]:
    digits = "".join(c for c in core if c.isdigit())
    keys = []
    if len(digits) >= 7:
        keys.append("end " + digits[-7:])
    if len(core) >= 7:
        keys.append("begin " + core[:6])
    local = AT.split(text, maxsplit=1)[0]
    if len(local := letters_and_digits(local)) >= 4:
        keys.append("local " + local)
    return keys


def field(text: str, spans: list[Span]) -> Nodes:
    """Nodes and links of a text with its base spans."""
    nodes = Nodes([], [], [], [], [])
    entries: list[tuple[int, int, int, str]] = [(s, e, kind + 1, text[s:e]) for s, kind, e in spans]
    # Places covered by base spans, as disjoint stretches.
    covered: list[list[int]] = []
    for s, _, e in spans:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    at = 0
    for m in TOKEN.finditer(text):
        if not ANY.search(m[0]):
            continue
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at < len(covered) and covered[at][0] < m.end():
            continue
        start, end = m.span()
        while start < end and not (text[start].isalnum() or text[start] in "+(@"):
            start += 1
        while end > start and not (text[end - 1].isalnum() or text[end - 1] in ")@"):
            end -= 1
        if start < end:
            entries.append((start, end, -1, text[start:end]))
    entries.sort(key=lambda x: (x[0], x[2]))
    last: dict[str, int] = {}
    proper: dict[str, int] = {}
    kinds: dict[tuple[int, int], int] = {}
    for i, (start, end, label, part) in enumerate(entries):
        nodes.start.append(start)
        nodes.end.append(end)
        nodes.observed.append(label)
        nodes.shapes.append(shape(part) if label < 0 else 1)
        if i and nodes.end[i - 1] <= start and start - nodes.end[i - 1] <= 3 and not text[nodes.end[i - 1] : start].strip(" \t-"):
            kinds[i - 1, i] = NEXT
        core = letters_and_digits(part)
        keys = [("same " + core, SAME)] if len(core) >= 3 else []
        if label >= 0:
            keys += [("same " + c, SAME) for c in map(letters_and_digits, part.split()) if len(c) >= 3 and c != core]
        keys += [(key, SIMILAR) for key in similar_keys(part, core)]
        for key, kind in keys:
            for other in {last.get(key, i), proper.get(key, i)} - {i}:
                kinds[other, i] = min(kind, kinds.get((other, i), kind))
            last[key] = i
            if label >= 0:
                proper[key] = i
    nodes.links = [(a, b, kind) for (a, b), kind in kinds.items()]
    return nodes


def damaged(rnd: random.Random, kind: int, span: str) -> str:
    """A mention of the same thing that the base rules do not take."""
    digits = NOT_DIGIT.sub("", span)
    if kind == 0:
        local, _, domain = span.partition("@")
        return rnd.choice([f"{local}(at){domain}", f"{local}[at]{domain}", f"{local} @ {domain}", local])
    if kind == 1:
        return rnd.choice([span.replace(".", ","), span.replace(".", "-"), span.rpartition(".")[0]])
    if kind == 2:
        return rnd.choice([digits[:-1], digits[:4] + "." + digits[4:8] + "." + digits[8:12] + "." + digits[12:], digits + "0" * (20 - len(digits))])
    own = digits[-10:]
    return rnd.choice([f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}", own, f"{own[:3]}-{own[3:6]}-{own[6:]}"])


def invented(rnd: random.Random, kind: int) -> str:
    """A mention that the base rules take."""

    def digits(n: int) -> str:
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(3, 8)))

    if kind == 0:
        return f"{word()}{rnd.choice(['.', '_', ''])}{digits(rnd.randint(1, 3))}@{word()}{digits(rnd.randint(0, 1))}.{rnd.choice(['com', 'example.com', 'org'])}"
    if kind == 1:
        return ".".join(str(rnd.randrange(256)) for _ in range(4))
    if kind == 2:
        start = "4" + digits(14)
        number = next(start + d for d in "0123456789" if luhn(start + d))
        return rnd.choice([number, " ".join(number[i : i + 4] for i in range(0, 16, 4))])
    return rnd.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}"])


def scrambled(rnd: random.Random, mention: str) -> str:
    """A look-alike: other letters and digits in the same places."""
    return "".join(rnd.choice("0123456789") if c.isdigit() else rnd.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() and c.isascii() else c for c in mention)


def lesson(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with mentions behind it, and the places and labels of those that are personal data."""
    rnd = random.Random(zlib.crc32(text.encode()))
    spans = base_spans(text)
    marks: list[tuple[int, int, int]] = []
    parts, length = [text], len(text)

    def add(part: str, label: int = 0) -> None:
        nonlocal length
        filler = " " + rnd.choice(["and then", "with", "so it was", "by the other"]) + " "
        parts.extend([filler, part])
        if label:
            marks.append((length + len(filler), length + len(filler) + len(part), label))
        length += len(filler) + len(part)

    mentions = [(kind, text[start:end]) for start, kind, end in rnd.sample(spans, min(3, len(spans)))]
    for _ in range(2):
        kind = rnd.randrange(len(KINDS))
        mentions.append((kind, invented(rnd, kind)))
        add(mentions[-1][1])
    for kind, span in mentions:
        add(damaged(rnd, kind, span), kind + 1)
        add(scrambled(rnd, damaged(rnd, kind, span)))
        fragments = [f for f in re.findall("[0-9]+", span) if len(f) <= 4]
        if fragments:
            add(rnd.choice(fragments))
    add(str(rnd.randrange(10 ** rnd.randint(1, 6))))
    add(scrambled(rnd, rnd.choice(["4000 1234 5678 9010", "(555) 010-1234", "10.20.30.40.50", "ab.12(at)cd.ef.gh", "5554443322"])))
    return "".join(parts), marks


def lesson_rows(text: str) -> list[tuple]:
    """(shape, label, neighbours' labels per kind of link ...) of every token that is not observed."""
    text, marks = lesson(text)
    nodes = field(text, base_spans(text))
    labels = list(nodes.observed)
    for i, seen in enumerate(labels):
        if seen < 0:
            inside = [label for s, e, label in marks if s < nodes.end[i] and nodes.start[i] < e]
            labels[i] = inside[0] if inside else 0
    around = np.zeros((len(labels), 3, LABELS), int)
    for a, b, kind in nodes.links:
        around[a, kind, labels[b]] += 1
        around[b, kind, labels[a]] += 1
    return [
        (nodes.shapes[i], labels[i], around[i].reshape(-1).tolist()) for i, seen in enumerate(nodes.observed) if seen < 0
    ]


@dataclass(frozen=True)
class SkipChain:
    """Potentials: shape by label, and one symmetric table of labels for each kind of link."""

    shapes: np.ndarray
    links: np.ndarray

    @staticmethod
    def blank() -> SkipChain:
        """Before any training: no token is personal data."""
        shapes = np.zeros((SHAPES, LABELS))
        shapes[0, 0] = 20.0
        return SkipChain(shapes, np.zeros((3, LABELS, LABELS)))

    def unary(self, masks: np.ndarray) -> np.ndarray:
        return ((masks[:, None] >> np.arange(SHAPES)) & 1) @ self.shapes

    def marginals(self, masks: np.ndarray, observed: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Label probabilities of all nodes by loopy belief propagation."""
        own = self.unary(masks)
        fixed = observed >= 0
        own[fixed] = -60.0
        own[fixed, observed[fixed]] = 0.0
        if len(links):
            a, b, kind = links.T
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            table = self.links[np.concatenate([kind, kind])]
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            messages = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS):
                belief = own.copy()
                np.add.at(belief, target, messages)
                sent = np.logaddexp.reduce((belief[source] - messages[back])[:, :, None] + table, axis=1)
                sent -= np.logaddexp.reduce(sent, axis=1, keepdims=True)
                moved = np.abs(sent - messages).max()
                messages = 0.5 * (messages + sent)
                if moved < 1e-4:
                    break
            np.add.at(own, target, messages)
        return np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True))


def fit(rows: list[tuple[int, int, list[int], int]], steps: int = 400, rate: float = 0.1, decay: float = 1e-3) -> SkipChain:
    """Greatest pseudo-likelihood of (shape, label, neighbours, count) rows; Adam on all rows at once."""
    if not rows:
        return SkipChain.blank()
    rows = sorted(rows)
    masks = np.array([r[0] for r in rows], np.int64)
    wanted = np.eye(LABELS)[[r[1] for r in rows]]
    around = np.array([r[2] for r in rows], float).reshape(-1, 3, LABELS)
    weight = np.array([r[3] for r in rows], float)
    # Each label weighs as the root of its share, so that the many plain numbers do not drown the rest.
    shares = wanted.T @ weight
    weight *= (wanted / np.sqrt(np.maximum(shares, 1.0))).sum(axis=1)
    weight /= weight.sum()
    bits = ((masks[:, None] >> np.arange(SHAPES)) & 1).astype(float)
    value = [np.zeros((SHAPES, LABELS)), np.zeros((3, LABELS, LABELS))]
    first, second = ([np.zeros_like(v) for v in value] for _ in range(2))
    for step in range(1, steps + 1):
        score = bits @ value[0] + np.einsum("rkl,klm->rm", around, value[1])
        chance = np.exp(score - np.logaddexp.reduce(score, axis=1, keepdims=True))
        gap = (wanted - chance) * weight[:, None]
        slope = [bits.T @ gap, np.einsum("rkl,rm->klm", around, gap)]
        # One table for both directions of a link.
        slope[1] = (slope[1] + slope[1].transpose(0, 2, 1)) / 2
        for v, s, m, n in zip(value, slope, first, second):
            s -= decay * v / len(v)
            m += 0.1 * (s - m)
            n += 0.01 * (s * s - n)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(n / (1 - 0.99**step)) + 1e-9)
    return SkipChain(*value)


def train(docs: DataFrame, sample: int = SAMPLE) -> SkipChain:
    """The field fitted on about ``sample`` documents, chosen by hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for text in batch.column("text").to_pylist() if ANY.search(text) for row in lesson_rows(text)]
            yield pa.record_batch(
                {
                    "shape": pa.array([r[0] for r in rows], pa.int64()),
                    "label": pa.array([r[1] for r in rows], pa.int32()),
                    "around": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                }
            )

    total = docs.count()
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(total, 1))) < sample
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & drawn).select("text")
    rows = texts.mapInArrow(run, "shape long, label int, around array<long>")
    counted = rows.groupBy("shape", "label", "around").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit([(r["shape"], r["label"], list(r["around"]), r["n"]) for r in counted])


def added_spans(texts: list[str], bases: list[list[Span]], model: SkipChain) -> list[list[Span]]:
    """What the field adds to the base spans of each text."""
    fields = [field(t, b) if ANY.search(t) else Nodes([], [], [], [], []) for t, b in zip(texts, bases)]
    sizes = np.array([len(f.start) for f in fields])
    before = np.cumsum(sizes) - sizes
    observed = np.array([x for f in fields for x in f.observed], np.int64)
    out: list[list[Span]] = [[] for _ in texts]
    if not (observed < 0).any():
        return out
    masks = np.array([x for f in fields for x in f.shapes], np.int64)
    links = np.array([(a + n, b + n, k) for f, n in zip(fields, before.tolist()) for a, b, k in f.links], np.int64).reshape(-1, 3)
    chances = model.marginals(masks, observed, links)
    label = np.where((observed < 0) & (chances[:, 1:].max(axis=1) >= SURE), 1 + chances[:, 1:].argmax(axis=1), 0)
    for d, (f, first) in enumerate(zip(fields, before.tolist())):
        found = np.flatnonzero(label[first : first + len(f.start)]).tolist()
        follows = {b for a, b, _ in f.links if b == a + 1 and not texts[d][f.end[a] : f.start[b]].strip(" \t-")}
        for i in found:
            kind = int(label[first + i]) - 1
            if out[d] and i in follows and label[first + i - 1] == kind + 1:
                out[d][-1] = (out[d][-1][0], kind, f.end[i])
            else:
                out[d].append((f.start[i], kind, f.end[i]))
    return out


def _searched(column: pa.Array, model: SkipChain) -> tuple[list[list[Span]], list[list[Span]]]:
    texts = [t or "" for t in column.to_pylist()]
    bases = [base_spans(t) for t in texts]
    return bases, added_spans(texts, bases, model)


def _as_structs(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in rows], pa.list_(SPAN))


def find(docs: DataFrame, model: SkipChain) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs(doc_id, text)``: base spans, and these with what the
    field adds; arrays of (kind, start, end) by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, added = _searched(batch.column("text"), model)
            every = [sorted(b + a) for b, a in zip(bases, added)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "base": _as_structs(bases), "spans": _as_structs(every)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape_of = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {shape_of}, spans {shape_of}")


def masked(text: str, spans: list[Span]) -> str:
    """Every stretch that spans cover becomes the name of its first kind in brackets."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind]}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def masked_documents(docs: DataFrame, model: SkipChain) -> DataFrame:
    """``docs`` with all personal data masked; null texts and all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            bases, added = _searched(column, model)
            texts = [None if t is None else masked(t, sorted(b + a)) for t, b, a in zip(column.to_pylist(), bases, added)]
            at = batch.schema.get_field_index("text")
            yield pa.record_batch([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts per kind and a digest of the base spans; all spans as text."""

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
