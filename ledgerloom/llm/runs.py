r"""Periodic runs of words, by longest common extensions in suffix trees.

A text is its words ``[^\x20\x09-\x0D]+``. A run is a stretch of words with smallest
period q and a length of at least max(``LEAST_WORDS``, ``LEAST_TURNS`` * q) that keeps
period q with neither neighbour. Every document is worked through in its task:

1. *Places to look at.* In a run all but the last q + ``GRAM`` - 1 words start a gram of
   ``GRAM`` words that returns q words on, and these places are neighbours. Stretches of
   places whose grams return, if long enough, and as many words behind them as a run
   could still hold, are the segments; a run and its neighbours lie in one segment, so
   nothing is lost. A text in which no gram returns has none.
2. *Trees.* Ukkonen's algorithm builds the suffix tree of a segment and of its reversal.
   The string depth of two leaves' lowest common ancestor is their longest common
   extension; it is the least depth between the leaves' places in an Euler tour, read in
   constant time from minima of blocks (prefix, suffix, doubling table between blocks).
3. *Candidates.* The leaves' order ranks the suffixes. From each place the longest Lyndon
   word, for the order of words and for its reverse, ends where the next smaller (greater)
   suffix starts. Every run holds such a word as its root, so the extension of each
   candidate (place, root length) to the right and to the left gives all runs, and no
   candidate has a period that is not the smallest.

``collapse`` drops what any run repeats: its words after the first q.

Time and memory are linear in the words of a document (about 1 kB per word of a segment
while its trees are built); documents never meet, so there is no shuffle, and a lost task
is simply run again. Defined cases: null and blank texts have no words, no runs and an
empty collapsed text; rows that repeat an id, and ties, are rows like all others; a
document of any length is looked at whole; an empty table gives an empty result; all other
columns are kept, whatever their names, by ``collapsed_documents``, and left out by ``find``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_WORDS, LEAST_TURNS = 24, 3
#: Words of a gram. Smaller than what every run repeats: two thirds of LEAST_WORDS.
GRAM = 8
#: Words of whole documents that are looked at together.
PIECE_WORDS = 1 << 20
#: Places in a block of the range minimum.
BLOCK = 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """Longest common extensions of a string of symbols 1 .. ``width`` - 1."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.size = len(symbols)
        # The end mark 0 occurs once, so every suffix has a leaf.
        self._grow([*symbols.tolist(), 0], width)
        self._tour()

    def _grow(self, text: list[int], width: int) -> None:
        """Ukkonen's construction: one active place, open leaves, suffix links.

        The edge into node v reads ``text[start[v]:stop[v]]``; all edges are in one
        dictionary, keyed by node and first symbol.
        """
        total = len(text)
        start, stop, link, below = [0], [0], [0], {}
        node = edge = length = waiting_leaves = 0
        for i, symbol in enumerate(text):
            waiting_leaves += 1
            unlinked = 0
            while waiting_leaves:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = below.get(key)
                if child is None:
                    below[key] = len(start)
                    start.append(i)
                    stop.append(total)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    begin = start[child]
                    span = min(stop[child], i + 1) - begin
                    if length >= span:
                        # Walk down: the active place lies beyond this edge.
                        edge += span
                        length -= span
                        node = child
                        continue
                    middle = begin + length
                    if text[middle] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner, leaf = len(start), len(start) + 1
                    start += [begin, i]
                    stop += [middle, total]
                    link += [0, 0]
                    start[child] = middle
                    below[key] = inner
                    below[inner * width + text[middle]] = child
                    below[inner * width + symbol] = leaf
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                waiting_leaves -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting_leaves + 1
        keys = np.fromiter(below.keys(), np.int64, len(below))
        order = np.argsort(keys)
        self.children = np.fromiter(below.values(), np.int64, len(below))[order]
        counts = np.bincount(keys // width, minlength=len(start))
        self.last = np.cumsum(counts)
        self.first = self.last - counts
        self.edge = np.array(stop) - np.array(start)

    def _tour(self) -> None:
        """Euler tour of string depths; where it meets the leaf of every suffix; the suffixes in order."""
        children, following, last, edge = self.children.tolist(), self.first.tolist(), self.last.tolist(), self.edge.tolist()
        above, depth = [0] * len(edge), [0] * len(edge)
        leaf, tour, node, total = [0] * (self.size + 1), [0], 0, self.size + 1
        order = []
        while True:
            place = following[node]
            if place < last[node]:
                following[node] = place + 1
                child = children[place]
                depth[child] = reached = depth[node] + edge[child]
                above[child] = node
                node = child
                if following[node] == last[node]:
                    leaf[total - reached] = len(tour)
                    order.append(total - reached)
                tour.append(reached)
            elif node:
                node = above[node]
                tour.append(depth[node])
            else:
                break
        self.leaf = np.array(leaf)
        self.rank = np.empty(total, np.int64)
        self.rank[order] = np.arange(total)
        self.minima = RangeMinimum(np.array(tour, np.int32))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes from i and from j (another place) have in common."""
        a, b = self.leaf[i], self.leaf[j]
        return self.minima.least(np.minimum(a, b), np.maximum(a, b))


class RangeMinimum:
    """Least value between two places in constant time and linear memory."""

    def __init__(self, values: np.ndarray):
        padded = np.full(-(-len(values) // BLOCK) * BLOCK, values.max(), values.dtype)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, BLOCK)
        self.values = padded
        self.until = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(blocks):
            reach, before = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(before[:-reach], before[reach:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For low <= high, both inclusive."""
        left, right = low // BLOCK, high // BLOCK
        out = np.minimum(self.since[low], self.until[high])
        near = np.flatnonzero(left == right)
        if len(near):
            inside = self.values[low[near]]
            for step in range(1, BLOCK):
                inside = np.minimum(inside, self.values[np.minimum(low[near] + step, high[near])])
            out[near] = inside
        wide = np.flatnonzero(right - left > 1)
        if len(wide):
            a, b = left[wide] + 1, right[wide] - 1
            level = np.frexp(b - a + 1)[1] - 1
            for k in np.unique(level).tolist():
                at = level == k
                both = np.minimum(self.table[k][a[at]], self.table[k][b[at] - (1 << k) + 1])
                out[wide[at]] = np.minimum(out[wide[at]], both)
        return out


def next_below(values: list[int]) -> list[int]:
    """For every place the next one with a smaller value; the length if there is none."""
    found, waiting = [len(values)] * len(values), []
    for i, value in enumerate(values):
        while waiting and values[waiting[-1]] > value:
            found[waiting.pop()] = i
        waiting.append(i)
    return found


def segment_runs(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) rows of all runs of a string, by start, then period."""
    n = len(symbols)
    known, coded = np.unique(symbols, return_inverse=True)
    coded = coded + 1
    forward, backward = (SuffixTree(s, len(known) + 1) for s in (coded, coded[::-1]))
    rank = forward.rank[:n]
    place = np.arange(n)
    found = []
    for order in (rank, -rank):
        period = np.array(next_below(order.tolist())) - place
        inner = place + period < n
        i, p = place[inner], period[inner]
        right = forward.extension(i, i + p)
        left = np.zeros(len(i), np.int64)
        some = i > 0
        left[some] = backward.extension(n - i[some], n - i[some] - p[some])
        length = left + p + right
        good = length >= np.maximum(LEAST_WORDS, LEAST_TURNS * p)
        found.append(np.stack([(i - left)[good], length[good], p[good]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def segments(ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """(low, high) of the stretches that may hold runs; each lies in one document.

    ``ids`` are the words of several documents, document d at ``offsets[d]:offsets[d + 1]``.
    """
    count = len(ids) - GRAM + 1
    if count <= 0:
        return []
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    words = mix(ids.astype(np.uint64) + np.uint64(1))
    gram = mix(document[:count].astype(np.uint64) + np.uint64(1 << 40))
    for k in range(GRAM):
        gram = mix(gram + words[k : k + count])
    # A gram that reaches into the next document differs from all others.
    within = document[:count] == document[GRAM - 1 :]
    places = np.flatnonzero(within)
    order = places[np.argsort(gram[places], kind="stable")]
    returns = np.zeros(count + 2, bool)
    returns[1:-1][order[:-1]] = gram[order[:-1]] == gram[order[1:]]
    edges = np.flatnonzero(np.diff(returns.astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    # What a run of q <= length / LEAST_TURNS and LEAST_WORDS or more leaves after q + GRAM - 1 words.
    least = min(max(LEAST_WORDS, LEAST_TURNS * q) - q - GRAM + 1 for q in range(1, LEAST_WORDS))
    long_enough = ends - begins >= least
    out: list[tuple[int, int]] = []
    for low, high in zip(begins[long_enough].tolist(), ends[long_enough].tolist()):
        d = document[low]
        period = (high - low + GRAM) // (LEAST_TURNS - 1) + 1
        low, high = max(int(offsets[d]), low - 1), min(int(offsets[d + 1]), high + period + GRAM + 1)
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def runs_of(documents: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each document, given as lists of words."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in documents for w in words), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(words) for words in documents], dtype=np.int64)])
    found: list[list[np.ndarray]] = [[] for _ in documents]
    for low, high in segments(ids, offsets):
        runs = segment_runs(ids[low:high])
        if len(runs):
            d = int(np.searchsorted(offsets, low, "right")) - 1
            runs[:, 0] += low - offsets[d]
            found[d].append(runs)
    return [np.concatenate(parts) if parts else np.zeros((0, 3), np.int64) for parts in found]


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run repeats, joined by one blank."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
    return b" ".join(words).decode()


def _worked(column: pa.Array) -> Iterator[tuple[np.ndarray, str]]:
    """Runs and collapsed text of every row, a bounded number of words at a time."""
    waiting: list[list[bytes]] = []
    held = 0
    for text in column:
        # bytes.split() parts at exactly the ASCII white space.
        waiting.append((text.as_py() or "").encode().split())
        held += len(waiting[-1])
        if held >= PIECE_WORDS:
            yield from ((r, collapse(w, r)) for w, r in zip(waiting, runs_of(waiting)))
            waiting, held = [], 0
    yield from ((r, collapse(w, r)) for w, r in zip(waiting, runs_of(waiting)))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of ``docs(doc_id, text)``; runs by start, then period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, collapsed = [], []
            for found, text in _worked(batch.column("text")):
                runs.append([dict(zip(RUN.names, row)) for row in found.tolist()])
                collapsed.append(text)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "runs": pa.array(runs, pa.list_(RUN)),
                    "collapsed": pa.array(collapsed, pa.string()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = "array<struct<start:long,length:long,period:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs {shape}, collapsed string")


def collapsed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every text collapsed; all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([text for _, text in _worked(batch.column("text"))], pa.string())
            at = batch.schema.get_field_index("text")
            yield pa.record_batch([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def with_cycles(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where in one of ten documents, drawn by the id's crc32, the words from some place on cycle."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    drawn = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    split = drawn.withColumn("w", F.when(F.col("g").isNotNull(), words)).withColumn("n", F.size("w").cast("long"))
    first = F.col("g") % F.col("n")
    placed = split.withColumn("a", F.when(F.col("n") > 0, first))
    turn = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    cycled = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    text = F.when(F.col("a").isNotNull(), F.array_join(cycled, " ")).otherwise(F.col("text"))
    return placed.withColumn("p", turn).select("doc_id", text.alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; ties: smallest start, then period. Null without runs."""

    def better(a: Column, b: Column) -> Column:
        mine, other = a.length * b.period, b.length * a.period
        return F.when(
            b.isNull() | (mine > other) | ((mine == other) & (F.struct(a.start, a.period) < F.struct(b.start, b.period))), a
        ).otherwise(b)

    shape = "struct<start:long,length:long,period:long>"
    return F.reduce(runs, F.lit(None).cast(shape), lambda best, run: better(run, best))


def digests(found: DataFrame) -> DataFrame:
    """One row per row of ``find``: number of runs, the strongest, and digests of runs and text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
