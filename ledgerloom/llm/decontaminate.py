r"""Benchmark decontamination with a distributed positional inverted index.

Texts are lowered (A-Z) and split into words at ASCII characters other than letters
and digits. A window is ``WINDOW`` (10) consecutive words of a benchmark item; an item
with fewer words is one window.

1. The corpus counts of all test terms order the terms of each window by rarity; its
   rarest term is the window's seed.
2. The index stores, for every document, the postings (term, position) of test terms
   that lie near an occurrence of a seed. Nothing else can take part in a match.
3. Phrase matches: postings of the seed, shifted by its offset, are candidate starts;
   they are intersected with the shifted postings of the second rarest term and then
   of all others. Proximity matches ask for all terms of a window near the seed.

Distinct windows go through in blocks of at most ``BLOCK``, numbered by Spark, so what
is broadcast or collected (a block's terms and their counts) is bounded however large
the benchmark is, and every window is looked for in every document.

Defined cases: null text has no words; rows that repeat an id with the same text share
their result, with another text they keep their own; without benchmark words nothing
is contaminated; items with a null id count as the item ''.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import number_rows
from ledgerloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, BLOCK = 10, 100_000


def word_bytes() -> bytes:
    """Translation that lowers A-Z and turns every byte outside words into a blank."""
    table = bytearray(range(256))
    for b in range(128):
        kept = chr(b).isdigit() or chr(b).isalpha()
        table[b] = ord(chr(b).lower()) if kept else 0x20
    return bytes(table)


TABLE = word_bytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id string, phrase): the windows of every item; the words of a phrase are joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, phrases = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    items.append(item)
                    phrases.append(b" ".join(words[i : i + width]).decode())
            yield pa.record_batch({"item_id": pa.array(items, pa.string()), "phrase": pa.array(phrases, pa.string())})

    named = benchmark.select(F.ifnull(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(run, "item_id string, phrase string").distinct()


def term_counts(docs: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How often each of a block's terms occurs in all documents."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        known = wanted.value.__contains__
        for batch in batches:
            for text in batch.column("text"):
                seen.update(filter(known, words_of(text.as_py())))
        yield pa.record_batch({"term": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    partial = docs.select("text").mapInArrow(run, "term binary, n long")
    # At most WINDOW * BLOCK rows: a proven bound.
    return {bytes(r["term"]): r["n"] for r in partial.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def plan_block(phrases: list[tuple[int, str]], counts: dict[bytes, int]) -> tuple[dict[bytes, int], list[tuple]]:
    """Term ids, and (window, offset, term, rank, length) rows: rank 0 is a window's rarest term."""
    ids: dict[bytes, int] = {}
    rows = []
    for window, phrase in phrases:
        words = phrase.encode().split(b" ")
        order = sorted(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
        for rank, offset in enumerate(order):
            rows.append((window, offset, ids.setdefault(words[offset], len(ids)), rank, len(words)))
    return ids, rows


def document_key() -> Column:
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))


def build_index(docs: DataFrame, ids: dict[bytes, int], seeds: set[int], reach: int = WINDOW - 1) -> DataFrame:
    """(doc_id, doc_key, n_words, postings): term and place of test terms within ``reach`` words of a seed."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, frozenset(w for w, i in ids.items() if i in seeds)))
    postings = pa.struct([("term", pa.int32()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rare = shared.value
        for batch in batches:
            counts, found = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                counts.append(len(words))
                near: list[dict] = []
                done = 0
                if rare and not rare.isdisjoint(words):
                    for at in [i for i, w in enumerate(words) if w in rare]:
                        low, high = max(done, at - reach), min(len(words), at + reach + 1)
                        near += [{"term": terms[words[i]], "place": i} for i in range(low, high) if words[i] in terms]
                        done = max(done, high)
                found.append(near)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "doc_key": batch.column("doc_key"),
                    "n_words": pa.array(counts, pa.int64()),
                    "postings": pa.array(found, pa.list_(postings)),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", document_key().alias("doc_key"), "text").mapInArrow(
        run, f"doc_id {kind}, doc_key string, n_words long, postings array<struct<term:int,place:int>>"
    )


def _postings(index: DataFrame) -> DataFrame:
    return index.filter(F.size("postings") > 0).select("doc_key", F.inline("postings"))


def phrase_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_key, window, start, length): every occurrence of a window's words in their order.

    ``terms(window, offset, term, rank, length)`` is one block's, of bounded size.
    """
    lists = _postings(index)
    seeds = terms.filter("rank = 0")
    starts = lists.join(F.broadcast(seeds), "term").select(
        "doc_key", "window", (F.col("place") - F.col("offset")).alias("start"), "length"
    )
    starts = starts.filter("start >= 0").distinct()
    # The second rarest term first: most starts that are no match end here.
    for ranks, n in (("rank = 1", F.least(F.lit(1), F.col("length") - 1)), ("rank > 1", F.greatest(F.col("length") - 2, F.lit(0)))):
        wanted = starts.join(F.broadcast(terms.filter(ranks).select("window", "offset", "term")), "window")
        expected = wanted.withColumn("place", F.col("start") + F.col("offset"))
        met = expected.join(lists, ["doc_key", "term", "place"]).groupBy("doc_key", "window", "start", "length")
        together = met.agg(F.countDistinct("offset").alias("n")).filter(F.col("n") == n).drop("n")
        starts = together.unionByName(starts.filter(n == 0))
    return starts


def proximity_matches(index: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """(doc_key, window, place): seed occurrences with all of the window's terms within ``reach`` words.

    The index must have been built with at least that reach.
    """
    lists = _postings(index)
    seeds = lists.join(F.broadcast(terms.filter("rank = 0")), "term").select("doc_key", "window", F.col("place").alias("at"))
    all_terms = terms.select("window", "term").distinct()
    needed = all_terms.groupBy("window").agg(F.count(F.lit(1)).alias("needed"))
    wanted = seeds.distinct().join(F.broadcast(all_terms), "window")
    near = wanted.join(lists, ["doc_key", "term"]).filter(F.abs(F.col("place") - F.col("at")) <= reach)
    met = near.groupBy("doc_key", "window", "at").agg(F.countDistinct("term").alias("n"))
    return met.join(F.broadcast(needed), "window").filter("n = needed").select("doc_key", "window", F.col("at").alias("place"))


def search(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with doc_key and n_words, occurrences, windows with their items)."""
    spark = docs.sparkSession
    pairs = materialize(windows(benchmark, width), "windows")
    numbered = materialize(number_rows(pairs.select("phrase").distinct(), ["phrase"], "window"), "phrases")
    total = numbered.count()
    counted, found = None, []
    for low in range(0, max(total, 1), block):
        part = numbered.filter((F.col("window") >= low) & (F.col("window") < low + block))
        phrases = sorted((int(r["window"]), r["phrase"]) for r in part.collect())
        vocabulary = sorted({w for _, p in phrases for w in p.encode().split(b" ")})
        counts = term_counts(docs, vocabulary) if phrases else {}
        ids, rows = plan_block(phrases, counts)
        seeds = {term for _, _, term, rank, _ in rows if rank == 0}
        index = materialize(build_index(docs, ids, seeds, width - 1), "index")
        counted = counted if counted is not None else index.select("doc_id", "doc_key", "n_words")
        if rows:
            terms = spark.createDataFrame(rows, "window long, offset int, term int, rank int, length int")
            found.append(phrase_matches(index, terms))
    matches = found[0] if found else spark.createDataFrame([], "doc_key string, window long, start int, length int")
    for more in found[1:]:
        matches = matches.unionByName(more)
    items = pairs.join(numbered, "phrase").select("window", "item_id")
    return counted, materialize(matches, "matches"), items


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs(doc_id, text)``."""
    counted, matches, items = search(docs, benchmark, width)
    # Words covered by occurrences: each adds what reaches beyond all before it.
    spans = matches.groupBy("doc_key", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    earlier = Window.partitionBy("doc_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.ifnull(F.max("end").over(earlier), F.lit(0))
    new = spans.select("doc_key", F.greatest(F.col("end") - F.greatest(reached, F.col("start")), F.lit(0)).alias("new"))
    hit = new.groupBy("doc_key").agg(F.sum("new").alias("n_hit"))
    named = matches.select("doc_key", "window").distinct().join(items, "window").select("doc_key", "item_id").distinct()
    listed = named.groupBy("doc_key").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    joined = counted.join(hit.join(listed, "doc_key"), "doc_key", "left")
    n_hit = F.ifnull("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.ifnull(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def keep_unseen(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a benchmark window."""
    _, matches, _ = search(docs, benchmark, width)
    # Stored once per document, so that their own size, not that of all matches, decides whether the texts are shuffled.
    seen = materialize(matches.select(F.col("doc_key").alias("_seen")).distinct(), "seen")
    return docs.withColumn("_key", document_key()).join(seen, F.col("_key") == F.col("_seen"), "left_anti").drop("_key")
