from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerloom.llm import copies
from ledgerloom.llm.simhash import RADIUS, fingerprints


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def survivors(rows):
    """First row of each component, by comparing all pairs."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) < 0.8 * max(len(a), len(b)) - 1e-9:
                continue
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                near += a != b
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return [rows[i] for i in range(len(rows)) if top(i) == i], near


def changed(text, share, rng):
    words = text.split()
    for i in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = f"other{rng.randrange(10**6)}"
    return " ".join(words)


def test_all_near_copies_of_the_stage(make_docs, spark, small_docs):
    """Every pair at or above the bound is found, from a changed word in 40 to one in a long text."""
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    long = [(d, t) for d, t in rows if len(t.split()) >= 40]
    rows += [(10_000 + 1000 * k + d, changed(t, share, rng)) for k, share in enumerate((0.0, 0.01, 0.02, 0.025)) for d, t in long]
    expected, near = survivors(rows)
    assert near > 300
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    found = stage(spark, make_docs(*rows), "")
    assert found.columns == small_docs.columns
    assert sorted(r.doc_id for r in found.collect()) == sorted(d for d, _ in expected)


def test_repeated_and_absent_ids(make_docs):
    text = "one two three four five six seven eight nine ten"
    docs = make_docs((3, text), (3, "something quite different under the same id"), (3, text), (5, text.upper()), (None, text),
                     (None, "alone"), (None, "alone"), (7, None), (8, " "), (None, ""))
    kept = sorted(((r.doc_id, r.text) for r in copies.one_per_group(docs).collect()), key=str)
    assert kept == sorted([(3, text), (3, "something quite different under the same id"), (None, "alone"), (7, None)], key=str)


def test_empty_table(make_docs):
    assert copies.one_per_group(make_docs()).count() == 0


def test_fingerprints_bring_candidates(make_docs, spark, monkeypatch):
    """Without any band a pair of near fingerprints is still found, and checked by its similarity."""
    monkeypatch.setattr(copies, "band_keys", lambda classes: classes.select(F.col("key").alias("bucket"), "key").limit(0))
    base = " ".join([f"w{i}" for i in range(400)] * 30)
    near, far = (f"{base} {' '.join(f't{i}' for i in range(n))}" for n in (60, 150))
    docs = make_docs((1, base), (2, near), (3, far), (4, "a text of its own that nobody else has written"))
    prints = [r.print for r in fingerprints(docs).orderBy("doc_id").collect()]
    assert all(((prints[0] ^ p) & (2**64 - 1)).bit_count() <= RADIUS for p in prints[1:3])
    # 400 of 460 shingles in common, but only 400 of 550; the second and third have 460 of 550.
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs.filter("doc_id <> 3"), "").collect()) == [1, 4]
    assert sorted(r.doc_id for r in stage(spark, docs.filter("doc_id <> 2"), "").collect()) == [1, 3, 4]
