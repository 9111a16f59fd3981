from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from ledgerloom.llm import spotsigs

HASHES = spotsigs.anchor_hashes()
ANCHORS = set(spotsigs.ANCHORS.split())


def chains(text):
    """Anchor with up to two following content words, for anchors followed by one at least."""
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", lowered)
    content = [w for w in words if w not in ANCHORS]
    found, before = set(), 0
    for w in words:
        if w not in ANCHORS:
            before += 1
        elif content[before:]:
            found.add((w, *content[before : before + spotsigs.CHAIN]))
    return found or {("whole", *words)} if words else {("bare", lowered)}


TEXTS = ["", " ", "!!", "the", "The cat", "cat the", "the the cat sat", "no anchors? yes anchors", "für die Katze", "a b c a b c", "x " * 20_000 + "the end"]


def test_signature_counts_and_likeness_follow_the_chains(small_docs):
    texts = TEXTS + [r.text for r in small_docs.limit(40).collect()]
    sets, expected = spotsigs.signatures(texts, HASHES), [chains(t) for t in texts]
    assert [len(s) for s in sets] == [len(e) for e in expected]
    assert all((np.diff(s.astype(np.int64)) > 0).all() for s in sets)
    for a, x in zip(sets, expected):
        for b, y in zip(sets[::3], expected[::3]):
            assert spotsigs.alike(a, b) == pytest.approx(len(x & y) / len(x | y))


@pytest.mark.parametrize("floor", [0.0, 0.3, 0.8, 1.0])
def test_pruned_comparison_agrees_above_its_floor(floor):
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 30, rng.integers(1, 30))).astype(np.uint32) for _ in range(2))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = spotsigs.alike(a, b, floor)
        assert found == pytest.approx(exact) if exact >= floor else found in (0.0, pytest.approx(exact))


def reference(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in ordered]
    out = []
    for i, (d, _) in enumerate(ordered):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        own, other, then = spotsigs.signatures([text, changed, following], HASHES)
        out.append(
            (d, len(text), hashlib.sha256(changed.encode()).hexdigest(), spotsigs.written(own), spotsigs.written(other),
             spotsigs.alike(own, other), spotsigs.alike(own, then))
        )
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions,coarse", [(4, 256), (4, 2), (40, 8)])
def test_neighbours_against_one_list(spark, small_docs, monkeypatch, partitions, coarse):
    monkeypatch.setattr(spotsigs, "COARSE", coarse)
    rows = [(r.doc_id * 3, r.text) for r in small_docs.limit(90).collect()]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(5000, None), (None, "b"), (None, "a"), (-4, "é" * 100)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = spotsigs.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, found), key=str) == reference(rows)


def test_few_rows_and_repeated_ids(make_docs):
    (row,) = spotsigs.compare_neighbours(make_docs((5, "the cat sat"))).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"the cat the").hexdigest()
    assert spotsigs.compare_neighbours(make_docs()).count() == 0
    found = spotsigs.compare_neighbours(make_docs((1, "a b"), (1, "a b"), (2, "c"), (1, "a a"))).collect()
    assert sorted(map(tuple, found), key=str) == reference([(1, "a b"), (1, "a b"), (2, "c"), (1, "a a")])


def test_near_documents_against_all_pairs(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.limit(120).collect()]
    rows += [(2000 + i, rows[i][1] + " and some more words") for i in range(20)] + [(3000, ""), (3001, None)]
    sets = spotsigs.signatures([t or "" for _, t in rows], HASHES)
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if spotsigs.alike(sets[i], sets[j]) >= 0.8:
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    found = spotsigs.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {d: least[top(i)] for i, (d, _) in enumerate(rows)}
