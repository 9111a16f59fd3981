from __future__ import annotations

import hashlib
import re

import pytest

from ledgerloom.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def reference(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    sizes = {len(p) for p in windows}
    out = []
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    found |= owners
                    hit.update(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


PASSAGE = "Alpha beta, gamma delta-epsilon zeta eta theta iota kappa lambda MU nu"
ITEMS = [(1, PASSAGE), (2, "short item"), (10, "the the the the the the the the the the"), (3, None), (4, "?!"), (None, "naïve café 42"), (7, "short item")]
DOCS = [
    (1, PASSAGE), (2, "x " + PASSAGE.upper() + " y"), (3, "alpha beta gamma delta epsilon zeta eta theta iota other"), (4, None), (5, ""),
    (6, "a short\nitem here, SHORT item"), (7, "the " * 25), (8, "the " * 9), (9, "naïve café 42 Naïve"), (9, PASSAGE), (9, PASSAGE),
    (None, "short item"), (11, ("beta gamma " * 4000) + PASSAGE), (12, PASSAGE + " " + PASSAGE), (13, "shortitem"),
]


@pytest.mark.parametrize("block", [100_000, 3])
def test_report_against_brute_force(spark, block, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    monkeypatch.setattr(decontaminate.search, "__defaults__", (decontaminate.WINDOW, block))
    assert sorted(map(tuple, decontaminate.report(docs, items).collect()), key=str) == reference(DOCS, ITEMS)


def test_small_table(spark, small_dir, small_docs):
    items = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    expected = reference([(r.doc_id, r.text) for r in small_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(e[-1] for e in expected)
    assert sorted(map(tuple, decontaminate.report(small_docs, items).collect()), key=str) == expected


def test_documents_without_benchmark_words(make_docs):
    docs = make_docs(*[d for d in DOCS if d[0] in (2, 4, 5, 8)]).withColumnRenamed("lang", "doc_key").withColumnRenamed("source", "place")
    items = make_docs(*ITEMS).withColumnRenamed("doc_id", "item_id")
    kept = decontaminate.keep_unseen(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 8]


def test_empty_tables(make_docs):
    items = make_docs(*ITEMS).withColumnRenamed("doc_id", "item_id")
    assert decontaminate.report(make_docs(), items).count() == 0
    found = decontaminate.report(make_docs((1, "a b")), items.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in found] == [(2, 0, False)]


def test_proximity(spark, make_docs):
    phrases = [(0, "red green blue"), (1, "red yellow")]
    ids, rows = decontaminate.plan_block(phrases, {b"red": 9, b"green": 1, b"blue": 5, b"yellow": 2})
    terms = spark.createDataFrame(rows, "window long, offset int, term int, rank int, length int")
    docs = make_docs((1, "blue x green x red"), (2, "green x x x x x x blue red"), (3, "yellow RED green"), (4, None))
    seeds = {term for _, _, term, rank, _ in rows if rank == 0}
    index = decontaminate.build_index(docs, ids, seeds, 3)
    found = decontaminate.proximity_matches(index, terms, 3).join(index, "doc_key").select("doc_id", "window", "place")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2), (3, 1, 0)]
    assert decontaminate.phrase_matches(index, terms).count() == 0
