from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import graph as lines_graph
from ledgerloom.llm import lines
from ledgerloom.llm.text import hash_spans, majority_bits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.binary(max_size=24).map(lambda b: bytes(97 + x % 3 for x in b)), st.binary(max_size=24).map(lambda b: bytes(97 + x % 3 for x in b)))
@settings(max_examples=300, deadline=None)
def test_edit_similarity(a, b):
    longer = max(len(a), len(b))
    assert lines._distance(a, b) == distance(a, b)
    expected = longer == 0 or distance(a, b) <= int(0.2 * longer + 1e-9)
    assert lines.similar_lines(a, b) == expected


def normal(line):
    return b" ".join(re.findall(rb"[a-z\x80-\xff]+", line.encode().lower()))


def print_of(text):
    data = np.frombuffer(text, np.uint8)
    ends = np.cumsum([len(w) + 1 for w in text.split(b" ")]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return int(majority_bits(hash_spans(data, starts, ends), np.array([len(ends)]))[0])


def reference(rows):
    """(doc_id, lines, kept, dropped) by comparing all distinct lines."""
    found = [(d, i, n, normal(line)) for i, (d, t) in enumerate(rows) for n, line in enumerate((t or "").split("\n")) if t]
    found = [f for f in found if f[3]]
    texts = sorted({f[3] for f in found})
    prints = [print_of(t) for t in texts]
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and lines.similar_lines(texts[i], texts[j]):
                group[top(i)] = top(j)
    place = {t: top(i) for i, t in enumerate(texts)}
    seen, dropped = set(), {i: [] for i in range(len(rows))}
    for d, i, n, text in sorted(found, key=lambda f: (f[0] is None, f[0] or 0, f[1], f[2])):
        if place[text] in seen:
            dropped[i].append(n)
        seen.add(place[text])
    sizes = [len(t.split("\n")) if t else 0 for _, t in rows]
    return sorted(((d, s, s - len(dropped[i]), dropped[i]) for i, ((d, _), s) in enumerate(zip(rows, sizes))), key=str)


LONG = "the quick brown fox jumps over the lazy dog and runs away into the dark green forest where it sleeps until the morning comes"
CASES = [
    (1, f"{LONG}\nsecond line here\n\n***\nsecond, LINE 42 here!"),
    (2, f"{LONG.upper()} 17\nunique to two"),
    (3, LONG.replace("quick", "quik") + "\n" + LONG.replace("dog", "dogs")),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (6, "second line here"),
    (None, "unique to two\nanother line entirely"),
    (8, "w " * 20_000),
    (9, "w " * 20_000),
    (10, "é à ü"),
    (11, "É à ü\né à ü"),
]


def test_report_against_all_pairs(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").coalesce(1)
    found = [(r.doc_id, r.n_lines, r.n_kept, list(r.dropped)) for r in lines.dedup_report(docs).collect()]
    assert sorted(found, key=str) == reference(CASES)


@pytest.mark.parametrize("copies", [1, 2])
def test_report_on_the_small_table(spark, small_docs, copies):
    rows = [(r.doc_id, r.text) for r in small_docs.limit(70).collect()]
    rows += [(1000 + d, t) for d, t in rows] if copies == 2 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    found = [(r.doc_id, r.n_lines, r.n_kept, list(r.dropped)) for r in lines.dedup_report(docs).collect()]
    assert sorted(found, key=str) == reference(rows)


def test_documents_keep_their_columns(make_docs):
    docs = make_docs((1, "one line\nand two"), (2, "One line\nthree"), (3, None)).withColumnRenamed("lang", "key")
    found = lines.deduped_documents(docs)
    assert found.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, "one line\nand two"), (2, "three"), (3, None)]


def test_empty_table(make_docs):
    assert lines.dedup_report(make_docs()).count() == 0


def test_bounded_distance_stops_early_and_decides_alike():
    """The shared ends are found without a loop over bytes; a distance beyond the bound is not worked out to its end."""
    rng = random.Random(3)
    for _ in range(400):
        a = bytes(rng.choices(b"abc", k=rng.randint(0, 30)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 9)):
            place = rng.randint(0, len(b))
            b[place : place + rng.randint(0, 2)] = bytes(rng.choices(b"abc", k=rng.randint(0, 2)))
        b, true = bytes(b), lines._distance(a, bytes(b))
        for most in (0, 2, 5):
            bounded = lines._distance(a, b, most)
            assert bounded == true if true <= most else bounded > most
        longer = max(len(a), len(b))
        assert lines.similar_lines(a, b) == (true <= int((1.0 - lines.SIMILARITY) * longer + 1e-9))
        low = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        high = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
        assert (lines._agreement(a, b, "little"), lines._agreement(a, b, "big")) == (low, high)


def test_alignment_by_words_is_never_below_the_distance():
    rng = random.Random(5)
    words = [bytes(rng.choices(b"ab", k=rng.randint(0, 4))) for _ in range(6)]
    for _ in range(600):
        a = rng.choices(words, k=rng.randint(0, 9))
        b = [w for w in a if rng.random() < 0.8] + rng.choices(words, k=rng.randint(0, 3))
        a, b = b" ".join(a), b" ".join(b)
        bound = lines._by_words(a, b, float("inf"))
        assert bound >= distance(a, b)
        assert (bound == 0) == (a == b)
        assert (lines._by_words(a, b, 4) <= 4) == (bound <= 4)
    text = b" ".join(b"word%d" % i for i in range(200))
    assert lines._by_words(text, text.replace(b"word50 ", b"").replace(b"word90 ", b"other thing "), 99) <= 21
    assert lines._by_words(b"one two three", b"two one three", 99) == 8


def test_large_groups_are_compared_by_blocks(spark, monkeypatch):
    """Chained fingerprints make one candidate group of many classes; no bucket of texts may hold it all."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(12)]
    rows = [(i, " ".join([*words, *rng.sample(words, 3)])) for i in range(60)] + [(60 + i, " ".join(rng.sample(words, 8))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    expected, sizes, linked = reference(rows), [], lines.bucket_links

    def counted(members, bucket, *rest):
        if "normal" in members.columns:
            sizes.extend(r["count"] for r in members.groupBy(bucket).count().collect())
        return linked(members, bucket, *rest)

    monkeypatch.setattr(lines, "GROUP", 2)
    monkeypatch.setattr(lines, "bucket_links", counted)
    for finer in (1024, 3):
        monkeypatch.setattr(lines_graph, "FINER", finer)
        found = [(r.doc_id, r.n_lines, r.n_kept, list(r.dropped)) for r in lines.dedup_report(docs).collect()]
        assert sorted(found, key=str) == expected
    assert any(f[3] for f in expected) and max(sizes) < 60


def test_parts_keep_close_prints_together(spark):
    """Two fingerprints within the radius that share a pair of blocks share a finer bucket too."""
    rng = random.Random(13)
    rows = []
    for i in range(200):
        one = rng.getrandbits(64)
        other = one
        for bit in rng.sample(range(64), lines.RADIUS):
            other ^= 1 << bit
        rows += [(i, v - (1 << 64) if v >> 63 else v) for v in (one, other)]
    pairs = lines.block_pairs(spark.createDataFrame(rows, "pair long, print long"))
    met = {(r.pair, r.bucket) for r in pairs.groupBy("pair", "bucket").count().filter("count = 2").collect()}
    parts = lines.block_parts(pairs).groupBy("pair", "bucket").count().filter("count = 2").collect()
    assert {p for p, _ in met} == set(range(200))
    # The pair of blocks leads the number of the finer bucket.
    assert met == {(r.pair, r.bucket >> (lines.PART + 2)) for r in parts}
    ends = {i: np.array([v], np.int64).view(np.uint64) for i, v in rows[::2]}
    others = {i: np.array([v], np.int64).view(np.uint64) for i, v in rows[1::2]}
    for shared in (met, {(r.pair, r.bucket) for r in parts}):
        first = [i for i, b in shared if lines.first_meeting(np.array([b]), ends[i] ^ others[i])[0]]
        assert len(first) >= 200 and set(first) == set(range(200))
        assert shared is not met or len(first) == 200
    last = [(i, b) for i, b in {(r.pair, r.bucket) for r in parts} if lines.first_meeting(np.array([b]), ends[i] ^ others[i])[0]]
    assert len(last) == 200


def test_letters_never_reject_similar_texts():
    rng = random.Random(17)
    texts = [bytes(rng.choices(b"abcd \xc3\xa9", k=rng.randint(1, 12))) for _ in range(60)]
    left, right = map(np.array, zip(*[(i, j) for i in range(60) for j in range(60)]))
    may = lines.may_be_similar(lines.letter_counts(np.array(texts, object)), left, right)
    similar = np.array([lines.similar_lines(texts[i], texts[j]) for i, j in zip(left, right)])
    assert not (similar & ~may).any() and not may.all()
