from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import queries, runs


def all_runs(words: list) -> list[tuple[int, int, int]]:
    """Every period, every stretch of equal pairs: (start, length, period)."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rnd: random.Random) -> list[bytes]:
    kinds = rnd.choice([1, 2, 3, 5, 40])
    words = [b"%d" % rnd.randrange(kinds) for _ in range(rnd.randint(0, 150))]
    for _ in range(rnd.randint(0, 3)):
        if len(words) > 3:
            a = rnd.randrange(len(words))
            p = rnd.randint(1, max(1, (len(words) - a) // 3))
            for i in range(a, rnd.randint(a, len(words))):
                words[i] = words[a + (i - a) % p]
    return words


def test_runs_of_random_words():
    rnd = random.Random(5)
    documents = [random_words(rnd) for _ in range(1200)]
    # Together, so that segments of neighbouring documents have to be told apart.
    found = runs.runs_of(documents)
    assert [[tuple(r) for r in f.tolist()] for f in found] == [all_runs(d) for d in documents]
    assert sum(map(len, found)) > 400


@pytest.mark.parametrize("text", ["abracadabra" * 3, "aaaa", "mississippi", "a", "ab" * 40 + "c" + "ab" * 40])
def test_extensions(text):
    symbols = runs.np.array([ord(c) - ord("a") + 1 for c in text])
    tree = runs.SuffixTree(symbols, 28)
    pairs = [(i, j) for i in range(len(text)) for j in range(i + 1, len(text))]
    expected = []
    for i, j in pairs:
        k = 0
        while j + k < len(text) and text[i + k] == text[j + k]:
            k += 1
        expected.append(k)
    if pairs:
        i, j = runs.np.array(pairs).T
        assert tree.extension(i, j).tolist() == expected
    suffixes = sorted(range(len(text)), key=lambda s: text[s:])
    assert [int(tree.rank[s]) for s in suffixes] == list(range(1, len(text) + 1))


def test_range_minimum():
    rnd = random.Random(2)
    values = runs.np.array([rnd.randrange(1000) for _ in range(777)], dtype=runs.np.int32)
    pairs = runs.np.array([sorted((rnd.randrange(777), rnd.randrange(777))) for _ in range(3000)])
    least = runs.RangeMinimum(values).least(pairs[:, 0], pairs[:, 1])
    assert least.tolist() == [int(values[a : b + 1].min()) for a, b in pairs]


def test_very_long_text():
    rnd = random.Random(3)
    words = [b"w%d" % rnd.randrange(200) for _ in range(15_000)]
    words += [b"x", *[b"p%d" % (i % 4_000) for i in range(60_000)], b"y", *words[:5]]
    assert runs.runs_of([words])[0].tolist() == [[15_001, 60_000, 4_000]]


def test_defined_cases(make_docs):
    line = " ".join(["over and over again "] * 12)
    docs = make_docs((1, None), (2, ""), (3, " \t\n"), (4, line), (4, line), (None, line), (5, "x " * 23), (6, "x " * 24))
    found = {}
    for r in runs.find(docs).collect():
        found.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert found[1] == found[2] == found[3] == [([], "")]
    once = ([(0, 48, 4)], "over and over again ")
    assert found[4] == [once, once] and found[None] == [once]
    assert found[5] == [([], " ".join("x" * 23))] and found[6] == [([(0, 24, 1)], "x")]
    assert runs.find(docs.limit(0)).count() == 0 and runs.digests(runs.find(docs.limit(0))).count() == 0


def test_other_columns_are_kept(spark):
    docs = spark.createDataFrame(
        [(1, 7, "a " * 30, {"k": 1}), (None, None, None, None)], "doc_id long, runs long, text string, collapsed map<string,int>"
    )
    kept = runs.collapsed_documents(docs)
    assert kept.schema == docs.schema
    assert {tuple(map(str, r)) for r in kept.collect()} == {("1", "7", "a", "{'k': 1}"), ("None", "None", "", "None")}


def test_query_against_every_pair(spark, small_dir, small_docs):
    """The whole query, edit and digests included, against plain Python."""
    rows = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, small_dir).collect()}
    some = 0
    for doc in small_docs.select("doc_id", "text").collect():
        words = (doc.text or "").encode().split()
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
        expected = all_runs(words)
        some += bool(expected)
        row = rows[doc.doc_id]
        assert row.n_runs == len(expected)
        best = max(expected, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if expected else None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in expected)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        gone = {i for s, length, q in expected for i in range(s + q, s + length)}
        collapsed = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert row.collapsed_sha256 == hashlib.sha256(collapsed).hexdigest()
    assert some > 5 and len(rows) == small_docs.count()
