from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.text import pieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reference_print(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_components(rows):
    prints = [reference_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return [(d, f"{p:016x}", least.get(top(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


EDGES = ["", None, "  \n", "A", "One TWO", "a  b\n\nC d É", "word " * 3000, "x" * 5000]


def test_prints(small_docs):
    texts = EDGES + [r.text for r in small_docs.limit(60).collect()]
    found = [int(p) for piece in pieces(pa.array(texts)) for p in simhash.piece_prints(piece)]
    assert found == [reference_print(t) for t in texts]


def test_every_error_pattern_has_its_remainder():
    table = simhash.error_patterns()
    assert len(set(table.tolist())) == 2048 and max(bin(p).count("1") for p in table.tolist()) == 3


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_close_prints_share_a_key(errors):
    rng = np.random.default_rng(errors)
    left = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    right = left.copy()
    for _ in range(errors):
        right ^= np.uint64(1) << rng.integers(0, 64, len(left), dtype=np.uint64)

    def keys(prints):
        place, key = simhash.golay_keys(prints)
        assert len(set(zip(place.tolist(), key.tolist()))) == len(key)
        return [set(key[place == i].tolist()) for i in range(len(prints))]

    assert all(a & b for a, b in zip(keys(left[:400]), keys(right[:400])))


def test_components_against_all_pairs(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    rows += [(1000 + i, t) for i, t in enumerate(EDGES)] + [(None, "alone and without id"), rows[3], rows[3]]
    rows += [(2000 + i, rows[5][1].replace("the", "a", i)) for i in range(12)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = got.select("doc_id", simhash.hex_print("print"), "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(reference_components(rows), key=str)


def test_one_per_group(make_docs):
    docs = make_docs((5, "a b c d"), (3, "A b  c d"), (3, "A b  c d"), (9, "something else here now"), (None, "a b c d"), (None, "z"))
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [
        (0, "a b c d"), (0, "z"), (3, "A b  c d"), (9, "something else here now")
    ]


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs()).count() == 0
    assert simhash.one_per_group(make_docs()).count() == 0


def test_radius_beyond_the_keys(make_docs):
    with pytest.raises(ValueError):
        simhash.near_duplicates(make_docs(), 3)
