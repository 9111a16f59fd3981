from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.text import BLANK, find_words, hash_spans, hash_text, majority_bits, pieces, squeeze, xxh64_spans

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té☃Z", max_size=40)), max_size=8)


@given(texts, st.integers(1, 30))
@settings(max_examples=150, deadline=None)
def test_words_of_every_document(rows, size):
    found = {}
    for piece in pieces(pa.array(rows, pa.string()), size):
        words = find_words(piece, BLANK)
        for start, end, row in zip(words.starts, words.ends, words.row):
            found.setdefault(piece.first + row, []).append(piece.data[start:end].tobytes().decode())
    assert found == {i: w for i, t in enumerate(rows) if (w := re.findall(r"[^\x20\x09-\x0D]+", t or ""))}


@given(texts)
@settings(max_examples=100, deadline=None)
def test_squeezed_words_have_one_blank_between(rows):
    for piece in pieces(pa.array(rows, pa.string())):
        words = find_words(piece, BLANK)
        data, starts, ends = squeeze(piece, words)
        kept = [piece.data[i:j].tobytes() for i, j in zip(words.starts, words.ends)]
        assert [data[i:j].tobytes() for i, j in zip(starts, ends)] == kept
        assert data.tobytes() == b"".join(w + b" " for w in kept)


@given(st.binary(max_size=200), st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_xxh64_of_spans(data, spans):
    spans = [(min(a, b, len(data)), min(max(a, b), len(data))) for a, b in spans]
    array = np.frombuffer(data, np.uint8)
    starts, ends = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    assert xxh64_spans(array, starts, ends, 42).tolist() == [xxhash.xxh64_intdigest(data[i:j], 42) for i, j in spans]


def test_equal_spans_have_equal_hashes():
    data = np.frombuffer(b"one two one", np.uint8)
    one, two, again = hash_spans(data, np.array([0, 4, 8]), np.array([3, 7, 11])).tolist()
    assert one == again == hash_text("one") != two


@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=600), max_size=5))
@settings(max_examples=30, deadline=None)
def test_majority_bits(groups):
    flat = np.array([h for g in groups for h in g], np.uint64)
    expected = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in g) > len(g)) for g in groups]
    assert majority_bits(flat, np.array([len(g) for g in groups], np.int64)).tolist() == expected
