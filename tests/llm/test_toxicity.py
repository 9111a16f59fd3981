"""The toxicity model against the formulas over plain dictionaries."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import toxicity
from ledgerloom.llm.text import hash_text, pieces
from ledgerloom.session import materialize

EDGE = "\n"


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[a-z0-9\x80-߿]+|[ࠀ-\U0010ffff]", lowered)


def plain_pairs(text):
    words = plain_words(text)
    return list(zip([EDGE, *words[:-1]], words))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9é ж漢😀.\n", max_size=12)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    for piece in pieces(pa.array(texts, pa.string())):
        words, before, rows = toxicity.word_stream(piece)
        expected = [(i, v, w) for i, t in enumerate(texts) for v, w in plain_pairs(t)]
        assert rows.tolist() == [i for i, _, _ in expected]
        assert words.tolist() == [hash_text(w) for _, _, w in expected]
        assert before.tolist() == [int(toxicity.BOUNDARY) if v == EDGE else hash_text(v) for _, v, _ in expected]


class Plain:
    """Both class models, counted and worked out with dictionaries."""

    def __init__(self, rows):
        self.pairs = [Counter(), Counter()]
        for label, text in rows:
            self.pairs[label].update(set(plain_pairs(text)))
        self.words = [Counter(w for _, w in pairs) for pairs in self.pairs]
        self.vocabulary = set(self.words[0]) | set(self.words[1])
        sizes = [sum(c.values()) + 1 for c in self.words]
        self.part = [n / sum(sizes) for n in sizes]

    @staticmethod
    def cut(counts):
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.75

    @staticmethod
    def left(own, both, cut, least):
        """What of a count stays with its gram."""
        return 0.0 if both < least else max(own - cut, 0.0)

    def word(self, k, w):
        counts, cut = self.words[k], self.cut(self.words[k])
        kept = {v: self.left(n, self.words[0][v] + self.words[1][v], cut, toxicity.WORD_MIN) for v, n in counts.items()}
        size = len(self.vocabulary) + 1
        shared = toxicity.SHARED_COUNT * size * self.part[k]
        spread = sum(counts.values()) - sum(kept.values()) + shared
        return (kept.get(w, 0.0) + spread / size) / (sum(counts.values()) + shared)

    def pair(self, k, v, w):
        after = {x: n for (u, x), n in self.pairs[k].items() if u == v}
        cut = self.cut(self.pairs[k])
        kept = {x: self.left(n, self.pairs[0][v, x] + self.pairs[1][v, x], cut, toxicity.PAIR_MIN) for x, n in after.items()}
        some = toxicity.CONTEXT_COUNT * self.part[k]
        spread = sum(after.values()) - sum(kept.values()) + some
        return (kept.get(w, 0.0) + spread * self.word(k, w)) / (sum(after.values()) + some)

    def ratio(self, v, w):
        return math.log(self.pair(1, v, w) / self.pair(0, v, w))


def sample(seed, n):
    rng = np.random.default_rng(seed)
    words = "the river of stone house ä 漢 x1 zorp".split()
    out = []
    for i in range(n):
        row = rng.choice(words, rng.integers(0, 9)).tolist() + [f"once{i}"] * (i % 5 == 0)
        out.append((int("zorp" in row and i % 3 > 0), " ".join(row)))
    return out


@pytest.mark.parametrize("n", [0, 3, 60])
def test_ratios_follow_the_formula(spark, n):
    rows = sample(1, n)
    labelled = spark.createDataFrame(rows + [(0, None), (1, "")], "label int, text string").repartition(3)
    table, unseen = toxicity.gram_table(materialize(toxicity.pair_counts(labelled), "pairs"))
    grams = toxicity.load(table, unseen).whole.value
    plain = Plain(rows)
    texts = [t for _, t in rows] + ["the new river", "stone stone of漢漢", "never seen words"]
    for piece in pieces(pa.array(texts)):
        words, before, _ = toxicity.word_stream(piece)
        found = grams.stream(words, before) / toxicity.UNIT
        expected = [plain.ratio(v, w) for t in texts for v, w in plain_pairs(t)]
        assert found == pytest.approx(expected, abs=3 / toxicity.UNIT)


def test_classes_are_distributions():
    plain = Plain(sample(2, 60))
    some = sorted(plain.vocabulary)
    for k in (0, 1):
        # One share of the vocabulary is left to all words never seen.
        assert sum(plain.word(k, w) for w in [*some, "unseen"]) == pytest.approx(1.0)
        for v in (EDGE, "the", "unseen"):
            assert sum(plain.pair(k, v, w) for w in [*some, "unseen"]) == pytest.approx(1.0)


def test_features():
    rng = np.random.default_rng(0)
    texts = ["the cat sat on the mat", "a", "", None, "?!", "the cat"]
    keys = np.array(sorted({hash_text(w) for t in texts for w in plain_words(t)}), np.uint64).view(np.int64)
    ratios = rng.integers(-90_000, 90_000, len(keys)).astype(np.int32)
    grams = toxicity.Grams.of(keys, ratios, np.zeros(len(keys), np.int32), 7)
    value = dict(zip(keys.view(np.uint64).tolist(), ratios.tolist()))
    found = grams.features(pa.array(texts, pa.string()))
    for text, row in zip(texts, found):
        own = np.array([value[hash_text(w)] for w in plain_words(text)]) / toxicity.UNIT
        stretches = [own[max(0, i + 1 - toxicity.STRETCH) : i + 1].sum() / toxicity.STRETCH for i in range(len(own))]
        assert row == pytest.approx([max(stretches), own.mean()] if len(own) else [0.0, 0.0])


def test_a_table_too_large_to_broadcast(spark, make_docs, monkeypatch):
    """Documents and answers that meet part by part give the same scores and rows."""
    rows = [(i, t) for i, (_, t) in enumerate(sample(3, 120))]
    rows += [(5, rows[5][1]), (None, "zorp the"), (900, None), (901, ""), (902, "zorp " * 50_000), (903, "?!")]
    docs = make_docs(*rows).withColumnRenamed("lang", "part").withColumnRenamed("source", "row").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(sample(3, 120))], "doc_id long, toxic int")
    near, far = toxicity.train(docs, labels), toxicity.train(docs, labels, limit=0)
    assert near.whole is not None and far.whole is None
    one, other = (sorted(map(str, toxicity.score(docs, m).collect())) for m in (near, far))
    assert one == other and len(one) == len(rows)
    monkeypatch.setattr(toxicity, "PART_BYTES", 2_000)
    assert sorted(map(str, toxicity.score(docs, far).collect())) == one
    kept = [sorted(map(str, toxicity.keep_clean(docs, m).collect())) for m in (near, far)]
    assert kept[0] == kept[1] and toxicity.keep_clean(docs, far).columns == docs.columns
    assert set(kept[0]) <= set(map(str, docs.collect()))
