from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import pii, queries

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_base(text: str) -> list[tuple[int, int, int]]:
    """The patterns as they stand, each over the whole text."""
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * 2 - 9 * (int(d) > 4) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
            good = [
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                14 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                10 <= len(digits) <= 15,
            ][kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_rules_on_random_text():
    rnd = random.Random(11)
    bits = ["a", "b.c", "@", "@x.y", ".", "-", "+", "+1", "12", "255", "256", "0", "007", " ", "(", ")", "1.2.3.4", "4242", "é", "%_"]
    found = 0
    for _ in range(6000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))
        assert pii.base_spans(text) == plain_base(text), text
        found += len(pii.base_spans(text))
    assert found > 1000


def test_long_tokens_take_linear_time():
    text = "1" * 300_000 + " " + "a" * 300_000 + "@" + "b@" * 50_000 + " " + "1.2." * 50_000 + " +" + "1 " * 100_000
    assert len(pii.base_spans(text)) == 25_000
    assert pii.added_spans([text], [pii.base_spans(text)], pii.SkipChain.blank()) == [[]]


def test_messages_on_a_tree_are_exact():
    rnd = np.random.default_rng(3)
    links = rnd.normal(size=(3, pii.LABELS, pii.LABELS))
    model = pii.SkipChain(rnd.normal(size=(pii.SHAPES, pii.LABELS)), (links + links.transpose(0, 2, 1)) / 2)
    masks, observed = np.array([1, 3, 5, 9]), np.array([-1, 2, -1, -1])
    edges = np.array([[0, 1, 0], [1, 2, 1], [1, 3, 2]])
    own, chance = model.unary(masks), np.zeros((4, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=4):
        if labels[1] == 2:
            score = sum(own[i, y] for i, y in enumerate(labels) if i != 1)
            weight = np.exp(score + sum(model.links[k, labels[a], labels[b]] for a, b, k in edges))
            for i, y in enumerate(labels):
                chance[i, y] += weight
    np.testing.assert_allclose(model.marginals(masks, observed, edges), chance / chance.sum(axis=1, keepdims=True), atol=1e-3)


def test_links_join_repeats_and_likenesses():
    text = "Write to jo.doe7@mail.org or +1 (499) 555-6503. Later jo.doe7(at)mail.org, 499.555.6503; again 499.555.6503 and 12"
    nodes = pii.field(text, pii.base_spans(text))
    parts = [text[s:e] for s, e in zip(nodes.start, nodes.end)]
    named = {(parts[a], parts[b], k) for a, b, k in nodes.links}
    assert ("jo.doe7@mail.org", "jo.doe7(at)mail.org", pii.SAME) in named
    assert ("+1 (499) 555-6503", "499.555.6503", pii.SIMILAR) in named and ("499.555.6503", "499.555.6503", pii.SAME) in named
    assert not any("12" in pair for *pair, _ in named)


@pytest.fixture(scope="module")
def model(small_docs):
    return pii.train(small_docs)


def test_consistency_over_a_document(model, make_docs):
    """A damaged mention is found where the document supports it, and only there."""
    text = "Call +1 (499) 555-6503 today. Ask for extension 12, room 499.\n" + "words without any meaning " * 50 + "or (499) 555-6503 in 2024."
    alone = text.replace("+1 (499) 555-6503", "nobody")
    docs = make_docs((1, text), (2, alone))
    found = {r.doc_id: r for r in pii.find(docs, model).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in found[1].spans] == [("phone", "+1 (499) 555-6503"), ("phone", "(499) 555-6503")]
    assert found[2].base == found[2].spans == []
    masked = {r.doc_id: r.text for r in pii.masked_documents(docs, model).collect()}
    assert masked[1].count("[phone]") == 2 and "555-6503" not in masked[1] and masked[2] == alone


def test_held_out_mentions(model, spark):
    """Damaged repeats in documents that were not learned from: nearly all found, look-alikes left alone."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id >= 200").select("text").collect()
    caught = missed = wrong = 0
    for (text,) in rows:
        text, marks = pii.lesson(text + " .")
        base = pii.base_spans(text)
        added = pii.added_spans([text], [base], model)[0]
        for start, end, label in marks:
            hit = any(kind + 1 == label and s < end and start < e for s, kind, e in added)
            caught, missed = caught + hit, missed + (not hit)
        wrong += sum(not any(s < end and start < e for start, end, _ in marks) for s, _, e in added)
    assert caught > 20 and caught / (caught + missed) >= 0.9 and wrong <= 0.05 * caught


def test_defined_cases(spark, model):
    shape = "text string, spans int, doc_id int, base map<string,int>"
    mail = "a.b@c.de"
    docs = spark.createDataFrame([(None, 1, None, None), ("", 2, 1, {"k": 1}), (mail, 3, 2, None), (mail, 4, 2, None), (mail + " " + "x9 " * 200_000, 5, 3, None)], shape)
    found = [(r.doc_id, len(r.base), len(r.spans)) for r in pii.find(docs, model).collect()]
    assert sorted(found, key=str) == sorted([(None, 0, 0), (1, 0, 0), (2, 1, 1), (2, 1, 1), (3, 1, 1)], key=str)
    kept = pii.masked_documents(docs, model)
    assert kept.schema == docs.schema
    rows = sorted(kept.collect(), key=lambda r: r.spans)
    assert [r.text for r in rows[:4]] == [None, "", "[email]", "[email]"] and rows[1].base == {"k": 1}
    nothing = docs.limit(0)
    assert pii.digests(pii.find(nothing, pii.train(nothing))).count() == 0


def test_query_against_plain_patterns(spark, small_dir, small_docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op13_pii"](spark, small_dir).collect()}
    assert len(rows) == small_docs.count()
    for doc in small_docs.select("doc_id", "text").collect():
        base = plain_base(doc.text or "")
        row = rows[doc.doc_id]
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert set(listed) <= set(row.spans.split(",") if row.spans else [])
