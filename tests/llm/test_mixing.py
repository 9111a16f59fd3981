from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing


def reference_targets(sizes):
    """Source to target: shares by weight, those above their limit fixed, the rest reshared."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    budget, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in above}
        budget -= sum(target[s] for s in above)
        free -= above
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, found, tolerance):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    targets = reference_targets(sizes)
    source_of = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source], rel=1e-9, abs=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    for source, size in sizes.items():
        assert taken[source] == pytest.approx(targets[source], abs=tolerance(source))


def test_small_table(spark, small_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in small_docs.collect()]
    found = mixing.mix(small_docs).collect()
    assert sorted((r.doc_id, r.size) for r in found) == sorted((d, words(t)) for d, t, _, _ in rows)
    check(rows, found, lambda s: max(words(t) for _, t, _, x in rows if x == s) / 2)


def test_reruns_agree_whatever_the_partitions(small_docs):
    first = {r.doc_id: r.taken for r in mixing.mix(small_docs).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(small_docs.repartition(7)).collect()}
    assert first == again


def test_awkward_rows(make_docs):
    rows = [(i, "w " * (i % 7), "en", "big") for i in range(200)]
    rows += [(300 + i, "a b c", None, None) for i in range(30)]
    rows += [(400, None, "en", "empty"), (401, "", "en", "empty"), (402, " \t", "en", "empty"), (500, "x " * 30_000, "en", "é")]
    check(rows, mixing.mix(make_docs(*rows)).collect(), lambda s: 3 if s != "é" else 30_000)


def test_empty_table_and_table_without_words(make_docs):
    assert mixing.mix(make_docs()).count() == 0
    (row,) = mixing.mix(make_docs((1, None))).collect()
    assert (row["size"], row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)


def test_repeated_ids_go_together(make_docs):
    docs = make_docs(*[(i // 2, "a b c", "en", "s") for i in range(40)])
    taken = {}
    for r in mixing.mix(docs).collect():
        taken.setdefault(r.doc_id, set()).add(r.taken)
    assert all(len(t) == 1 for t in taken.values())


def test_documents_are_repeated(spark, make_docs):
    """Also with columns of the operator's own names; their values stay."""
    rows = [(i, "a b c d " * (1 + i % 5), "en", f"s{i % 4}") for i in range(80)]
    docs = make_docs(*rows)
    expected = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect()}
    for name in ("copies", "_rule", "_source", "_row", "size", "rate", "place", "whole"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    docs = docs.withColumn("m", F.create_map("copies", "rate"))
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    given = {r.doc_id: r for r in docs.collect()}
    counts = {}
    for r in found.collect():
        assert r == given[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {d: n for d, n in expected.items() if n}


def solve(sizes, target, most=2.0):
    """The dual of one group by plain bisection: the multiplier at which the rates meet the target."""
    sizes = np.array(sizes, float)
    low, high = -800.0, 800.0
    for _ in range(300):
        middle = (low + high) / 2
        if (sizes * np.minimum(most, np.exp(np.minimum(sizes * middle, 50.0)))).sum() < target:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def test_rates_equal_a_plain_solver(spark, small_docs):
    """Rates differ with the words inside a source, meet its target, and are those of the dual's solution."""
    found = mixing.mix(small_docs).collect()
    source_of = {r.doc_id: r.source for r in small_docs.collect()}
    groups = {}
    for r in found:
        groups.setdefault(source_of[r.doc_id], []).append(r)
    free = 0
    for rows in groups.values():
        sizes, rates = np.array([r["size"] for r in rows]), np.array([r.rate for r in rows])
        target = rows[0].target
        assert (sizes * rates).sum() == pytest.approx(target, rel=1e-6)
        if target < 2 * sizes.sum() * (1 - 1e-6):
            free += 1
            assert rates == pytest.approx(np.minimum(2.0, np.exp(sizes * solve(sizes, target))), rel=1e-6)
            assert len(set(rates)) > 1
    assert free


def test_newton_meets_every_target(spark):
    """Sizes from 1 to 30,000 words: the bounds hold the solution wherever it lies."""
    sizes = [1, 1, 2, 7, 40, 300, 30_000]
    targets = [0.0, 1e-3, 5.0, 150.0, 20_000.0, 31_000.0, 40_000.0, 60_000.0, 2.0 * sum(sizes)]
    rows = [(i, x, sizes.count(x)) for i in range(len(targets)) for x in sorted(set(sizes))]
    cells = spark.createDataFrame(rows, "s int, size long, n long")
    solved = mixing.balance(cells, [("s", spark.createDataFrame(list(enumerate(targets)), "s int, target double"))])
    found = {}
    for r in solved.withColumn("rate", mixing.rate(F.col("size"), F.col("multiplier"))).collect():
        found.setdefault(r.s, {})[r["size"]] = r.rate
    for i, target in enumerate(targets):
        rates = [found[i][x] for x in sizes]
        assert sum(x * r for x, r in zip(sizes, rates)) == pytest.approx(target, rel=1e-6, abs=1e-6)
        if 0 < target < 2 * sum(sizes):
            plain = np.minimum(2.0, np.exp(np.minimum(np.array(sizes) * solve(sizes, target), 50.0)))
            assert rates == pytest.approx(plain, rel=1e-5, abs=1e-7)


def test_newton_rakes_several_margins(spark, monkeypatch):
    """Passes over two margins converge linearly; four leave less than a thousandth."""
    monkeypatch.setattr(mixing, "PASSES", 4)
    cells = spark.createDataFrame(
        [("a", "x", 1, 10), ("a", "y", 3, 10), ("b", "x", 2, 10), ("b", "y", 4, 10), ("c", "z", 5, 1)], "s string, l string, size long, n long"
    )
    sources = spark.createDataFrame([("a", 50.0), ("b", 50.0), ("c", 0.0)], "s string, target double")
    languages = spark.createDataFrame([("x", 35.0), ("y", 65.0)], "l string, target double")
    solved = mixing.balance(cells, [("s", sources), ("l", languages)]).withColumn("rate", mixing.rate(F.col("size"), F.col("multiplier")))
    rows = solved.collect()
    assert all(0.0 <= r.rate <= 2.0 for r in rows)
    for column, targets in (("s", {"a": 50, "b": 50, "c": 0}), ("l", {"x": 35, "y": 65})):
        for value, target in targets.items():
            assert sum(r.n * r["size"] * r.rate for r in rows if r[column] == value) == pytest.approx(target, rel=1e-3, abs=1e-9)
    by = {(r.s, r.l): r.multiplier for r in rows}
    # One multiplier per margin value.
    assert by["a", "x"] + by["b", "y"] == pytest.approx(by["a", "y"] + by["b", "x"])


def test_a_round_joins_once(small_docs, monkeypatch):
    """Each join of few rows is a broadcast of its own, which costs the driver a thread and a page."""
    joins, cut = [], mixing.cut_lineage

    def counted(df):
        joins.append(len(re.findall(r"\bJoin\b", df._jdf.queryExecution().optimizedPlan().toString())))
        return cut(df)

    monkeypatch.setattr(mixing, "cut_lineage", counted)
    mixing.plan(small_docs)
    # What the whole copies leave missing needs two joins, once.
    assert len(joins) > 2 * mixing.FLIPS and sorted(joins)[-2] == 1, joins
