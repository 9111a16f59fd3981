"""The pipeline stage by stage, its registration, and its absence."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import duckdb
import pytest
from check_oracles import TABLES, compare

import __spark_entry__
from ledgerloom.llm import decontaminate, queries, toxicity
from ledgerloom.session import materialize
from tests.llm.test_copies import survivors

REPO = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, small_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    rows = queries.QUERIES[name](spark, small_dir).toPandas()
    assert compare(rows, db.execute(queries.ORACLES[name]).df()).startswith("ok")


@pytest.mark.parametrize("name", ["op1_quality", "op4_language", "op9_toxicity"])
def test_learned_queries(spark, small_dir, small_docs, name):
    rows = queries.QUERIES[name](spark, small_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in small_docs.collect())
    assert all(0.0 <= r.score <= 1.0 for r in rows)


def test_stages(spark, small_dir, small_docs):
    """Every stage on all that the one before kept."""
    docs, kept = small_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, before, small_dir), f"test-{name}")
        kept[name] = docs
        if name != "sharding":
            assert docs.columns == small_docs.columns
        rows, earlier = docs.collect(), {tuple(r) for r in before.collect()}
        assert all(tuple(r)[: len(small_docs.columns)] in earlier for r in rows)
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{small_dir}/labels.parquet"))
            expected = {r.doc_id for r in toxicity.score(before, model).collect() if not r.predicted}
            assert {r.doc_id for r in rows} == expected
        if name == "simhash_near_dedup":
            expected, _ = survivors([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in expected)
        if name == "decontamination":
            items = spark.read.parquet(f"{small_dir}/benchmark.parquet")
            clean = {r.doc_id for r in decontaminate.report(before, items).collect() if not r.contaminated}
            assert sorted(r.doc_id for r in rows) == sorted(clean)
    assert kept["sharding"].count() == kept["mixing"].count() > kept["decontamination"].count()
    assert kept["toxicity"].count() < small_docs.count()


def test_registration(spark):
    known = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(known)
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_entry_without_the_package(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith(('op', 'pipeline'))]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(copy)})
