from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.session import build_session  # noqa: E402
from ledgerloom.sources.schema import TRANSACTION_SCHEMA  # noqa: E402

SMALL = "/root/testdata/sf0.001"
BLANK = {
    "step": 1, "type": "TRANSFER", "amount": 10.0, "nameOrig": "A", "oldbalanceOrg": 100.0, "newbalanceOrig": 90.0,
    "nameDest": "B", "oldbalanceDest": 0.0, "newbalanceDest": 10.0, "isFraud": 0, "isFlaggedFraud": 0,
}


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tx(spark):
    """Raw transactions from partial rows; absent cells take plain values."""

    def make(*rows: dict):
        return spark.createDataFrame([tuple({**BLANK, **row}.values()) for row in rows], TRANSACTION_SCHEMA)

    return make


@pytest.fixture(scope="session")
def small_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("sample tables are not available")
    return SMALL


def records(df, *order: str) -> list[dict]:
    rows = [row.asDict() for row in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[c]) for c in order)) if order else rows


def pairs(spark, *edges: tuple[str, str]):
    return spark.createDataFrame(list(edges), "src STRING, dst STRING")
