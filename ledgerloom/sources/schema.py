"""Table schemas and column lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INT, TEXT, REAL = T.IntegerType(), T.StringType(), T.DoubleType()

# The column names, order and types every table must carry.
ACCOUNT_CELLS = {
    "step": INT, "type": TEXT, "amount": REAL,
    "nameOrig": TEXT, "oldbalanceOrg": REAL, "newbalanceOrig": REAL,
    "nameDest": TEXT, "oldbalanceDest": REAL, "newbalanceDest": REAL,
}
LABEL_CELLS = {"isFraud": INT, "isFlaggedFraud": INT}
METRIC_CELLS = {
    "run_name": TEXT, "auc_pr": REAL, "auc_roc": REAL,
    "precision_at_0_5": REAL, "recall_at_0_5": REAL, "f1_at_0_5": REAL,
}


def _schema(cells: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cells.items()])


TRANSACTION_SCHEMA = _schema(ACCOUNT_CELLS | LABEL_CELLS)
REQUEST_SCHEMA = _schema({"tx_id": TEXT} | ACCOUNT_CELLS)
REQUEST_TEXT_SCHEMA = _schema(dict.fromkeys(REQUEST_SCHEMA.fieldNames(), TEXT))
METRIC_SCHEMA = _schema(METRIC_CELLS)

TRANSACTION_COLUMNS = TRANSACTION_SCHEMA.fieldNames()
REQUEST_COLUMNS = REQUEST_SCHEMA.fieldNames()
MONEY_COLUMNS = [f.name for f in TRANSACTION_SCHEMA if isinstance(f.dataType, T.DoubleType)]


class MissingColumns(ValueError):
    """A table lacks columns that the job needs."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Project to ``names`` in that order, or fail naming what is absent."""
    absent = sorted(set(names) - set(df.columns), key=names.index)
    if absent:
        raise MissingColumns(f"input lacks columns: {', '.join(absent)}")
    return df.select(names)


def keep_existing(df: DataFrame, names: list[str]) -> DataFrame:
    """Project to those of ``names`` the table has, in list order."""
    present = set(df.columns)
    return df.select([n for n in names if n in present])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
