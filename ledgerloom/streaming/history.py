"""Prior activity of arriving transactions, from keyed state: what ``features.history`` computes in batches.

Every account of a side keeps, in the state store, how many transactions it had in each step. A
transaction's prior count is the number of its account's transactions in smaller steps, of all
files read so far and of its own micro-batch. Files that arrive in the order of their steps
therefore give the batch result exactly; a late row counts for later steps from then on, and
rows already written stay as they were.

State is one pair of short arrays per account and side, at most one entry per step seen. It is
part of the query's checkpoint, so a restarted query goes on where it stopped. The rows of one
account in one micro-batch meet in one task; ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` of
the source bounds them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions.expressions import packed_id, unpacked_id
from ledgerloom.operators.features import RECEIVER, SENDER

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "side STRING, account STRING, txn_id STRING, step INT, prior LONG"
#: Row ids go through the state operator packed.
PACKED = OUTPUT.replace("txn_id STRING", "txn_id BINARY")


class PriorCounts(StatefulProcessor):
    """Keyed by (side, account): adds the batch's rows to the counts per step, then answers each row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "steps ARRAY<INT>, counts ARRAY<BIGINT>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([part[["txn_id", "step"]] for part in rows])
        steps, counts = np.unique(arrived["step"].to_numpy(np.int64), return_counts=True)
        if self._seen.exists():
            old_steps, old_counts = self._seen.get()
            both = np.concatenate([np.asarray(old_steps, np.int64), steps])
            number = np.concatenate([np.asarray(old_counts, np.int64), counts])
            steps, place = np.unique(both, return_inverse=True)
            counts = np.zeros(len(steps), np.int64)
            np.add.at(counts, place, number)
        self._seen.update((steps.astype(np.int32).tolist(), counts.tolist()))
        before = np.cumsum(counts) - counts
        prior = before[np.searchsorted(steps, arrived["step"].to_numpy(np.int64))]
        yield pd.DataFrame(
            {"side": key[0], "account": key[1], "txn_id": arrived["txn_id"], "step": arrived["step"].astype("int32"), "prior": prior}
        )


def use_rocks(spark: SparkSession) -> None:
    """The state store that keyed state needs; a provider set by the user stays."""
    if not spark.conf.get(STATE_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STATE_PROVIDER, ROCKS)


def history_stream(tx: DataFrame) -> DataFrame:
    """(side, account, txn_id, step, prior): two rows per arriving transaction, one for each of its accounts."""
    use_rocks(tx.sparkSession)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(name).alias("account")) for side, name in (("src", "nameOrig"), ("dst", "nameDest"))])
    long = tx.select(F.inline(sides), packed_id("txn_id"), F.col("step").cast("int").alias("step"))
    found = long.groupBy("side", "account").transformWithStateInPandas(
        statefulProcessor=PriorCounts(), outputStructType=PACKED, outputMode="Append", timeMode="None"
    )
    return found.withColumn("txn_id", unpacked_id("txn_id"))


def history_columns(rows: DataFrame) -> DataFrame:
    """(txn_id, src_prev_steps_out_count, dst_prev_steps_in_count) from what the stream has written.

    Equal transactions share an id and have equal counts, so they are one row.
    """
    prior = {side: F.max(F.when(F.col("side") == side, F.col("prior"))).alias(names["prior"]) for side, names in (("src", SENDER), ("dst", RECEIVER))}
    return rows.groupBy(packed_id("txn_id")).agg(*prior.values()).withColumn("txn_id", unpacked_id("txn_id"))
