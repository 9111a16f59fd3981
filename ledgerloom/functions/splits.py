"""Time-based splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import Split

SPLIT_NAMES = ("train", "val", "test")


def split_label(split: Split, step: str = "step") -> Column:
    """train / val / test by step; anything later, or unknown, is test."""
    at = F.col(step)
    return F.when(at <= split.train_max, "train").when(at <= split.val_max, "val").otherwise("test")


def split_flags(split: Split, step: str = "step") -> dict[str, Column]:
    at = F.col(step)
    return {
        "is_train": at <= split.train_max,
        "is_val": (at > split.train_max) & (at <= split.val_max),
        "is_test": at > split.val_max,
    }


def split_frames(df: DataFrame, split: Split) -> dict[str, DataFrame]:
    labelled = df.withColumn("split", split_label(split))
    return {name: labelled.filter(F.col("split") == name) for name in SPLIT_NAMES}


def proportional_bounds(last_step: Column) -> dict[str, Column]:
    """Split bounds that scale with the last step of the data (67 % and 83 %)."""
    whole = last_step.cast("int")
    train = F.greatest(F.lit(1), F.floor(whole * F.lit(0.67)).cast("int"))
    wanted = F.greatest(train + 1, F.floor(whole * F.lit(0.83)).cast("int"))
    return {
        "train_max": train,
        "val_max": F.when(whole > 2, F.least(wanted, whole - 1)).otherwise(whole),
        "test_max": whole,
    }
