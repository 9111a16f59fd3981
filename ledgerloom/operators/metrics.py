"""Classification metrics as aggregations over (score, label) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import focal_loss, safe_ratio, threshold_bin
from ledgerloom.operators.ordering import running_totals


def confusion(df: DataFrame, predicted: Column, label: str = "isFraud", within: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of a boolean prediction."""
    hit, fraud, clean = F.ifnull(predicted, F.lit(False)), F.col(label) == 1, F.col(label) == 0
    return df.groupBy(*within).agg(
        F.count_if(hit & fraud).alias("tp"),
        F.count_if(hit & clean).alias("fp"),
        F.count_if(~hit & fraud).alias("fn"),
        F.count_if(~hit & clean).alias("tn"),
    )


def precision_recall_f1() -> dict[str, Column]:
    """From columns tp, fp, fn; a zero denominator gives 0.0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": safe_ratio(precision * recall * 2, precision + recall),
    }


def with_prf(counts: DataFrame) -> DataFrame:
    return counts.withColumns(precision_recall_f1())


def average_precision(df: DataFrame, score: str = "p", label: str = "isFraud", within: Sequence[str] = ()) -> DataFrame:
    """Sum of recall gains times precision over distinct scores, highest first.

    Equal scores form one step. Scores are counted before anything is ordered,
    and the order is a range shuffle, so neither ties nor size pile up in a task.
    """
    steps = df.groupBy(*within, score).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("hits")
    )
    steps = steps.withColumn("_all", F.lit(0))
    ranked = running_totals(steps, [F.col(score).desc()], ["n", "hits"], ["_all", *within])
    gain = F.col("hits") * F.col("hits_so_far") / F.col("n_so_far")
    summed = ranked.groupBy("_all", *within).agg(
        safe_ratio(F.sum(gain), F.sum("hits")).alias("average_precision")
    )
    return summed.select(*within, "average_precision")


def threshold_sweep(df: DataFrame, score: str = "p", label: str = "isFraud", within: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 at thresholds 0.01 … 0.99 (predict when score > t).

    Rows are reduced to a count per (group, bin) first; only those, at most 100
    per group, are spread over the thresholds below them.
    """
    bins = (
        df.groupBy(*within, threshold_bin(F.col(score)).alias("bin"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    points = bins.select(*within, "bin", "pos", "neg", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("point"))
    above = F.col("bin") >= F.col("point")
    counts = points.groupBy(*within, "point").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
    )
    return with_prf(counts).select(
        *within, (F.col("point") / F.lit(100.0)).alias("threshold"), "precision", "recall", "f1"
    )


def best_threshold(sweep: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Highest F1, lowest threshold on ties; 0.5 with zeros when no F1 is positive."""
    row = F.struct("threshold", "f1", "precision", "recall")
    best = sweep.groupBy(*within).agg(F.max_by(row, F.struct("f1", -F.col("threshold"))).alias("best"))
    found = F.ifnull(F.col("best.f1"), F.lit(0.0)) > 0
    return best.select(
        *within,
        F.when(found, F.col("best.threshold")).otherwise(0.5).alias("threshold"),
        *[F.when(found, F.col(f"best.{m}")).otherwise(0.0).alias(m) for m in ("f1", "precision", "recall")],
    )


def split_evaluation(df: DataFrame, threshold: float | Column, score: str = "p", within: Sequence[str] = ("split",)) -> DataFrame:
    """F1, precision, recall and average precision per split at one threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    at_threshold = with_prf(confusion(df, F.col(score) > limit, within=within))
    return at_threshold.join(average_precision(df, score, within=within), list(within)).select(
        *within, "f1", "precision", "recall", F.col("average_precision").alias("pr_auc")
    )


def mean_focal_loss(df: DataFrame, logit: str = "z", label: str = "isFraud") -> DataFrame:
    return df.agg(F.avg(focal_loss(F.col(logit), F.col(label))).alias("focal_loss"))
