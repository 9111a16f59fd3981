"""Column expressions used by features, metrics and scoring."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.sources.schema import MONEY_COLUMNS, TRANSACTION_COLUMNS

# Transaction kinds that count as high-risk.
HIGH_RISK_TYPES = ("TRANSFER", "CASH_OUT")
DIGEST_BYTES = 32


def clean_type(name: str = "type") -> Column:
    return F.upper(F.trim(name))


def row_digest(columns: Iterable[str] = TRANSACTION_COLUMNS, canonical: str = "full") -> Column:
    """SHA-256 of the row's text, so equal rows get equal ids.

    ``full`` prints doubles whole, so rows that differ at all get different ids;
    ``cents`` prints money with two decimals, which every engine does alike, and
    is for amounts known to be whole cents. Amounts beyond 38 digits, or not
    finite, are printed whole there too.
    """
    if canonical not in ("full", "cents"):
        raise ValueError(f"canonical must be 'full' or 'cents', not {canonical!r}")

    def text(name: str) -> Column:
        whole = F.col(name).cast("string")
        if canonical == "cents" and name in MONEY_COLUMNS:
            whole = F.ifnull(F.col(name).try_cast("decimal(38,2)").cast("string"), whole)
        return F.ifnull(whole, F.lit("NULL"))

    return F.sha2(F.concat_ws("||", *map(text, columns)), 256)


def packed_id(name: str) -> Column:
    """A row id in few bytes, for joins that carry it: a digest's 64 hex digits as 32 bytes.

    Any other text follows 33 zero bytes, so different ids stay different; ``unpacked_id`` undoes it.
    """
    text = F.col(name)
    other = F.concat(F.lit(bytes(DIGEST_BYTES + 1)), text.cast("binary"))
    return F.when(text.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(text)).otherwise(other).alias(name)


def unpacked_id(name: str) -> Column:
    packed = F.col(name)
    other = F.expr(f"substring(`{name}`, {DIGEST_BYTES + 2})").cast("string")
    return F.when(F.octet_length(packed) == DIGEST_BYTES, F.lower(F.hex(packed))).otherwise(other).alias(name)


def zero_flag(balance: str) -> Column:
    """1 for a balance of exactly zero; NULL counts as not zero."""
    return F.ifnull((F.col(balance) == 0).cast("int"), F.lit(0))


def share_of(amount: str, balance: str) -> Column:
    """amount / balance for positive balances, else 0.0."""
    positive = F.when(F.col(balance) > 0, F.col(balance))
    return F.when(positive.isNotNull(), F.col(amount) / positive).otherwise(F.lit(0.0))


def balance_errors() -> dict[str, Column]:
    """How far the balances are from what the amount implies."""
    return {
        "errorBalanceOrig": F.col("newbalanceOrig") + F.col("amount") - F.col("oldbalanceOrg"),
        "errorBalanceDest": F.col("oldbalanceDest") + F.col("amount") - F.col("newbalanceDest"),
    }


def transfer_flag() -> Column:
    return F.ifnull((F.col("type") == "TRANSFER").cast("int"), F.lit(0))


def edge_attributes() -> dict[str, Column]:
    """The four edge attributes, in model order."""
    return {
        "log_amount": F.log1p("amount"),
        **balance_errors(),
        "is_transfer": transfer_flag(),
    }


EDGE_ATTRIBUTES = ["log_amount", "errorBalanceOrig", "errorBalanceDest", "is_transfer"]


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def is_scored(probability: Column) -> Column:
    """Whether there is a probability to decide by."""
    return ~F.ifnull(F.isnan(probability), F.lit(False)) & probability.isNotNull()


def verdict(probability: Column, threshold: float, hit: str, miss: str) -> Column:
    """``hit`` above the threshold (strictly), else ``miss``; NULL without a probability."""
    return F.when(is_scored(probability), F.when(probability > threshold, hit).otherwise(miss))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, or 0.0 when bottom is zero."""
    return F.ifnull(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def binary_cross_entropy(logit: Column, label: Column) -> Column:
    """Cross entropy of a logit, without overflow for large magnitudes."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(logit: Column, label: Column, alpha: float = 0.75, gamma: float = 2.0) -> Column:
    entropy = binary_cross_entropy(logit, label)
    weight = F.when(label == 1, alpha).otherwise(1 - alpha)
    return weight * F.pow(F.lit(1.0) - F.exp(-entropy), F.lit(gamma)) * entropy


def threshold_bin(probability: Column, steps: int = 100) -> Column:
    """How many of the thresholds 1/steps … (steps-1)/steps lie strictly below.

    ``floor(p * steps)`` may be off by one through rounding, so it is corrected
    by exact comparisons with the two neighbouring thresholds.
    """
    guess = F.floor(probability * steps)
    up = ((guess + 1) / F.lit(float(steps)) < probability).cast("int")
    down = (guess / F.lit(float(steps)) >= probability).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(steps - 1), guess + up - down)).cast("int")
