"""The log of requests: ``(dataset_id, page_start, attempt, failed)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators.pages import attempt_fault, succeeded

SUCCEEDED = "succeeded"
EXHAUSTED = "exhausted"
PENDING = "pending"


def retry_outcome(log: DataFrame, *, max_attempts: int) -> DataFrame:
    """``(dataset_id, page_start, winning_attempt, attempts_made, outcome)`` per offset.

    Attempts count from 0. The first success ends the offset, and later rows are
    ignored; ``max_attempts`` failures exhaust it.
    """
    tried = log.where(F.col("attempt") < max_attempts)
    best = tried.groupBy("dataset_id", "page_start").agg(
        F.min(F.when(~F.col("failed"), F.col("attempt").cast("bigint"))).alias("winning_attempt"),
        F.count(F.lit(1)).alias("_rows"),
    )
    won = F.col("winning_attempt")
    return best.select(
        "dataset_id",
        "page_start",
        "winning_attempt",
        F.coalesce(won + 1, F.col("_rows")).alias("attempts_made"),
        F.when(won.isNotNull(), SUCCEEDED)
        .when(F.col("_rows") >= max_attempts, EXHAUSTED)
        .otherwise(PENDING)
        .alias("outcome"),
    )


def failed_datasets(pages: DataFrame, *, max_attempts: int | None) -> DataFrame:
    """``(dataset_id, page_start, attempts, last_error)``: where reading a dataset ends, and why.

    The first offset at which ``max_attempts`` requests brought no identifiers, or, without a
    bound, all that were made. The log is
    reduced with number buffers; the errors of one offset per dataset are looked up after.
    """
    tried = pages if max_attempts is None else pages.where(F.col("attempt") < max_attempts)
    won = F.when(succeeded(), 1).otherwise(0)
    offsets = tried.groupBy("dataset_id", "page_start").agg(F.max(won).alias("_won"), F.count(F.lit(1)).alias("_rows"))
    exhausted = offsets.where((F.col("_won") == 0) & (F.col("_rows") >= (max_attempts or 1)))
    first = exhausted.groupBy("dataset_id").agg(F.min("page_start").alias("page_start"))
    reason = F.coalesce("error", attempt_fault())
    return (
        tried.join(first, ["dataset_id", "page_start"])
        .groupBy("dataset_id", "page_start")
        .agg(F.count(F.lit(1)).alias("attempts"), F.max_by(reason, F.col("attempt")).alias("last_error"))
    )


def backoff_schedule(log: DataFrame, *, delay_seconds: float, max_attempts: int) -> DataFrame:
    """``(dataset_id, page_start, attempt, backoff_seconds)``: the wait after each failure.

    It doubles with each attempt; there is none after the last one allowed.
    """
    waits = log.where(F.col("failed") & (F.col("attempt") < max_attempts - 1))
    return waits.select(
        "dataset_id",
        "page_start",
        F.col("attempt").cast("bigint").alias("attempt"),
        (F.pow(F.lit(2.0), "attempt") * F.lit(delay_seconds)).alias("backoff_seconds"),
    )
