"""Result pages: which attempt counts, whether a list is whole, and the list itself.

``pages(dataset_id, page_start, attempt, ids, error)`` holds one row per request
made. ``searches(dataset_id, reported_count, …)`` holds one row per dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.lookup import spread_lookup
from muster.operators.order import CELL_WIDTHS, previous_in_order
from muster.shared import stage

PAGE_SCHEMA = "dataset_id string, page_start bigint, attempt int, ids array<string>, error string"

# What can be wrong with a dataset, the gravest first.
UNKNOWN_COUNT = "unknown_count"
MISSING_ID_LIST = "missing_id_list"
EMPTY_PAGE = "empty_page"
GAP = "gap"
OVERLAP = "overlap"
INCOMPLETE = "incomplete"
OK = "ok"
REQUEST_ERROR = "request_error"

_ATTEMPT_STEP = 1 << 32  # one bigint holds an attempt and a page length
_FAULTS = (REQUEST_ERROR, MISSING_ID_LIST, EMPTY_PAGE)


def attempt_fault() -> Column:
    """Why an attempt does not count, or null if it does."""
    return (
        F.when(F.col("error").isNotNull(), REQUEST_ERROR)
        .when(F.col("ids").isNull(), MISSING_ID_LIST)
        .when(F.size("ids") == 0, EMPTY_PAGE)
    )


def succeeded() -> Column:
    """The same as no ``attempt_fault``, in a form that reaches the scan."""
    return F.col("error").isNull() & (F.size("ids") > 0)


def first_success(pages: DataFrame, *, max_attempts: int | None = None) -> DataFrame:
    """The page of the first attempt at each offset that succeeded.

    Spark limits each group to one row before the shuffle. Where only successful
    pages are landed, once each, this step is not needed.
    """
    if max_attempts is not None:
        pages = pages.where(F.col("attempt") < max_attempts)
    first = Window.partitionBy("dataset_id", "page_start").orderBy("attempt")
    return (
        pages.where(succeeded())
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def page_outcomes(pages: DataFrame, *, max_attempts: int | None = None) -> DataFrame:
    """``(dataset_id, page_start, page_len, fault)``: one row per offset asked for.

    ``fault`` is that of the last attempt if none succeeded, else null. The buffers
    are bigints, so repeated attempts are folded before the shuffle.
    """
    if max_attempts is not None:
        pages = pages.where(F.col("attempt") < max_attempts)
    fault = attempt_fault()
    attempt = F.col("attempt").cast("bigint")
    code = F.lit(None).cast("bigint")
    for number, name in enumerate(_FAULTS):
        code = F.when(fault == name, F.lit(number).cast("bigint")).otherwise(code)
    step = F.lit(_ATTEMPT_STEP)
    kinds = len(_FAULTS)
    packed = pages.select(
        "dataset_id",
        "page_start",
        F.when(fault.isNull(), attempt * step + F.size("ids")).alias("_won"),
        (attempt * kinds + code).alias("_lost"),
    )
    best = packed.groupBy("dataset_id", "page_start").agg(F.min("_won").alias("_won"), F.max("_lost").alias("_lost"))
    last_fault = F.element_at(F.array(*map(F.lit, _FAULTS)), (F.col("_lost") % kinds + 1).cast("int"))
    return best.select(
        "dataset_id",
        "page_start",
        F.coalesce(F.col("_won") % step, F.lit(0)).alias("page_len"),
        F.when(F.col("_won").isNull(), last_fault).alias("fault"),
    )


def page_grid(
    pages: DataFrame, *, max_attempts: int | None = None, widths: tuple[int, ...] = CELL_WIDTHS
) -> DataFrame:
    """``page_outcomes`` with ``page_end`` and ``expected_start``, the end of the page before.

    The next offset follows from the length a page really has, so a short page moves
    the rest of the grid. Offsets at which every request failed hold no page.
    """
    outcomes = page_outcomes(pages, max_attempts=max_attempts)
    landed = outcomes.where(F.col("fault").isNull() | (F.col("fault") != REQUEST_ERROR))
    # Staged, because the cells need it several times and the pages are wide.
    landed = stage(landed.withColumn("page_end", F.col("page_start") + F.col("page_len")), "outcomes")
    grid = previous_in_order(landed, ["dataset_id"], "page_start", "page_end", "expected_start", widths)
    return grid.withColumn("expected_start", F.coalesce("expected_start", F.lit(0).cast("bigint")))


def page_verdict(
    pages: DataFrame,
    searches: DataFrame,
    *,
    max_attempts: int | None = None,
    widths: tuple[int, ...] = CELL_WIDTHS,
) -> DataFrame:
    """``(dataset_id, reported_count, raw_count, n_pages, verdict)`` for every search.

    Pages at or past the reported count play no part in the verdict. So each dataset
    is reduced to the first offset of each fault before the reported count is joined,
    one row to one row. A last page that is too long is accepted. A reported count
    that is null or negative is no count: nothing can be said of the pages.
    """
    grid = page_grid(pages, max_attempts=max_attempts, widths=widths)
    start, expected = F.col("page_start"), F.col("expected_start")
    first = {
        "_missing": F.min(F.when(F.col("fault") == MISSING_ID_LIST, start)),
        "_empty": F.min(F.when(F.col("fault") == EMPTY_PAGE, start)),
        "_gap": F.min(F.when(start > expected, start)),
        "_overlap": F.min(F.when(start < expected, start)),
        # Where the pages stop being contiguous, should that be past the count.
        "_reach": F.min(F.when(start > expected, expected)),
        "_end": F.max("page_end"),
        "_raw": F.sum("page_len"),
        "_pages": F.count(F.when(F.col("fault").isNull(), 1)),
    }
    per_dataset = grid.groupBy("dataset_id").agg(*(column.alias(name) for name, column in first.items()))
    reported = F.col("reported_count")
    nothing = F.lit(0).cast("bigint")
    verdict = (
        F.when(reported.isNull() | (reported < 0), UNKNOWN_COUNT)
        .when(F.col("_missing") < reported, MISSING_ID_LIST)
        .when(F.col("_empty") < reported, EMPTY_PAGE)
        .when(F.col("_gap") < reported, GAP)
        .when(F.col("_overlap") < reported, OVERLAP)
        .when(F.coalesce("_reach", "_end", nothing) < reported, INCOMPLETE)
        .otherwise(OK)
    )
    return searches.join(per_dataset, "dataset_id", "left").select(
        "dataset_id",
        "reported_count",
        F.coalesce("_raw", nothing).alias("raw_count"),
        F.coalesce("_pages", nothing).alias("n_pages"),
        verdict.alias("verdict"),
    )


def flatten_pages(pages: DataFrame) -> DataFrame:
    """``(dataset_id, ord, id)`` from one page per offset; ``ord`` is the offset of the item.

    Narrow, so it works on a stream of landed pages as well.
    """
    items = pages.where(F.size("ids") > 0).select("dataset_id", "page_start", F.posexplode("ids").alias("_pos", "id"))
    return items.select("dataset_id", (F.col("page_start") + F.col("_pos")).alias("ord"), "id")


def page_progress(pages: DataFrame, searches: DataFrame) -> DataFrame:
    """``(dataset_id, page_start, extracted, progress)`` after each page of ``first_success``."""
    ends = pages.select("dataset_id", "page_start", (F.col("page_start") + F.size("ids")).alias("extracted"))
    share = F.least(F.col("extracted") / F.col("reported_count"), F.lit(1.0))
    reported = stage(searches.select("dataset_id", "reported_count"), "reported")
    return spread_lookup(ends, reported, ["dataset_id"], ["page_start"]).select(
        "dataset_id", "page_start", "extracted", F.when(F.col("reported_count") > 0, share).alias("progress")
    )
