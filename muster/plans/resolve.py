"""From requests to active snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.requests import DEFAULT_MAX_ATTEMPTS, DEFAULT_PAGE_SIZE, request_violation, resolved_delay
from muster.functions.text import is_missing
from muster.operators import catalog as C
from muster.operators.lookup import spread_lookup
from muster.plans import summary
from muster.plans.commit import commit_pages
from muster.shared import scratch, stage

# The kind of error behind each outcome that is neither reuse nor create.
_ERRORS = {
    C.INVALID_MODE: ValueError,
    C.EMAIL_REQUIRED: ValueError,
    C.NO_LATEST: FileNotFoundError,
    C.NO_MANIFEST: FileNotFoundError,
    C.NO_IDS: FileNotFoundError,
}


def resolve(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """``requests(dataset_id, mode, email, …)`` with ``outcome`` and the ``snapshot`` to reuse."""
    asked = requests.withColumn("has_email", ~is_missing(F.col("email")))
    return C.resolve_requests(asked, summary.latest_state(spark, root, requests)).drop("has_email")


def _violations(requests: DataFrame) -> DataFrame:
    """Requests whose arguments break a rule; an argument that is not given keeps to them."""
    defaults = {"search_query": "-", "page_size": DEFAULT_PAGE_SIZE, "max_retry_attempts": DEFAULT_MAX_ATTEMPTS}
    query, size, attempts = (
        F.col(name) if name in requests.columns else F.lit(value) for name, value in defaults.items()
    )
    broken = request_violation(F.col("email"), query, size, attempts)
    return requests.select("dataset_id", broken.alias("violation")).where(F.col("violation").isNotNull())


# What a request may set, with the type it has in a manifest.
_SETTINGS = {"page_size": "int", "max_retry_attempts": "int", "request_delay_seconds": "double"}


def _settings(requests: DataFrame) -> DataFrame:
    """``(dataset_id, _query, _page_size, …)``: what requests ask for, null where they say nothing."""

    def given(name: str, kind: str):
        return (F.col(name) if name in requests.columns else F.lit(None)).cast(kind)

    asked = {f"_{name}": given(name, kind) for name, kind in _SETTINGS.items()}
    if "request_delay_seconds" in requests.columns or "api_key" in requests.columns:
        asked["_request_delay_seconds"] = resolved_delay(given("request_delay_seconds", "double"), given("api_key", "string"))
    asked["_query"] = given("search_query", "string")
    return stage(requests.select("dataset_id", *(column.alias(name) for name, column in asked.items())), "settings")


def _as_requested(searches: DataFrame, create: DataFrame) -> DataFrame:
    """The landed searches of requests, with their settings; one for another query raises."""
    joined = searches.join(create, "dataset_id")
    if other := joined.where(F.col("_query") != F.col("search_query")).first():
        raise ValueError(f"{other.dataset_id}: the landed search is for another query than the request")
    for name, kind in _SETTINGS.items():
        own = F.col(name) if name in searches.columns else F.lit(None)
        joined = joined.withColumn(name, F.coalesce(F.col(f"_{name}"), own.cast(kind)))
    return joined.drop(*(c for c in create.columns if c != "dataset_id"))


def _within_attempts(pages: DataFrame, create: DataFrame) -> DataFrame:
    """The pages of the datasets to create, up to the attempts their requests allow."""
    allowed = stage(create.select("dataset_id", "_max_retry_attempts"), "allowed")
    found = spread_lookup(pages, allowed, ["dataset_id"], ["page_start"])
    return found.where(F.coalesce(F.col("attempt") < F.col("_max_retry_attempts"), F.lit(True))).drop("_max_retry_attempts")


def activate(
    spark: SparkSession,
    root: str,
    requests: DataFrame,
    searches: DataFrame | None = None,
    pages: DataFrame | None = None,
    **policy: bool | int | None,
) -> tuple[DataFrame, DataFrame]:
    """``(manifests, identifiers)`` of the snapshot each of ``requests(dataset_id, mode, email, …)`` comes to.

    Requests to reuse read the store and touch no page. Requests to create freeze the
    landed ``searches`` and ``pages`` of their datasets. A request that can do neither
    raises before anything is written. One request per dataset.

    What a request to create says of ``page_size``, ``max_retry_attempts`` and
    ``request_delay_seconds`` (with ``api_key`` deciding the default) goes into its manifest,
    and its attempts bound the pages read. A landed search for another query raises.
    ``policy`` is what ``commit_pages`` takes by name. Of the tables staged on the way, only
    the names of the snapshots remain.
    """
    with scratch(spark):
        names = stage(_wanted(spark, root, requests, searches, pages, policy), "active", keep=True)
    return summary.load_snapshots(spark, root, names)


def _wanted(
    spark: SparkSession,
    root: str,
    requests: DataFrame,
    searches: DataFrame | None,
    pages: DataFrame | None,
    policy: dict[str, bool | int | None],
) -> DataFrame:
    """The names of the snapshots that requests come to, once those to create are there."""
    resolved = stage(resolve(spark, root, requests), "resolved")
    failed = resolved.where(~F.col("outcome").isin(C.REUSE, C.CREATE))
    if error := failed.first():
        raise _ERRORS[error.outcome](f"{error.dataset_id}: {error.outcome}")
    if error := _violations(resolved.where(F.col("outcome") == C.CREATE)).first():
        raise ValueError(f"{error.dataset_id}: {error.violation}")
    twice = resolved.groupBy("dataset_id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("several requests for one dataset")

    wanted = resolved.where(F.col("outcome") == C.REUSE).select(*C.KEY)
    create = _settings(resolved.where(F.col("outcome") == C.CREATE))
    if not create.isEmpty():
        if searches is None or pages is None:
            raise ValueError("requests to create need landed searches and pages")
        new = _as_requested(searches, create)
        if not create.join(searches, "dataset_id", "left_anti").isEmpty():
            raise ValueError("a request to create has no landed search")
        made = commit_pages(
            spark,
            root,
            new,
            _within_attempts(pages, create),
            **policy,
        )
        wanted = wanted.unionByName(made.select(*C.KEY))
    return wanted
