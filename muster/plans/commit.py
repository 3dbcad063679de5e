"""Freezing lists as immutable snapshots, many datasets in one job."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.naming import stamp_instant
from muster.functions.requests import header_is_broken
from muster.functions.text import is_missing
from muster.operators import catalog as C
from muster.operators import pages as P
from muster.operators.digest import list_digest
from muster.operators.lookup import spread_lookup
from muster.operators.manifest import MANIFEST_SCHEMA, assign_shards, complete_searches, manifest_rows
from muster.operators.normalize import list_order, measure, measure_distinct, sorted_once, stable_dedup, stripped
from muster.operators.retries import failed_datasets
from muster.operators.tree import tree_digest
from muster.plans import store, summary
from muster.plans.stored import stored_digests
from muster.shared import PACKED, in_scratch, stage
from muster.sinks.documents import write_json
from muster.sources.lines import opens


def stamp_searches(searches: DataFrame, now: datetime | None = None) -> DataFrame:
    """Add ``retrieved_at_utc``: one instant for the whole batch, taken before it is sent."""
    now = now or datetime.now(timezone.utc)
    return searches.withColumn("retrieved_at_utc", stamp_instant(F.timestamp_seconds(F.lit(int(now.timestamp())))))


# What can be wrong with a batch, in the order in which it is reported.
_FAULTS = {
    "nameless": (ValueError, "every search needs a dataset_id, a query and a retrieval stamp"),
    "uncounted": (ValueError, "the number of results is not known"),
    "headless": (RuntimeError, "results are reported without their session"),
    "taken": (FileExistsError, "snapshots exist already or come twice"),
    "several": (ValueError, "several searches for one dataset"),
}


def _check(searches: DataFrame, existing: DataFrame) -> None:
    nameless = is_missing(F.col("dataset_id")) | F.col("snapshot").isNull()
    headless = header_is_broken(F.col("reported_count"), F.col("history_web_env"), F.col("history_query_key"))
    reported = F.col("reported_count")
    found = {
        "nameless": searches.where(nameless).select(*C.KEY),
        "uncounted": searches.where(reported.isNull() | (reported < 0)).select(*C.KEY),
        "headless": searches.where(headless).select(*C.KEY),
        "taken": C.collisions(searches, existing).select(*C.KEY),
        "several": searches.groupBy("dataset_id").agg(F.max("snapshot").alias("snapshot"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(*C.KEY),
    }
    samples = [rows.limit(5).withColumn("fault", F.lit(name)) for name, rows in found.items()]
    rows = reduce(DataFrame.unionByName, samples).collect()
    for name, (kind, message) in _FAULTS.items():
        if names := sorted(str((row.dataset_id, row.snapshot)) for row in rows if row.fault == name):
            raise kind(f"{message}: {', '.join(names)}")


def _open(spark: SparkSession, root: str, names: DataFrame) -> int:
    """Write the names and shards under the next free commit number and return it."""
    last = summary.last_commit(spark, root)
    while True:
        last += 1
        try:
            names.select(*C.KEY, "shard").write.mode("errorifexists").parquet(f"{store.opened_path(root)}/commit_seq={last}")
            return last
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise


@in_scratch
def commit_snapshots(
    spark: SparkSession,
    root: str,
    searches: DataFrame,
    lists: DataFrame,
    value: str = "id",
    *,
    dedup: bool = True,
    canonical_sort: bool = True,
    update_latest: bool = True,
) -> DataFrame:
    """Normalise ``lists(dataset_id, ord, <value>)`` and freeze one snapshot per search.

    Returns the manifests. A name that is taken, here or in the store, raises before
    anything is written. Identifiers are written first and manifests last, so a job
    that dies in between leaves snapshots that are listed but not complete. One
    writer at a time per store.
    """
    searches = stage(complete_searches(searches), "searches")
    asked = stage(searches.select("dataset_id").distinct(), "asked")
    _check(searches, summary.snapshots(spark, root, asked))
    ids = stage(stripped(lists, value), "stripped")
    one = F.lit(1).cast("bigint").alias("copies")
    sizes = stage(measure_distinct(ids) if dedup else measure(ids.select("*", one)), "sizes")
    unasked = sizes.join(searches, "dataset_id", "left_anti")
    if strangers := unasked.limit(5).collect():
        raise ValueError(f"lists without a search: {[row.dataset_id for row in strangers]}")
    searches = stage(assign_shards(searches, sizes), "searches")
    seq = _open(spark, root, searches)

    names = searches.select(*C.KEY, "shard")
    kept = ids.where(F.col("id") != "")
    if dedup and not canonical_sort:
        kept = stable_dedup(kept)
    held = spread_lookup(kept, names, ["dataset_id"], ["id", "ord"]).select(
        # a shard that may be null would be sorted by once more, after the lists
        F.coalesce("shard", F.lit("")).alias("shard"), "dataset_id", "snapshot", "ord", "id"
    )
    if dedup and canonical_sort:
        ordered = sorted_once(held, ["shard", "dataset_id", "snapshot", "id"])
    else:
        by = ["shard", "dataset_id", *list_order(canonical_sort)]
        ordered = held.repartitionByRange(*by).sortWithinPartitions(*by)
    target = f"{store.ids_path(root)}/commit_seq={seq}"
    ordered.write.option("compression", PACKED).partitionBy("shard").parquet(target)
    written = spark.read.schema(store.IDS_SCHEMA).parquet(target).select("dataset_id", "ord", "id")
    if opens([target]):
        flat = stored_digests(spark, target, canonical_sort=canonical_sort)
    else:  # a file system that only Spark knows
        flat = list_digest(written, sizes, canonical_sort=canonical_sort)
    digests = flat.join(tree_digest(written, sizes, distinct=dedup), "dataset_id")
    rows = manifest_rows(
        searches,
        sizes,
        digests,
        dedup=dedup,
        canonical_sort=canonical_sort,
        commit_seq=seq,
        update_latest=update_latest,
    )
    # The number is the directory's name as well; a reader takes it from there.
    write_json(rows.drop("commit_seq"), f"{store.manifests_path(root)}/commit_seq={seq}", mode="errorifexists")
    return summary.of_commits(spark, store.manifests_path(root), [seq], MANIFEST_SCHEMA, "json", mode="FAILFAST")


def _reasons(faulty: list, pages: DataFrame, max_attempts: int | None) -> list[tuple]:
    """What is wrong with a few datasets: the verdict, and where and why reading stopped if requests failed."""
    names = [row.dataset_id for row in faulty]
    failed = failed_datasets(pages.where(F.col("dataset_id").isin(names)), max_attempts=max_attempts)
    ends = {r.dataset_id: (f"offset {r.page_start}", f"{r.attempts} attempts", r.last_error) for r in failed.collect()}
    return [(row.dataset_id, row.verdict, *ends.get(row.dataset_id, ())) for row in faulty]


@in_scratch
def commit_pages(
    spark: SparkSession,
    root: str,
    searches: DataFrame,
    pages: DataFrame,
    *,
    max_attempts: int | None = None,
    dedup: bool = True,
    canonical_sort: bool = True,
    update_latest: bool = True,
) -> DataFrame:
    """Check that the landed pages of every search are whole, then freeze them.

    Pages that are missing, empty or out of line raise, and nothing is written. So do pages
    without a search. The error says at which offset requests failed to the last, how often,
    and with which error.
    """
    reported = F.col("reported_count")
    if uncounted := searches.where(reported.isNull() | (reported < 0)).limit(5).collect():
        raise ValueError(f"the number of results is not known: {[row.dataset_id for row in uncounted]}")
    if strangers := pages.select("dataset_id").distinct().join(searches, "dataset_id", "left_anti").limit(5).collect():
        raise ValueError(f"pages without a search: {[row.dataset_id for row in strangers]}")
    verdicts = stage(P.page_verdict(pages, searches, max_attempts=max_attempts), "verdicts")
    if faulty := verdicts.where(F.col("verdict") != P.OK).limit(5).collect():
        raise RuntimeError(f"pages are not whole: {_reasons(faulty, pages, max_attempts)}")
    reported = searches.select("dataset_id", "reported_count")
    read = P.first_success(pages, max_attempts=max_attempts)
    # A page at or past the reported count is never asked for.
    asked = spread_lookup(read, stage(reported, "reported"), ["dataset_id"], ["page_start"])
    lists = P.flatten_pages(asked.where(F.col("page_start") < F.col("reported_count")))
    return commit_snapshots(
        spark, root, searches, lists, dedup=dedup, canonical_sort=canonical_sort, update_latest=update_latest
    )
