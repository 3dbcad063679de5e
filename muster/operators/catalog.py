"""Which snapshots exist, which one is latest, and what a request comes to.

Snapshots are keyed by ``(dataset_id, snapshot)``. Manifest rows carry
``commit_seq``, which grows from commit to commit, and ``update_latest``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import requests as R
from muster.operators.lookup import spread_lookup
from muster.shared import stage

KEY = ["dataset_id", "snapshot"]

# What a request comes to, besides an invalid mode.
REUSE = "reuse"
CREATE = "create"
INVALID_MODE = "invalid_mode"
NO_LATEST = "no_latest"
NO_MANIFEST = "no_manifest"
NO_IDS = "no_ids"
EMAIL_REQUIRED = "email_required"


def list_snapshots(ids: DataFrame, manifests: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """``(dataset_id, snapshot, has_ids, has_manifest, complete)`` of every snapshot begun.

    ``ids`` and ``opened`` need only the key columns. A snapshot of an empty list has
    no identifier rows; its manifest says so.
    """
    no = F.lit(False)
    parts = [
        ids.select(*KEY).distinct().withColumn("_ids", F.lit(True)),
        manifests.select(*KEY, (F.col("normalized_count") == 0).alias("_empty"), F.lit(True).alias("_manifest")),
    ]
    if opened is not None:
        parts.append(opened.select(*KEY).distinct())
    joined = reduce(lambda left, right: left.join(right, KEY, "full_outer"), parts)
    has_ids = F.coalesce(F.col("_ids"), F.col("_empty"), no)
    has_manifest = F.coalesce(F.col("_manifest"), no)
    return joined.select(
        *KEY,
        has_ids.alias("has_ids"),
        has_manifest.alias("has_manifest"),
        (has_ids & has_manifest).alias("complete"),
    )


def latest_pointer(manifests: DataFrame) -> DataFrame:
    """``(dataset_id, snapshot)``: the last snapshot saved as latest, whatever its name."""
    saved = manifests.where("update_latest")
    return saved.groupBy("dataset_id").agg(F.max_by("snapshot", "commit_seq").alias("snapshot"))


def most_recent_snapshot(listing: DataFrame, *, complete_only: bool = False) -> DataFrame:
    """``(dataset_id, snapshot)``: the last by name, complete or not unless asked."""
    if complete_only:
        listing = listing.where("complete")
    return listing.groupBy("dataset_id").agg(F.max("snapshot").alias("snapshot"))


def most_recent_snapshots(listing: DataFrame) -> DataFrame:
    """``(dataset_id, snapshot, snapshot_complete)``: the last by name, and the last that is complete."""
    return listing.groupBy("dataset_id").agg(
        F.max("snapshot").alias("snapshot"), F.max(F.when(F.col("complete"), F.col("snapshot"))).alias("snapshot_complete")
    )


def latest_state(datasets: DataFrame, pointers: DataFrame, listing: DataFrame) -> DataFrame:
    """``(dataset_id, snapshot, has_latest, has_manifest, has_ids, available)`` per dataset."""
    no = F.lit(False)
    found = (
        datasets.select("dataset_id")
        .distinct()
        .join(pointers, "dataset_id", "left")
        .join(listing.select(*KEY, "has_ids", "has_manifest"), KEY, "left")
    )
    has_latest = F.col("snapshot").isNotNull()
    has_manifest = F.coalesce("has_manifest", no)
    has_ids = F.coalesce("has_ids", no)
    return found.select(
        "dataset_id",
        "snapshot",
        has_latest.alias("has_latest"),
        has_manifest.alias("has_manifest"),
        has_ids.alias("has_ids"),
        (has_latest & has_manifest & has_ids).alias("available"),
    )


def resolve_requests(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Add ``outcome`` and, for a reuse, ``snapshot`` to ``(dataset_id, mode, has_email, …)``.

    A reuse asks for no email and does not compare the request with what is stored.
    """
    facts = state.select("dataset_id", "snapshot", "has_latest", "has_manifest", "has_ids", "available")
    joined = spread_lookup(requests, stage(facts, "state"), ["dataset_id"], requests.columns, how="left")
    no = F.lit(False)
    available = F.coalesce("available", no)
    mode = F.col("mode")
    outcome = (
        F.when(~R.mode_is_valid(mode), INVALID_MODE)
        .when(mode.isin(R.REUSE_LATEST, R.REUSE_LATEST_OR_CREATE) & available, REUSE)
        .when((mode == R.REUSE_LATEST) & ~F.coalesce("has_latest", no), NO_LATEST)
        .when((mode == R.REUSE_LATEST) & ~F.coalesce("has_manifest", no), NO_MANIFEST)
        .when(mode == R.REUSE_LATEST, NO_IDS)
        .when(~F.coalesce("has_email", no), EMAIL_REQUIRED)
        .otherwise(CREATE)
    )
    return joined.select(
        *requests.columns,
        outcome.alias("outcome"),
        F.when(outcome == REUSE, F.col("snapshot")).alias("snapshot"),
    )


def with_staleness(resolved: DataFrame, manifests: DataFrame) -> DataFrame:
    """Add ``stale``: the reused snapshot was made from another query than the one requested."""
    stored = manifests.select(*KEY, F.col("search_query").alias("_stored"))
    joined = resolved.join(stored, KEY, "left")
    stale = F.when(F.col("outcome") == REUSE, ~F.col("_stored").eqNullSafe(F.col("search_query")))
    return joined.select(*resolved.columns, stale.alias("stale"))


def collisions(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(dataset_id, snapshot, n)`` of names used twice in ``new`` or already taken."""
    batch = new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    if existing is None:
        return batch.where(F.col("n") > 1)
    taken = existing.select(*KEY).distinct().withColumn("_taken", F.lit(True))
    clash = (F.col("n") > 1) | F.col("_taken").isNotNull()
    return batch.join(taken, KEY, "left").where(clash).select(*KEY, "n")


def snapshot_report(manifests: DataFrame, ids: DataFrame) -> DataFrame:
    """What one wants to see of each snapshot: where it is, how long, from when, of what, which digest."""
    counts = ids.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_ids"))
    return manifests.join(counts, KEY, "left").select(
        *KEY,
        "snapshot_relative_path",
        F.coalesce("n_ids", F.lit(0).cast("bigint")).alias("n_ids"),
        "retrieved_at_utc",
        "search_query",
        "translated_query",
        "ids_sha256",
    )
