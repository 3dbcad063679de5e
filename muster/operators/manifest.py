"""Manifest rows: what is known of a snapshot besides its identifiers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import naming as N
from muster.functions import requests as R

MANIFEST_COLUMNS = {
    "dataset_id": "string",
    "database_name": "string",
    "search_query": "string",
    "translated_query": "string",
    "identifier_type": "string",
    "retrieved_at_utc": "string",
    "reported_count": "bigint",
    "raw_count": "bigint",
    "normalized_count": "bigint",
    "dedup": "boolean",
    "canonical_sort": "boolean",
    "ids_sha256": "string",
    "ids_tree_sha256": "string",
    "page_size": "int",
    "request_delay_seconds": "double",
    "max_retry_attempts": "int",
    "history_web_env": "string",
    "history_query_key": "string",
    "engine_version": "string",
    "snapshot_format_version": "string",
    "snapshot_file_name": "string",
    "manifest_file_name": "string",
    "snapshot": "string",
    "snapshot_relative_path": "string",
    "commit_seq": "bigint",
    "update_latest": "boolean",
}
MANIFEST_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in MANIFEST_COLUMNS.items())

# What the lists hold unless the search says otherwise.
DATABASE_NAME = "protein"
IDENTIFIER_TYPE = "uid"

# The optional columns of a search, with the value a missing one takes.
SEARCH_DEFAULTS = {
    "database_name": (DATABASE_NAME, "string"),
    "identifier_type": (IDENTIFIER_TYPE, "string"),
    "translated_query": (None, "string"),
    "history_web_env": (None, "string"),
    "history_query_key": (None, "string"),
    "page_size": (R.DEFAULT_PAGE_SIZE, "int"),
    "request_delay_seconds": (R.DELAY_WITHOUT_KEY, "double"),
    "max_retry_attempts": (R.DEFAULT_MAX_ATTEMPTS, "int"),
}
SEARCH_REQUIRED = ("dataset_id", "search_query", "reported_count", "retrieved_at_utc")


def complete_searches(searches: DataFrame) -> DataFrame:
    """Add the optional columns that are absent, their defaults where they are null, and the snapshot name."""
    given = {name: F.col(name) for name in SEARCH_REQUIRED}
    for name, (value, kind) in SEARCH_DEFAULTS.items():
        default = F.lit(value).cast(kind)
        given[name] = F.coalesce(F.col(name).cast(kind), default) if name in searches.columns else default
    return searches.select(
        *(column.alias(name) for name, column in given.items()),
        N.snapshot_name(F.col("retrieved_at_utc"), F.col("search_query")).alias("snapshot"),
    )


# Lists from this size on, as lines of text, get a directory of their own.
SHARD_BYTES = 256 << 20


def assign_shards(searches: DataFrame, sizes: DataFrame, *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``shard``, the directory of each list: its own for a long list, a shared one for short lists.

    So the number of files follows the bytes stored and not the number of datasets.
    ``sizes(dataset_id, n_bytes)`` is staged by the caller.
    """
    short = F.col("n_bytes") < shard_bytes
    short_bytes = sizes.where(short).agg(F.sum("n_bytes")).first()[0] or 0
    shared = F.pmod(F.xxhash64("dataset_id"), F.lit(max(1, math.ceil(short_bytes / shard_bytes))))
    # A name of any length must not make a directory name too long for the file system.
    own = F.concat(F.lit("list-"), F.substring(F.sha2("dataset_id", 256), 1, 32))
    shard = F.when(F.col("n_bytes") >= shard_bytes, own).otherwise(
        F.concat(F.lit("mixed-"), shared.cast("string"))
    )
    joined = searches.join(sizes.select("dataset_id", "n_bytes"), "dataset_id", "left")
    return joined.withColumn("shard", shard).drop("n_bytes")


def manifest_rows(
    searches: DataFrame,
    counts: DataFrame,
    digests: DataFrame,
    *,
    dedup: bool,
    canonical_sort: bool,
    commit_seq: int = 0,
    update_latest: bool = True,
) -> DataFrame:
    """One row per search of ``complete_searches``, in the order of ``MANIFEST_COLUMNS``.

    ``searches`` carries the ``shard`` of each list as well; see ``assign_shards``.
    ``counts(dataset_id, raw_count, normalized_count)`` and ``digests(dataset_id,
    ids_sha256, ids_tree_sha256)`` may lack the datasets without results.
    """
    spark = searches.sparkSession
    nothing = F.lit(0).cast("bigint")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    derived = {
        "raw_count": F.coalesce("raw_count", nothing),
        "normalized_count": F.coalesce("normalized_count", nothing),
        "dedup": F.lit(dedup),
        "canonical_sort": F.lit(canonical_sort),
        "ids_sha256": F.coalesce("ids_sha256", empty),
        "ids_tree_sha256": F.coalesce("ids_tree_sha256", empty),
        "engine_version": F.lit(spark.version),
        "snapshot_format_version": F.lit(N.FORMAT_VERSION),
        "snapshot_file_name": F.lit(N.IDS_TABLE),
        "manifest_file_name": F.lit(N.MANIFESTS_TABLE),
        "snapshot_relative_path": N.stored_path(F.lit(commit_seq), F.col("shard")),
        "commit_seq": F.lit(commit_seq),
        "update_latest": F.lit(update_latest),
    }
    joined = searches.join(counts, "dataset_id", "left").join(digests, "dataset_id", "left")
    return joined.select(
        *(derived.get(name, F.col(name)).cast(kind).alias(name) for name, kind in MANIFEST_COLUMNS.items())
    )
