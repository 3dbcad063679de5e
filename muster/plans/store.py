"""Where snapshots are kept, and how they are read.

    <root>/opened/commit_seq=<n>/      names begun by commit n          (parquet)
    <root>/ids/commit_seq=<n>/shard=<s>/  identifiers, sorted by list  (parquet)
    <root>/manifests/commit_seq=<n>/   one JSON document per snapshot

A snapshot is there for readers once its manifest is. Nothing is ever overwritten.
A long list is a shard of its own, and short lists share shards of some size; within
a shard the row groups are sorted by dataset, so their statistics tell lists apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions import naming as N
from muster.operators import catalog as C
from muster.operators.lookup import spread_lookup
from muster.operators.manifest import MANIFEST_SCHEMA
from muster.shared import read_or_empty, stage

IDS_SCHEMA = "dataset_id string, snapshot string, ord bigint, id string, commit_seq bigint, shard string"
_FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
_FILE_PLACE = r"/commit_seq=(\d+)/shard=([^/]+)/[^/]+$"
OPENED_SCHEMA = "dataset_id string, snapshot string, shard string, commit_seq bigint"
PLACE = ["commit_seq", "shard"]


def opened_path(root: str) -> str:
    return f"{root}/opened"


def ids_path(root: str) -> str:
    return f"{root}/{N.IDS_TABLE}"


def manifests_path(root: str) -> str:
    return f"{root}/{N.MANIFESTS_TABLE}"


def opened(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, opened_path(root), OPENED_SCHEMA)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Every manifest under ``root``; no snapshot yet reads as no rows, a damaged one raises."""
    return read_or_empty(spark, manifests_path(root), MANIFEST_SCHEMA, "json", mode="FAILFAST")


def identifiers(spark: SparkSession, root: str, dataset_id: str | None = None, snapshot: str | None = None) -> DataFrame:
    """``(dataset_id, snapshot, ord, id)`` as stored; the arguments prune directories and row groups."""
    ids = read_or_empty(spark, ids_path(root), IDS_SCHEMA)
    if dataset_id is not None:
        # The few places of one dataset, as constants.
        found = opened(spark, root).where(F.col("dataset_id") == dataset_id)
        if snapshot is not None:
            found = found.where(F.col("snapshot") == snapshot)
        places = found.select(*PLACE).distinct().collect()
        ids = ids.where(F.col("commit_seq").isin([p.commit_seq for p in places]))
        ids = ids.where(F.col("shard").isin([p.shard for p in places]) & (F.col("dataset_id") == dataset_id))
    if snapshot is not None:
        ids = ids.where(F.col("snapshot") == snapshot)
    return ids.select("dataset_id", "snapshot", "ord", "id")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Every snapshot begun under ``root``; see ``list_snapshots``.

    The identifier files are listed and not opened: one row per file.
    """
    begun = opened(spark, root)
    files = read_or_empty(spark, ids_path(root), _FILES_SCHEMA, "binaryFile", recursiveFileLookup="true")
    places = files.select(
        F.regexp_extract("path", _FILE_PLACE, 1).try_cast("bigint").alias("commit_seq"),
        F.regexp_extract("path", _FILE_PLACE, 2).alias("directory"),
    ).distinct()
    named = begun.withColumn("directory", N.partition_value(F.col("shard")))
    written = named.join(places, ["commit_seq", "directory"], "left_semi")
    return C.list_snapshots(written, manifests(spark, root), begun)


def with_paths(manifests: DataFrame, root: str) -> DataFrame:
    """Add ``snapshot_directory``, ``manifest_path`` and ``ids_path`` to manifests of this store."""
    below = F.lit(f"{root}/")
    directory = F.concat(below, F.col("snapshot_relative_path"))
    return manifests.withColumns(
        {
            "snapshot_directory": directory,
            "manifest_path": F.concat(below, N.stored_manifest_path(F.col("commit_seq"))),
            "ids_path": directory,
        }
    )


def latest_state(spark: SparkSession, root: str, datasets: DataFrame | None = None) -> DataFrame:
    """Whether each dataset has a complete latest snapshot, and which."""
    stored, listed = manifests(spark, root), listing(spark, root)
    if datasets is None:
        return C.latest_state(stored, C.latest_pointer(stored), listed)
    # Only what is asked for goes into the pointer and the joins.
    asked = stage(datasets.select("dataset_id").distinct(), "asked")
    stored, listed = (rows.join(asked, "dataset_id", "left_semi") for rows in (stored, listed))
    return C.latest_state(asked, C.latest_pointer(stored), listed)


def snapshot_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The listing with the manifest columns and ``is_latest``."""
    stored = manifests(spark, root)
    pointers = C.latest_pointer(stored).withColumn("_latest", F.lit(True))
    return (
        listing(spark, root)
        .join(stored, C.KEY, "left")
        .join(pointers, C.KEY, "left")
        .withColumn("is_latest", F.coalesce("_latest", F.lit(False)))
        .drop("_latest")
    )


def load_snapshots(spark: SparkSession, root: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(manifests, identifiers)`` of the snapshots named in ``wanted(dataset_id, snapshot)``.

    A name that is not stored completely raises FileNotFoundError. The manifests come
    with the paths of each snapshot. The identifiers are as stored: not normalised
    and not checked again.
    """
    wanted = stage(wanted.select(*C.KEY).distinct(), "wanted")
    complete = listing(spark, root).where("complete")
    missing = wanted.join(complete, C.KEY, "left_anti").orderBy(*C.KEY).limit(5).collect()
    if missing:
        raise FileNotFoundError(f"no complete snapshot: {[tuple(row) for row in missing]}")
    found = manifests(spark, root).join(wanted, C.KEY, "left_semi")
    places = stage(opened(spark, root).join(wanted, C.KEY, "left_semi").select(*C.KEY, *PLACE), "places")
    # The comparison holds for every number; it tells Spark that the rows select
    # directories, so a broadcast of them prunes the scan.
    places = places.where(F.col("commit_seq") > 0)
    ids = spread_lookup(read_or_empty(spark, ids_path(root), IDS_SCHEMA), places, [*C.KEY, *PLACE], ["id", "ord"])
    return with_paths(found, root), ids.select("dataset_id", "snapshot", "ord", "id")


def load_latest(spark: SparkSession, root: str, datasets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The latest snapshot of each dataset, or of those in ``datasets(dataset_id)``.

    A dataset asked for that has no complete latest snapshot raises FileNotFoundError.
    """
    state = stage(latest_state(spark, root, datasets), "latest")
    missing = state.where(~F.col("available")).orderBy("dataset_id").limit(5).collect()
    if missing:
        raise FileNotFoundError(f"no latest snapshot: {[row.dataset_id for row in missing]}")
    return load_snapshots(spark, root, state)


def register_views(spark: SparkSession, root: str) -> None:
    """Name the store for SQL: ``identifiers`` and ``snapshot_catalog``."""
    identifiers(spark, root).createOrReplaceTempView("identifiers")
    snapshot_catalog(spark, root).createOrReplaceTempView("snapshot_catalog")
