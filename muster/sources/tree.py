"""Snapshot directories written as plain files, one tree per dataset.

    <root>/<dataset_id>/latest/{manifest.json, ids.txt}
    <root>/<dataset_id>/snapshots/<snapshot>/{manifest.json, ids.txt}

For taking over snapshots that another tool has made. The file names are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions import naming as N
from muster.sources.files import list_files
from muster.sources.lines import read_lines

_PLACE = rf"/([^/]+)/(?:{N.SNAPSHOTS_DIR}/([^/]+)|{N.LATEST_DIR})/[^/]+$"


def _dataset(path: Column) -> Column:
    return F.regexp_extract(path, _PLACE, 1)


def _snapshot(path: Column) -> Column:
    """The snapshot's name; empty text for the latest copy."""
    return F.regexp_extract(path, _PLACE, 2)


def _decoded(path: Column) -> Column:
    # Metadata paths are percent-encoded; a plus sign in them is a plus sign.
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def tree_files(
    spark: SparkSession, root: str, *, manifest_file: str = N.MANIFEST_FILE, ids_file: str = N.IDS_FILE
) -> DataFrame:
    """``(dataset_id, snapshot, has_manifest, has_ids)`` of every directory that holds a file."""
    files = list_files(spark, root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.where(F.col("path").rlike(_PLACE))
        .groupBy(_dataset(F.col("path")).alias("dataset_id"), _snapshot(F.col("path")).alias("snapshot"))
        .agg(F.max(name == manifest_file).alias("has_manifest"), F.max(name == ids_file).alias("has_ids"))
    )


def tree_manifests(
    spark: SparkSession, root: str, schema: str, *, manifest_file: str = N.MANIFEST_FILE
) -> DataFrame:
    """``(dataset_id, snapshot, …)``: the named keys of every manifest."""
    rows = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", manifest_file)
        .json(root)
        .withColumn("_path", _decoded(F.col("_metadata.file_path")))
    )
    keys = [c for c in rows.columns if c != "_path"]
    return rows.select(_dataset(F.col("_path")).alias("dataset_id"), _snapshot(F.col("_path")).alias("snapshot"), *keys)


def tree_identifiers(spark: SparkSession, root: str, *, ids_file: str = N.IDS_FILE) -> DataFrame:
    """``(dataset_id, snapshot, ord, id)`` of every list, stripped and without blanks, as it stands."""
    lines = read_lines(spark, root, recursiveFileLookup="true", pathGlobFilter=ids_file)
    path = _decoded(F.col("file"))
    return lines.select(
        _dataset(path).alias("dataset_id"), _snapshot(path).alias("snapshot"), "ord", F.col("value").alias("id")
    )


def tree_state(files: DataFrame) -> DataFrame:
    """Per dataset: is the latest copy there, and is it complete? For ``resolve_requests``."""
    latest = files.where(F.col("snapshot") == "")
    return latest.select(
        "dataset_id",
        F.lit(N.LATEST_DIR).alias("snapshot"),
        F.lit(True).alias("has_latest"),
        "has_manifest",
        "has_ids",
        (F.col("has_manifest") & F.col("has_ids")).alias("available"),
    )


def tree_paths(files: DataFrame, root: str) -> DataFrame:
    """Add ``directory``, ``manifest_path`` and ``ids_path``."""
    base = F.concat_ws("/", F.lit(root), F.col("dataset_id"))
    directory = F.when(F.col("snapshot") == "", N.latest_dir(base)).otherwise(N.snapshot_dir(base, F.col("snapshot")))
    return (
        files.withColumn("directory", directory)
        .withColumn("manifest_path", N.manifest_path(F.col("directory")))
        .withColumn("ids_path", N.ids_path(F.col("directory")))
    )


def load_tree(
    spark: SparkSession, root: str, schema: str, *, manifest_file: str = N.MANIFEST_FILE, ids_file: str = N.IDS_FILE
) -> tuple[DataFrame, DataFrame]:
    """``(manifests, identifiers)`` of every directory; one that lacks a file raises FileNotFoundError."""
    files = tree_files(spark, root, manifest_file=manifest_file, ids_file=ids_file)
    missing = files.where(~(F.col("has_manifest") & F.col("has_ids"))).orderBy("dataset_id", "snapshot").limit(5).collect()
    if missing:
        raise FileNotFoundError(f"a manifest or a list is missing: {[(r.dataset_id, r.snapshot) for r in missing]}")
    return tree_manifests(spark, root, schema, manifest_file=manifest_file), tree_identifiers(spark, root, ids_file=ids_file)
