"""The catalog by increments: a summary of all commits up to one, and the few that came after it.

    <root>/catalog/upto=<n>/slices=<m>/slice=<s>/  a row per snapshot, sorted by dataset  (parquet)
    <root>/catalog/upto=<n>/pending/               numbers up to n that are not settled   (parquet)

A commit is settled once every name it began has its manifest; then nothing about it changes any more. A summary holds
the settled commits, in slices by a hash of the dataset, so a question about a few datasets opens their slices only. Commits
that are not settled, and those after the summary, are read from their own folders. So the answer is the same with any
summary or none; what a summary saves is files. Each is made of the one before and never changed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions import naming as N
from muster.operators import catalog as C
from muster.operators.lookup import spread_lookup
from muster.operators.manifest import MANIFEST_COLUMNS, MANIFEST_SCHEMA
from muster.plans import store
from muster.shared import child_names, in_scratch, path_exists, read_or_empty, replace_path, scratch, stage
from muster.sources.files import open_path, tasks_for
from muster.sources.lines import opens

SLICE_ROWS = 100_000
MOST_SLICES = 10_000
NAMED_SLICES = 100  # up to so many slices are opened by their paths, more by a filter on their folder
ROW_SCHEMA = f"{MANIFEST_SCHEMA}, shard string, has_manifest boolean"
_PLACES = "commit_seq bigint, shard string"


class Summary(NamedTuple):
    """The newest summary: the last commit in it, its slices, and the commits up to it that it does not hold."""

    upto: int
    slices: int
    folder: str
    pending: list[int]


def catalog_path(root: str) -> str:
    return f"{root}/catalog"


def newest(spark: SparkSession, root: str) -> Summary:
    """The newest summary of a store; without one, the summary of no commit."""
    numbers = [int(name[5:]) for name in child_names(spark, catalog_path(root)) if name.startswith("upto=")]
    if not numbers:
        return Summary(0, 0, "", [])
    folder = f"{catalog_path(root)}/upto={max(numbers)}"
    (slices,) = (int(name[7:]) for name in child_names(spark, folder) if name.startswith("slices="))
    pending = spark.read.schema("commit_seq bigint").parquet(f"{folder}/pending").collect()
    return Summary(max(numbers), slices, f"{folder}/slices={slices}", sorted(row[0] for row in pending))


def commits_after(spark: SparkSession, root: str, number: int) -> list[int]:
    """The commits begun after ``number``. Numbers are taken one by one, so the first that is free ends them."""
    found = []
    while path_exists(spark, f"{store.opened_path(root)}/commit_seq={number + 1 + len(found)}"):
        found.append(number + 1 + len(found))
    return found


def last_commit(spark: SparkSession, root: str) -> int:
    """The number of the last commit begun, 0 if there is none."""
    upto = newest(spark, root).upto
    return max([upto, *commits_after(spark, root, upto)])


def of_commits(spark: SparkSession, path: str, numbers: list[int], schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """What some commits wrote below ``path``. No other commit's folder is listed; one that is not there has no rows."""
    folders = [place for n in numbers if path_exists(spark, place := f"{path}/commit_seq={n}")]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).options(basePath=path, **options).load(folders)


def _begun(spark: SparkSession, root: str, numbers: list[int]) -> DataFrame:
    """The snapshots begun by some commits, with the manifests of those that have one."""
    names = of_commits(spark, store.opened_path(root), numbers, store.OPENED_SCHEMA)
    documents = of_commits(spark, store.manifests_path(root), numbers, MANIFEST_SCHEMA, "json", mode="FAILFAST")
    joined = names.join(documents.withColumn("has_manifest", F.lit(True)), [*C.KEY, "commit_seq"], "full_outer")
    return joined.select(*MANIFEST_COLUMNS, "shard", F.coalesce("has_manifest", F.lit(False)).alias("has_manifest"))


def _slice(slices: int) -> Column:
    return F.pmod(F.xxhash64("dataset_id"), F.lit(slices)).cast("int")


def _summarized(spark: SparkSession, known: Summary, asked: DataFrame | None = None) -> DataFrame:
    """The rows of a summary, of the slices that ``asked(dataset_id)`` falls in."""
    schema = f"{ROW_SCHEMA}, slice int"
    if not known.slices:
        return spark.createDataFrame([], ROW_SCHEMA)
    reader = spark.read.schema(schema).option("basePath", known.folder)
    if asked is None:
        return reader.parquet(known.folder).drop("slice")
    wanted = sorted(row[0] for row in asked.select(_slice(known.slices)).distinct().collect())  # at most MOST_SLICES numbers
    if len(wanted) > NAMED_SLICES:
        return reader.parquet(known.folder).where(F.col("slice").isin(wanted)).drop("slice")
    paths = [place for s in wanted if path_exists(spark, place := f"{known.folder}/slice={s}")]
    return reader.parquet(*paths).drop("slice") if paths else spark.createDataFrame([], ROW_SCHEMA)


def snapshots(spark: SparkSession, root: str, asked: DataFrame | None = None) -> DataFrame:
    """Every snapshot begun, or those of ``asked(dataset_id)``: its manifest columns, ``shard`` and ``has_manifest``.

    The columns of a manifest that is not there are null. ``asked`` is staged and has a row a dataset.
    """
    known = newest(spark, root)
    late = [*known.pending, *commits_after(spark, root, known.upto)]
    rows = _summarized(spark, known, asked).unionByName(_begun(spark, root, late))
    return rows if asked is None else rows.join(asked.select("dataset_id"), "dataset_id", "left_semi")


@in_scratch
def summarize(spark: SparkSession, root: str, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Write the summary up to the last commit, and return its rows.

    Only what the newest summary does not hold is read from the folders of commits. A commit that is still being
    written, or died, is noted as pending and read from its folder until a later summary finds it settled. The summary
    is there at once, by a rename; without a new commit nothing is written. Slices grow in number with the
    snapshots, to about ``slice_rows`` each, and one hot dataset may fill several files of its slice.
    """
    known = newest(spark, root)
    after = commits_after(spark, root, known.upto)
    if not after:
        return _summarized(spark, known)
    late = [*known.pending, *after]
    begun = stage(_begun(spark, root, late), "begun")
    whole = begun.groupBy("commit_seq").agg(F.min("has_manifest").alias("whole")).where("whole").collect()  # a row a late commit
    settled = sorted(row.commit_seq for row in whole)
    rows = _summarized(spark, known).unionByName(begun.where(F.col("commit_seq").isin(settled)))
    slices = max(1, min(MOST_SLICES, math.ceil(rows.count() / slice_rows)))
    made = f"{catalog_path(root)}/.made-{uuid.uuid4().hex}"
    pending = spark.createDataFrame([(n,) for n in sorted(set(late) - set(settled))], "commit_seq bigint")
    pending.coalesce(1).write.parquet(f"{made}/pending")
    by = ["slice", *C.KEY]
    dealt = rows.withColumn("slice", _slice(slices)).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt.write.partitionBy("slice").parquet(f"{made}/slices={slices}")
    replace_path(spark, made, f"{catalog_path(root)}/upto={after[-1]}")
    return _summarized(spark, newest(spark, root))


def _holding_files(root: str):
    """The step that keeps the places ``(commit_seq, shard, directory)`` whose directory holds a file."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kept = []
            for directory in batch.column("directory").to_pylist():
                files, at = open_path(f"{root}/{directory}")
                found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
                kept.append(any(f.is_file and not f.base_name.startswith(("_", ".")) for f in found))
            yield batch.filter(pa.array(kept, pa.bool_())).select(["commit_seq", "shard"])

    return run


def _written(spark: SparkSession, root: str, places: DataFrame) -> DataFrame:
    """Those of ``places(commit_seq, shard)`` that hold identifier files. Directories are dealt over tasks; no other is listed."""
    if opens([root]):
        named = places.withColumn("directory", N.stored_path(F.col("commit_seq"), F.col("shard")))
        return named.repartition(tasks_for(spark, places.count())).mapInArrow(_holding_files(root), _PLACES)
    # a file system that only Spark knows
    listed = read_or_empty(spark, store.ids_path(root), "path string", "binaryFile", recursiveFileLookup="true").select(
        F.regexp_extract("path", r"/(commit_seq=\d+/shard=[^/]+)/[^/]+$", 1).alias("directory")
    )
    place = F.concat(F.lit(f"{N.IDS_TABLE}/"), F.col("directory"))
    found = listed.distinct().select(place.alias("directory"))
    return places.withColumn("directory", N.stored_path(F.col("commit_seq"), F.col("shard"))).join(found, "directory", "left_semi").drop("directory")


def with_ids(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Add ``has_ids`` and ``complete`` to rows of ``snapshots``: whether the identifiers are there now, or the list is empty."""
    rows = stage(rows, "begun")
    places = stage(rows.where(F.col("shard").isNotNull()).select(*store.PLACE).distinct(), "asked-places")
    written = stage(_written(spark, root, places), "written").withColumn("_written", F.lit(True))
    has_ids = F.coalesce("_written", F.col("has_manifest") & (F.col("normalized_count") == 0), F.lit(False))
    found = rows.join(written, store.PLACE, "left").withColumn("has_ids", has_ids).drop("_written")
    return found.withColumn("complete", F.col("has_ids") & F.col("has_manifest"))


def latest_state(spark: SparkSession, root: str, datasets: DataFrame) -> DataFrame:
    """Whether each of ``datasets(dataset_id)`` has a complete latest snapshot, and which; see ``store.latest_state``.

    Opens the slices of these datasets and the commits since the summary, and looks for the identifiers of the latest
    snapshots only.
    """
    asked = stage(datasets.select("dataset_id").distinct(), "asked")
    begun = stage(snapshots(spark, root, asked), "begun")
    pointers = stage(C.latest_pointer(begun.where("has_manifest")), "pointers")
    listed = with_ids(spark, root, begun.join(pointers, C.KEY, "left_semi"))
    return C.latest_state(asked, pointers, listed)


def snapshot_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every snapshot begun, with ``has_ids``, ``has_manifest``, ``complete`` and ``is_latest``."""
    begun = stage(snapshots(spark, root), "begun")
    pointers = C.latest_pointer(begun.where("has_manifest")).withColumn("_latest", F.lit(True))
    listed = with_ids(spark, root, begun).join(pointers, C.KEY, "left")
    return listed.withColumn("is_latest", F.coalesce("_latest", F.lit(False))).drop("_latest")


def load_snapshots(spark: SparkSession, root: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(manifests, identifiers)`` of ``wanted(dataset_id, snapshot)``, as ``store.load_snapshots`` returns them.

    Only the commits that hold these snapshots are listed, and within them only their shards read.
    """
    wanted = stage(wanted.select(*C.KEY).distinct(), "wanted", keep=True)
    with scratch(spark):
        asked = stage(wanted.select("dataset_id").distinct(), "asked")
        found = stage(snapshots(spark, root, asked).join(wanted, C.KEY, "left_semi"), "active", keep=True)
        complete = with_ids(spark, root, found).where("complete")
        missing = wanted.join(complete, C.KEY, "left_anti").orderBy(*C.KEY).limit(5).collect()
    if missing:
        raise FileNotFoundError(f"no complete snapshot: {[tuple(row) for row in missing]}")
    places = stage(found.select(*C.KEY, *store.PLACE), "places", keep=True)
    numbers = [row[0] for row in places.select("commit_seq").distinct().collect()]  # a number a commit
    # as in store.load_snapshots: the comparison makes the places a filter that prunes directories
    places = places.where(F.col("commit_seq") > 0)
    stored = of_commits(spark, store.ids_path(root), sorted(numbers), store.IDS_SCHEMA)
    ids = spread_lookup(stored, places, [*C.KEY, *store.PLACE], ["id", "ord"])
    documents = store.with_paths(found.select(*MANIFEST_COLUMNS), root)
    return documents, ids.select("dataset_id", "snapshot", "ord", "id")
