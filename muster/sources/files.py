"""Files as bytes, listed and read by tasks.

Paths are opened with Arrow's file systems, which neither decompress nor decode. So a file
of any size and any extension is read in the same way, a block at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.shared import stage

BLOCK = 8 << 20
LISTING = "path string, length bigint"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it. Names are taken as they are, not percent-decoded."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    scheme, mark, rest = path.partition("://")
    if not mark:
        raise ValueError(f"not an absolute path: {path}")
    authority, _, place = rest.partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{root.rstrip('/')}/{place}" if root.strip("/") or scheme in ("hdfs", "viewfs") else place


def _prefix(path: str) -> str:
    """What comes before the paths a file system lists, in the form Spark names files."""
    if path.startswith("file:") or path.startswith("/"):
        return "file:"
    scheme, _, rest = path.partition("://")
    # object stores list their buckets as the first part of a path, others do not
    return f"{scheme}://" if scheme in ("s3", "gs", "gcs", "abfs", "abfss") else f"{scheme}://{rest.partition('/')[0]}"


LISTED = 1 << 12  # names of a batch
TASKS = 10_000  # at most so many tasks a level
DEALT = 64  # directories or files of a task, where there are many
DEALT_BYTES = 128 << 20  # of files that are read


def _children(pattern: str):
    """The step that lists directories: their files, and their directories with a null length."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path in batch.column(0).to_pylist():
                store, at = open_path(path)
                found = store.get_file_info(fs.FileSelector(at))
                named = [f for f in found if not f.base_name.startswith(("_", "."))]
                kept = [f for f in named if f.type == fs.FileType.Directory or (f.is_file and fnmatch(f.base_name, pattern))]
                for start in range(0, len(kept), LISTED):
                    some, prefix = kept[start : start + LISTED], _prefix(path)
                    names = pa.array([prefix + f.path for f in some], pa.string())
                    sizes = pa.array([f.size if f.is_file else None for f in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([names, sizes], names=["path", "length"])

    return run


def tasks_for(spark: SparkSession, n: int, n_bytes: int = 0) -> int:
    """Tasks for ``n`` directories or files: a task costs more than a look at a few of them, so many share one."""
    share = max(min(n, 2 * spark.sparkContext.defaultParallelism), -(-n // DEALT), min(n, -(-n_bytes // DEALT_BYTES)))
    return max(1, min(TASKS, share))


def deal_files(files: DataFrame) -> DataFrame:
    """``files(path, length, …)`` dealt over tasks by number and weight."""
    files = stage(files, "dealt")
    found = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return files.repartition(tasks_for(files.sparkSession, *found), "path")


def list_files(spark: SparkSession, path: str | list[str], *, pattern: str = "*") -> DataFrame:
    """``(path, length)`` of all files under each of ``path``, empty ones too.

    Level by level: the directories of a level are dealt over tasks, some ``DEALT`` to each where they are many, and what they
    hold is written in batches of bounded size, so a lost executor costs some of a level. The
    names of one directory are one listing. Only the roots are looked at by the driver. A path that does not exist
    raises FileNotFoundError; roots that lie in each other list their files once a root. Names that begin with ``_`` or ``.``
    are left out, as Spark leaves them out, and so is what lies below them.
    """
    level, files = [], []
    for root in [path] if isinstance(path, str) else list(path):
        store, at = open_path(root)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        if info.is_file and fnmatch(info.base_name, pattern):
            files.append((_prefix(root) + info.path, info.size))
        elif not info.is_file:
            level.append((_prefix(root) + info.path, None))
    listed = spark.createDataFrame(files, LISTING)
    directories, n = spark.createDataFrame(level, LISTING), len(level)
    while n:
        dealt = directories.select("path").repartition(tasks_for(spark, n))
        found = stage(dealt.mapInArrow(_children(pattern), LISTING), "listed")
        listed = listed.unionByName(found.where(F.col("length").isNotNull()))
        directories = found.where(F.col("length").isNull())
        n = directories.count()
    return listed


def read_each(files: DataFrame, read, column: str, kind: str) -> DataFrame:
    """``files`` with ``column``: what ``read(stream)`` makes of each file, one file after another in a task."""
    names = [*files.columns, column]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at = batch.schema.get_field_index("path")
            for row in range(batch.num_rows):
                store, path = open_path(batch.column(at)[row].as_py())
                with store.open_input_stream(path, compression=None) as stream:
                    value = read(stream)
                arrays = [c.slice(row, 1) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([value])], names=names)

    fields = ", ".join(f"`{name}` {kind}" for name, kind in [*files.dtypes, (column, kind)])
    return deal_files(files).mapInArrow(run, fields)


def sha256_of(stream) -> str:
    import hashlib

    digest = hashlib.sha256()
    while data := stream.read(BLOCK):
        digest.update(data)
    return digest.hexdigest()


def head_of(stream) -> bytes:
    return stream.read(3)
