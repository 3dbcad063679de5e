"""Written tables in the folder every executor can reach.

A staged table cuts lineage, fixes non-deterministic columns, survives the loss
of executors, and has a known size, so Catalyst chooses the join from facts.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
PACKED = "zstd"  # how tables of texts are written: a third smaller than by default
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="muster-")
    return _local_dir


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet.

    Within ``scratch`` it lies in a folder that is removed at its end. All others of an
    application lie in one folder, to be removed when the application has ended.
    """
    return f"{_scratch[-1] if _scratch else _own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/muster/{spark.sparkContext.applicationId}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end or on failure, what was staged in between.

    For plans that end with a job: what they return must not read a staged table, unless it
    was staged with ``keep``.
    """
    folder = f"{_own_dir(spark)}/work-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.remove(folder)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Have the shuffle files of every job in between removed at its end.

    By default they stay until the driver happens to collect the plan as garbage.
    """
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def in_scratch(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run ``plan(spark, …)`` within ``scratch``."""

    @functools.wraps(plan)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        with scratch(spark):
            return plan(spark, *args, **kwargs)

    return run


def stage(df: DataFrame, label: str = "stage", *, partition_by: str | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table; with ``keep``, one that outlives ``scratch``."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}" if keep else fresh_path(spark, label)
    writer = df.write.option("compression", PACKED)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    """A path for Hadoop, and the file system it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it does not exist."""
    place, store = _place(spark, path)
    return sorted(found.getPath().getName() for found in store.listStatus(place)) if store.exists(place) else []


def replace_path(spark: SparkSession, new: str, path: str) -> None:
    """Move the folder ``new`` to ``path``; what was there goes only after that."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target, aside = (hadoop.Path(p) for p in (new, path, f"{path}.{uuid.uuid4().hex}"))
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had = store.exists(target)
    if had and not store.rename(target, aside):
        raise OSError(f"cannot move {path}")
    if not store.rename(source, target):
        if had:
            store.rename(aside, target)
        raise OSError(f"cannot move {new} to {path}")
    if had:
        store.delete(aside, True)


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read ``path`` under ``schema``; a path that does not exist reads as no rows."""
    try:
        return spark.read.schema(schema).format(fmt).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
