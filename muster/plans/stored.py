"""Digests of stored lists, fed from their files in file order.

A commit writes its identifiers sorted by list over range partitions, so the files of a shard, by the number in their
names, are its lists one after another. Hashing them needs neither a shuffle nor a sort: a task gets the names of the files of
one shard and streams them. What moves is a row a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.operators.chain import RUN_BYTES, _feeder
from muster.operators.normalize import list_order
from muster.shared import fresh_path, stage
from muster.sources.files import list_files, open_path
from muster.sources.lines import part_number

BATCH_ROWS = 1 << 12
TASKS = 10_000  # at most so many tasks a round
_FED = "shard string, dataset_id string, state binary, sha256 string"


def _ascends(names: pa.Array, keys: pa.Array) -> bool:
    """Whether the rows go up by name and, within a name, by key."""
    before, after = slice(None, len(names) - 1), slice(1, None)
    if pc.any(pc.less(names[after], names[before])).as_py():
        return False
    same = pc.equal(names[after], names[before])
    return not pc.any(pc.and_(same, pc.less(keys[after], keys[before]))).as_py()


def _rows_of(paths: list[str], order: str, separator: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of files, one file after another, as the feeder takes them; rows out of order raise."""
    last = None
    for path in paths:
        store, at = open_path(path)
        with store.open_input_file(at) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(BATCH_ROWS, columns=["dataset_id", order, "id"]):
                if not batch.num_rows:
                    continue
                names, keys = batch.column("dataset_id"), batch.column(order)
                first = (names[0].as_py().encode(), keys[0].as_py().encode() if order == "id" else keys[0].as_py())
                if (last is not None and first < last) or not _ascends(names, keys):
                    raise RuntimeError(f"identifiers are not stored in order: {path}")
                last = (names[-1].as_py().encode(), keys[-1].as_py().encode() if order == "id" else keys[-1].as_py())
                values = pc.binary_join_element_wise(b"", batch.column("id").cast(pa.binary()), separator)
                yield pa.RecordBatch.from_arrays([names, values, pa.nulls(len(names), pa.binary())], names=["n", "v", "s"])


def _fed(runs: DataFrame, order: str, separator: bytes, *, resumable: bool) -> DataFrame:
    """Feed ``runs(shard, paths, dataset_id, state)``: the lists that end or pause in each run, with their states."""
    feed = _feeder(separator, resumable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, paths, name, state in zip(*(column.to_pylist() for column in batch.columns), strict=True):

                def rows(paths=paths, name=name, state=state) -> Iterator[pa.RecordBatch]:
                    if state is not None:
                        saved = [pa.array([name], pa.string()), pa.array([None], pa.binary()), pa.array([state], pa.binary())]
                        yield pa.RecordBatch.from_arrays(saved, names=["n", "v", "s"])
                    yield from _rows_of(paths, order, separator)

                for found in feed(rows()):
                    place = pa.array([shard] * found.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([place, *found.columns], names=["shard", *found.schema.names])

    return runs.select("shard", "paths", "dataset_id", "state").mapInArrow(run, _FED)


def file_runs(files: DataFrame, run_bytes: int) -> DataFrame:
    """``(shard, turn, paths, last)`` of ``files(shard, path, length)``: a shard's files in order, in runs of about ``run_bytes``.

    A file is not cut, so a run may be longer by one file. Windows are over the names of the files of one shard.
    """
    order = [part_number("path"), F.col("path")]
    in_order = Window.partitionBy("shard").orderBy(*order)
    before = F.coalesce(F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("_run", F.floor(before / run_bytes)).withColumn("_place", F.row_number().over(in_order))
    turned = placed.withColumn("turn", F.dense_rank().over(Window.partitionBy("shard").orderBy("_run")) - 1)
    runs = turned.groupBy("shard", "turn").agg(F.array_sort(F.collect_list(F.struct("_place", "path"))).alias("_files"))
    last = F.max("turn").over(Window.partitionBy("shard"))
    return runs.select("shard", "turn", F.col("_files.path").alias("paths"), last.alias("last"))


def stored_digests(
    spark: SparkSession, target: str, *, canonical_sort: bool, separator: str = "\n", run_bytes: int = RUN_BYTES
) -> DataFrame:
    """``(dataset_id, ids_sha256)`` of the lists stored under ``target``, a commit's folder of identifiers.

    Equal to ``list_digest`` of the same rows. A shard whose files weigh up to ``run_bytes`` is one run and one task, in which
    the lists it holds are hashed as they come. A longer one, which is one long list, goes in rounds: round k feeds the k-th
    run of every such shard from the state that the round before saved for the list the run begins in. Files that are
    not in list order raise. A lost executor costs the runs it was at. No rows come of a folder without files.
    """
    order = list_order(canonical_sort)[0]
    gap = separator.encode()
    shard = F.regexp_extract("path", r"/shard=([^/]+)/[^/]+$", 1)
    files = list_files(spark, target, pattern="*.parquet").withColumn("shard", shard)
    runs = stage(file_runs(files, run_bytes), "file-runs")
    rounds = dict(runs.where("last > 0").groupBy("turn").count().collect())  # a row a round
    nothing = [F.lit(None).cast("string").alias("dataset_id"), F.lit(None).cast("binary").alias("state")]
    short = runs.where("last = 0").select("shard", "paths", *nothing)
    n_short = max(1, min(TASKS, short.count()))
    whole = _fed(short.repartition(n_short), order, gap, resumable=False)
    if not rounds:
        return whole.select("dataset_id", F.col("sha256").alias("ids_sha256"))
    folder = fresh_path(spark, "states")
    for turn in range(len(rounds)):
        fed = runs.where((F.col("last") > 0) & (F.col("turn") == turn)).select("shard", "paths")
        if turn:
            before = spark.read.schema(_FED).parquet(f"{folder}/turn={turn - 1}")
            # the list that the run before ended in: names ascend within a shard
            open_lists = before.groupBy("shard").agg(F.max_by(F.struct("dataset_id", "state"), "dataset_id").alias("_open"))
            fed = fed.join(open_lists, "shard", "left").select("shard", "paths", "_open.dataset_id", "_open.state")
        else:
            fed = fed.select("shard", "paths", *nothing)
        _fed(fed.repartition(min(TASKS, rounds[turn])), order, gap, resumable=True).write.parquet(f"{folder}/turn={turn}")
    told = spark.read.schema(f"{_FED}, turn int").parquet(folder)
    long = told.groupBy("dataset_id").agg(F.max_by("sha256", "turn").alias("sha256"))
    return whole.select("dataset_id", "sha256").unionByName(long).withColumnRenamed("sha256", "ids_sha256")
