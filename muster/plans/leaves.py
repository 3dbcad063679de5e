"""Stored hash trees: what a snapshot holds, by leaf, and the digests above.

    <root>/leaves/commit_seq=<n>/part=<p>/  identifiers by leaf, sorted         (parquet)
    <root>/nodes/commit_seq=<n>/at=<level>/  one row per node, the root at 0    (parquet)

The index of a commit is written once, after it. A part is a directory of the leaves of
one shard, or of one stretch of hash prefixes of a long list, of about ``part_bytes``; a plan
that needs some leaves reads their parts only. The root of a list's tree is the
``ids_tree_sha256`` of its manifest, as long as leaves have the default size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.catalog import KEY
from muster.operators.lookup import spread_lookup
from muster.operators.tree import LEAF_BYTES, LEAF_ROWS, leaf_nodes, leaf_rows_of, upper_nodes
from muster.plans import store
from muster.shared import PACKED, in_scratch, read_or_empty, stage
from muster.sources.files import deal_files, list_files, open_path
from muster.sources.lines import opens

PART_BYTES = 64 << 20
LEAVES_SCHEMA = "dataset_id string, snapshot string, prefix string, id string, copies bigint, commit_seq bigint, part string"
NODES_SCHEMA = (
    "dataset_id string, snapshot string, depth int, prefix string, digest string, n_ids bigint, part string, commit_seq bigint, at int"
)
PLACE = ["commit_seq", "part"]


def leaves_path(root: str) -> str:
    return f"{root}/leaves"


def nodes_path(root: str) -> str:
    return f"{root}/nodes"


def leaves(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, leaves_path(root), LEAVES_SCHEMA)


def nodes(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, nodes_path(root), NODES_SCHEMA)


def list_key() -> Column:
    """One name for a dataset and a snapshot; a snapshot's name has no line end."""
    return F.concat_ws("\n", "dataset_id", "snapshot")


def keyed_sizes(keyed: DataFrame) -> DataFrame:
    """``(dataset_id, normalized_count, n_bytes)`` of ``keyed(dataset_id, id)``."""
    n_bytes = F.sum(F.octet_length("id").cast("bigint") + 1)
    return keyed.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("normalized_count"), n_bytes.alias("n_bytes"))


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Give rows keyed by ``list_key`` their dataset and snapshot again."""
    return spread_lookup(rows.withColumnRenamed("dataset_id", "_key"), names, ["_key"], ["prefix"])


BATCH_ROWS = 1 << 14
_LEAF_SCHEMA = "dataset_id string, depth int, prefix string, digest string, n_ids bigint, part string"


def _leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str, str, int]]:
    """Name, part, prefix, digest and length of the leaves in sorted files, a batch of rows in memory at a time."""
    import hashlib

    current, digest, n = None, None, 0
    for path, part in ((p, q) for b in batches for p, q in zip(b.column("path").to_pylist(), b.column("part").to_pylist(), strict=True)):
        store_of, at = open_path(path)
        with store_of.open_input_file(at) as opened:
            for rows in pq.ParquetFile(opened).iter_batches(BATCH_ROWS, columns=["dataset_id", "snapshot", "prefix", "id", "copies"]):
                for name, snapshot, prefix, one, copies in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    leaf = (f"{name}\n{snapshot}", part, prefix)
                    if leaf != current:
                        if current:
                            yield *current, digest.hexdigest(), n
                        current, digest, n = leaf, hashlib.sha256(), 0
                    digest.update(f"{chr(10) if n else ''}{copies} {one}".encode())
                    n += 1
        if current:  # a leaf is in one file
            yield *current, digest.hexdigest(), n
            current = None


def stored_leaf_nodes(spark: SparkSession, target: str) -> DataFrame:
    """``leaf_nodes`` of the leaves stored under ``target``, keyed by ``list_key``, from their files in file order.

    A leaf is written by one task, sorted, into the directory of one part; so it lies in one file and nothing is shuffled
    but the names of files.
    """
    if not opens([target]):  # a file system that only Spark knows
        written = spark.read.schema(LEAVES_SCHEMA.replace(", commit_seq bigint", "")).parquet(target)
        return leaf_nodes(written.select(list_key().alias("dataset_id"), "prefix", "id", "copies", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        schema = pa.schema([("dataset_id", pa.string()), ("depth", pa.int32()), ("prefix", pa.string()), ("digest", pa.string()),
                            ("n_ids", pa.int64()), ("part", pa.string())])
        for name, part, prefix, digest, n in _leaves_of(batches):
            held.append((name, len(prefix) // 2, prefix, digest, n, part))
            if len(held) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)

    folder = F.regexp_extract("path", r"/part=([^/]+)/[^/]+$", 1)  # percent-encoded, but for plus signs
    part = F.when(folder != "__HIVE_DEFAULT_PARTITION__", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))))
    files = list_files(spark, target, pattern="*.parquet").withColumn("part", part)
    return deal_files(files).select("path", "part").mapInArrow(run, _LEAF_SCHEMA)


@in_scratch
def index_commit(
    spark: SparkSession,
    root: str,
    commit_seq: int,
    *,
    leaf_rows: int = LEAF_ROWS,
    leaf_bytes: int = LEAF_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Write the trees of all snapshots of a commit and return their nodes.

    A commit that has an index keeps it. Leaves are written first and nodes last, and the index is
    there once its nodes are: what a job left behind that died in between is replaced.
    """
    place = f"commit_seq={commit_seq}"
    found = nodes(spark, root).where(F.col("commit_seq") == commit_seq)
    if not found.isEmpty():
        return found
    stored = read_or_empty(spark, store.ids_path(root), store.IDS_SCHEMA).where(F.col("commit_seq") == commit_seq)
    names = stage(
        store.opened(spark, root).where(F.col("commit_seq") == commit_seq).select(list_key().alias("_key"), *KEY, "shard"), "names"
    )
    ids = stored.select(list_key().alias("dataset_id"), "id")
    sizes = stage(keyed_sizes(ids), "sizes")
    # lists kept with repeats may hold one identifier any number of times: those are counted before they move
    told = store.manifests(spark, root).where((F.col("commit_seq") == commit_seq) & F.col("dedup")).select(*KEY)
    once = names.join(told, KEY, "left_anti").isEmpty()
    dealt = leaf_rows_of(ids, sizes, distinct=once, leaf_rows=leaf_rows, leaf_bytes=leaf_bytes)

    # so many hex characters of the prefix name a part that it holds about part_bytes
    wide = F.lit(0)
    for chars in (2, 4):
        wide = F.when(F.col("n_bytes") > part_bytes * 256 ** (chars // 2 - 1), chars).otherwise(wide)
    measured = stage(names.join(sizes.select(F.col("dataset_id").alias("_key"), "n_bytes"), "_key").withColumn("_wide", wide), "parts")
    part = F.concat_ws("-", "shard", F.substring("prefix", F.lit(1), F.col("_wide"))).alias("part")
    # a leaf is in one task, so one shuffle brings together what is counted, sorted and written
    leaf = ["part", *KEY, "prefix"]
    target = f"{leaves_path(root)}/{place}"
    (
        _named(dealt, measured)
        .select(*KEY, "prefix", "id", "copies", part)
        .repartitionByRange(*leaf)
        .groupBy(*leaf, "id")
        .agg(F.sum("copies").alias("copies"))
        .select(*KEY, "prefix", "id", "copies", "part")
        .sortWithinPartitions(*leaf, "id")
        .write.mode("overwrite")
        .option("compression", PACKED)
        .option("maxRecordsPerFile", 0)  # a leaf is in one file
        .partitionBy("part")
        .parquet(target)
    )
    every = upper_nodes(stage(stored_leaf_nodes(spark, target), "leaf-nodes"))
    rows = _named(every, names.select("_key", *KEY)).select(*KEY, "depth", "prefix", "digest", "n_ids", "part", "at")
    try:
        rows.repartitionByRange("at", "dataset_id", "snapshot", "prefix").write.mode("errorifexists").partitionBy("at").parquet(
            f"{nodes_path(root)}/{place}"
        )
    except AnalysisException as error:  # another job wrote the same
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    return nodes(spark, root).where(F.col("commit_seq") == commit_seq)
