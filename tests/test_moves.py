"""What is moved, remembered and dealt: each identifier as few times as can be, with the same results."""

import glob
import io
from contextlib import redirect_stdout
from datetime import datetime

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from muster.operators.normalize import measure, measure_distinct, normalize_counted, sorted_once, stripped
from muster.operators.tree import leaf_nodes
from muster.plans import leaves, store, verify
from muster.plans.commit import commit_snapshots
from muster.shared import fresh_path, stage
from muster.sources.files import deal_files, tasks_for
from muster.suite import inputs, queries


def exchanges(df) -> int:
    """Shuffles of a plan; broadcasts are none."""
    with redirect_stdout(io.StringIO()) as told:
        df.select("*").explain()  # a plan that was run is told twice
    return sum("Exchange " in line and "BroadcastExchange" not in line for line in told.getvalue().splitlines())


def lists(spark):
    rows = [("a", i, v) for i, v in enumerate(["b", " b", "", "é", "a", "b", "  "] * 3)]
    rows += [("b+c %", i, f"id{i % 900:04d}") for i in range(2000)] + [("blank", 1, " "), ("blank", 2, None)]
    return spark.createDataFrame(rows, "dataset_id string, ord bigint, value string")


def test_sizes_by_hash_are_sizes(spark):  # F2, F3
    found = {tuple(r) for r in measure_distinct(stripped(lists(spark))).collect()}
    assert found == {tuple(r) for r in measure(normalize_counted(lists(spark))).collect()}
    assert ("blank", 2, 0, 0) in found


def test_repeats_and_order_by_one_shuffle(spark):  # F2, F3
    ids = stripped(lists(spark)).where("id <> ''")
    found = sorted_once(ids, ["dataset_id", "id"])
    least = ids.groupBy("dataset_id", "id").agg(F.min("ord").alias("ord")).collect()
    assert [tuple(r) for r in found.collect()] == sorted((r.dataset_id, r.id, r.ord) for r in least)
    assert exchanges(found) == 1


def test_leaves_of_files_are_leaves(spark):  # F1, F6
    root = fresh_path(spark, "store")
    searches = lists(spark).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("reported_count")).select(
        "dataset_id", F.col("dataset_id").alias("search_query"), "reported_count", F.lit("2024-01-01T00:00:00Z").alias("retrieved_at_utc"),
        F.lit(None).cast("string").alias("translated_query"), F.lit("w").alias("history_web_env"), F.lit("1").alias("history_query_key"),
    )
    commit_snapshots(spark, root, searches, lists(spark), "value")
    leaves.index_commit(spark, root, 1, leaf_rows=16, part_bytes=2000)
    target = f"{leaves.leaves_path(root)}/commit_seq=1"
    held = spark.read.schema(leaves.LEAVES_SCHEMA.replace(", commit_seq bigint", "")).parquet(target)
    plain = leaf_nodes(held.select(leaves.list_key().alias("dataset_id"), "prefix", "id", "copies", "part"))
    found = leaves.stored_leaf_nodes(spark, target)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() > 100
    assert {r.verdict for r in verify.verify_snapshots(spark, root).collect()} == {"ok"}
    assert store.identifiers(spark, root, "a").count() == 3


def test_every_query_makes_its_store(spark, monkeypatch):  # F1, F2, F3, F7
    """Nothing is remembered in a session, so that a query costs the same whichever came before."""
    monkeypatch.setattr(queries, "commit_snapshots", lambda *a, **kw: None)
    monkeypatch.setattr(queries, "index_commit", lambda *a, **kw: None)
    for make in (queries.make_store, queries.make_versions):
        monkeypatch.setattr(queries, "I", type("Inputs", (), {"__getattr__": lambda self, name: lambda *a: None})())
        assert make(spark, "nowhere") != make(spark, "nowhere")


def test_directories_and_files_share_tasks(spark):  # F4, F9
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 3) == 3
    assert tasks_for(spark, 64_000) == 1000 > 2 * cores
    assert tasks_for(spark, 513) < 100
    assert tasks_for(spark, 100, 100 << 30) == 100
    files = spark.createDataFrame([(f"f{i}", 10) for i in range(600)], "path string, length bigint")
    assert deal_files(files).rdd.getNumPartitions() < 100


def test_staged_tables_are_packed(spark):  # F8
    held = stage(spark.range(100).selectExpr("cast(id as string) as id"), "packed")
    name = glob.glob(f"{held.inputFiles()[0].replace('file://', '')}")[0]
    assert pq.ParquetFile(name).metadata.row_group(0).column(0).compression == "ZSTD"


def test_history_by_one_shuffle(spark, tmp_path):  # F7, F9
    rows = [(k, k % 7, datetime(2024, 1, 1 + k % 5), "1-URGENT") for k in range(50)]
    orders = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, orders).write.parquet(str(tmp_path / "orders.parquet"))
    history = inputs.history(spark, str(tmp_path))
    found = {(r.dataset_id, r.snapshot): r.commit_seq for r in history.collect()}
    assert set(found) == {(r.dataset_id, r.snapshot) for r in inputs.snapshots(spark, str(tmp_path)).collect()}
    assert sorted(n for (name, _), n in found.items() if name == "3") == list(range(1, 6))
    assert exchanges(history) == 1
