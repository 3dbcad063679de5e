"""Digests fed from stored files against hashlib, and against the digest of shuffled rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from muster.operators.normalize import list_order
from muster.plans import commit, store
from muster.plans.commit import commit_snapshots
from muster.plans.stored import file_runs, stored_digests
from muster.shared import fresh_path, stage

STAMP = "2024-01-01T00:00:00Z"


def _lists():
    rng = random.Random(3)
    lists = {f"list {n:02d}": [f"{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 50, 400]))] for n in range(30)}
    lists["é/long"] = [f"{rng.randrange(10**9)}\nß" for _ in range(20_000)]
    lists["zz"] = ["x" * 300_000, "y"]
    return lists


def _stored(spark, lists, by, files):
    """Range-sorted over ``files`` partitions, as a commit writes them: one shard, but for the long list."""
    rows = [(name, place, value) for name, values in lists.items() for place, value in enumerate(values)]
    frame = spark.createDataFrame(rows, "dataset_id string, ord bigint, id string")
    shard = F.when(F.col("dataset_id") == "é/long", "own").otherwise(F.lit("mixed-0"))
    keys = ["shard", "dataset_id", *by]
    path = fresh_path(spark, "stored")
    spread = frame.withColumn("shard", shard).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    spread.write.partitionBy("shard").parquet(path)
    return path


def _expected(lists, canonical_sort):
    ordered = {name: sorted(v, key=str.encode) if canonical_sort else v for name, v in lists.items()}
    return {name: hashlib.sha256("\n".join(v).encode()).hexdigest() for name, v in ordered.items()}


@pytest.mark.parametrize("canonical_sort", [True, False])
@pytest.mark.parametrize("run_bytes", [1, 20_000, 1 << 30])
def test_equal_to_hashlib(spark, canonical_sort, run_bytes):
    """A run a file, some files a run, and one run; lists end and go on across the borders of runs."""
    lists = _lists()
    path = _stored(spark, lists, list_order(canonical_sort), 16)
    found = {r.dataset_id: r.ids_sha256 for r in stored_digests(spark, path, canonical_sort=canonical_sort, run_bytes=run_bytes).collect()}
    assert found == _expected(lists, canonical_sort)


def test_files_out_of_order_raise(spark):
    path = fresh_path(spark, "stored")
    rows = spark.createDataFrame([("a", 0, "b", "s"), ("a", 1, "a", "s")], "dataset_id string, ord bigint, id string, shard string")
    rows.coalesce(1).write.partitionBy("shard").parquet(path)
    with pytest.raises(Exception, match="not stored in order"):
        stored_digests(spark, path, canonical_sort=True).collect()
    assert stored_digests(spark, path, canonical_sort=False).count() == 1


def test_files_without_rows_and_folders_without_files(spark):
    path = fresh_path(spark, "stored")
    rows = spark.createDataFrame([("a", 0, "b", "s")], "dataset_id string, ord bigint, id string, shard string")
    rows.where("false").write.parquet(f"{path}/shard=s")
    assert stored_digests(spark, path, canonical_sort=True).count() == 0


def test_runs_follow_the_numbers_of_files(spark):
    files = [("s", f"file:/x/shard=s/part-{n:05d}-u.c000.parquet", 10) for n in (100_000, 99_999, 3)] + [("t", "part-00000-u.parquet", 0)]
    runs = file_runs(spark.createDataFrame(files, "shard string, path string, length bigint"), 20).collect()
    found = {(r.shard, r.turn): ([p.split("part-")[1].split("-")[0] for p in r.paths], r.last) for r in runs}
    assert found == {("s", 0): (["00003", "99999"], 1), ("s", 1): (["100000"], 1), ("t", 0): (["00000"], 0)}


def test_no_identifier_is_shuffled(spark):
    """Only names of files go into the plan: no scan of identifiers, no exchange or sort by list."""
    path = _stored(spark, _lists(), ["id", "ord"], 4)
    plan = stored_digests(spark, path, canonical_sort=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "ord" not in plan and "hashpartitioning(dataset_id" not in plan and "Sort [" not in plan


def test_a_commit_hashes_what_it_stored(spark, tmp_path, monkeypatch):
    """The same manifests as by shuffled rows, and the shuffled digest is not called."""
    lists = _lists()
    rows = [(name, place, value) for name, values in lists.items() for place, value in enumerate(values)]
    frame = stage(spark.createDataFrame(rows, "dataset_id string, ord bigint, id string"), "lists")
    names = [(name, "q", 1, STAMP, "w", "1") for name in [*lists, "none"]]
    searches = spark.createDataFrame(
        names,
        "dataset_id string, search_query string, reported_count bigint, retrieved_at_utc string, history_web_env string, history_query_key string",
    )
    told = {}
    for way in ("stored", "shuffled"):
        with monkeypatch.context() as patch:
            patch.setattr(commit, "list_digest" if way == "stored" else "stored_digests", None)
            if way == "shuffled":
                patch.setattr(commit, "opens", lambda paths: False)
            commit_snapshots(spark, str(tmp_path / way), searches, frame)
        told[way] = {tuple(r) for r in store.manifests(spark, str(tmp_path / way)).select("dataset_id", "ids_sha256", "ids_tree_sha256").collect()}
    assert told["stored"] == told["shuffled"] and len(told["stored"]) == len(lists) + 1
