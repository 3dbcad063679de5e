"""The catalog by increments against the whole store, and what it opens."""

from __future__ import annotations

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from muster.operators import catalog as C
from muster.plans import store, summary
from muster.plans.commit import commit_snapshots
from muster.plans.resolve import activate

COLUMNS = ["dataset_id", "snapshot", "has_latest", "has_manifest", "has_ids", "available"]


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def _write(spark, root, numbers, datasets, dead=()):
    """Commits by hand: in commit n every dataset with a number that n divides, a file a commit and table."""
    n, k = F.col("commit_seq"), F.col("k")
    both = spark.createDataFrame([(x,) for x in numbers], "commit_seq bigint").crossJoin(spark.range(datasets).toDF("k"))
    rows = both.where((k + n) % 50 == 0).select(
        F.concat(F.lit("d"), k).alias("dataset_id"), F.concat(F.lit("s"), n).alias("snapshot"), F.lit("mixed-0").alias("shard"), n
    )
    rows = rows.repartition("commit_seq")
    rows.write.mode("append").partitionBy("commit_seq").parquet(store.opened_path(root))
    ids = rows.where(n % 7 != 0).select(*C.KEY, F.lit(1).cast("bigint").alias("ord"), F.lit("x").alias("id"), "commit_seq", "shard")
    ids.write.mode("append").partitionBy("commit_seq", "shard").parquet(store.ids_path(root))
    made = rows.where(~n.isin(*dead)) if dead else rows
    made.select(*C.KEY, F.lit(1).alias("normalized_count"), (n % 3 != 0).alias("update_latest"), "commit_seq").write.mode(
        "append"
    ).partitionBy("commit_seq").json(store.manifests_path(root))


def _asked(spark, names):
    return spark.createDataFrame([(name,) for name in names], "dataset_id string")


def _states(rows):
    return sorted(tuple(row) for row in rows.select(*COLUMNS).collect())


def test_ten_requests_in_a_thousand_commits_open_few_files(spark, root):
    _write(spark, root, range(1, 1001), 200)
    summary.summarize(spark, root, slice_rows=100)
    _write(spark, root, range(1001, 1004), 200)
    asked = _asked(spark, [f"d{k}" for k in random.Random(1).sample(range(200), 9)] + ["nobody"])
    known = summary.newest(spark, root)
    assert (known.upto, known.pending, known.slices) == (1000, [], 40)
    opened = summary.snapshots(spark, root, asked).inputFiles()
    assert 0 < len(opened) <= 10 * 2 + 3 * 2  # slices, which may be cut once, and two tables of three commits
    assert _states(summary.latest_state(spark, root, asked)) == _states(store.latest_state(spark, root, asked))
    every = _asked(spark, [f"d{k}" for k in range(200)])
    assert _states(summary.latest_state(spark, root, every)) == _states(store.latest_state(spark, root, every))


def test_each_summary_is_made_of_the_one_before(spark, root):
    _write(spark, root, range(1, 60), 100, dead=(3, 50))
    assert summary.newest(spark, root) == (0, 0, "", [])
    summary.summarize(spark, root)
    assert summary.newest(spark, root).pending == [3, 50]
    shutil.rmtree(f"{store.opened_path(root)}/commit_seq=7")  # settled, so never read again
    before = {tuple(r) for r in summary.snapshots(spark, root).select(*C.KEY, "commit_seq", "has_manifest").collect()}
    assert {n for _, _, n, _ in before} == set(range(1, 60))
    assert {n for _, _, n, there in before if not there} == {3, 50}
    # without a new commit nothing is written
    assert summary.summarize(spark, root).count() == sum(n not in (3, 50) for _, _, n, _ in before)
    assert [p.name for p in Path(summary.catalog_path(root)).iterdir()] == ["upto=59"]
    # a commit that was slow and not dead is found without a new summary, and settles in the next
    late = store.opened(spark, root).where("commit_seq = 3").select(*C.KEY, F.lit(1).alias("normalized_count"), F.lit(True).alias("update_latest"))
    late.write.json(f"{store.manifests_path(root)}/commit_seq=3")
    assert summary.snapshots(spark, root).where("NOT has_manifest").select("commit_seq").distinct().collect() == [(50,)]
    _write(spark, root, [60], 100)
    summary.summarize(spark, root, slice_rows=10)
    known = summary.newest(spark, root)
    assert (known.upto, known.pending) == (60, [50]) and known.slices > 1
    assert summary.snapshots(spark, root).count() == len(before) + 2


def test_a_commit_that_is_being_written_is_pending(spark, root):
    _write(spark, root, [1, 2], 100)
    (Path(store.opened_path(root)) / "commit_seq=3").mkdir()  # begun, and not a name in it yet
    summary.summarize(spark, root)
    assert summary.newest(spark, root)[0::3] == (3, [3])
    _write(spark, root, [3], 100)
    assert {r.commit_seq for r in summary.snapshots(spark, root).collect()} == {1, 2, 3}


def test_nothing_and_nobody(spark, root):
    nobody = _asked(spark, ["x"])
    assert summary.summarize(spark, root).count() == summary.snapshots(spark, root).count() == summary.last_commit(spark, root) == 0
    assert _states(summary.latest_state(spark, root, nobody)) == [("x", None, False, False, False, False)]
    assert summary.latest_state(spark, root, nobody.where("false")).count() == 0
    with pytest.raises(FileNotFoundError):
        summary.load_snapshots(spark, root, spark.createDataFrame([("x", "s")], "dataset_id string, snapshot string"))
    assert not Path(root).exists()


def test_many_slices_are_read_by_a_filter(spark, root, monkeypatch):
    _write(spark, root, range(1, 51), 100)
    summary.summarize(spark, root, slice_rows=2)
    asked = _asked(spark, [f"d{k}" for k in range(5)])
    by_path = summary.snapshots(spark, root, asked)
    monkeypatch.setattr(summary, "NAMED_SLICES", 1)
    by_filter = summary.snapshots(spark, root, asked)
    (scan,) = [line for line in by_filter._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters: [slice" in line]
    assert "slice=" not in scan.split("PartitionFilters")[0]  # the folder, and the filter prunes it
    assert sorted(by_filter.select(*C.KEY).collect()) == sorted(by_path.select(*C.KEY).collect())


def test_commit_and_reuse_over_a_summary(spark, root):
    """Commits, collisions and reuse are the same before and after summaries; other commits' folders are not needed."""

    def commit(stamp, lists):
        searches = [(name, "q", len(items), stamp, "w", "1") for name, items in lists.items()]
        schema = "dataset_id string, search_query string, reported_count bigint, retrieved_at_utc string, history_web_env string, history_query_key string"
        rows = [(name, place, item) for name, items in lists.items() for place, item in enumerate(items)]
        frame = spark.createDataFrame(rows, "dataset_id string, ord bigint, id string")
        return commit_snapshots(spark, root, spark.createDataFrame(searches, schema), frame)

    assert {r.commit_seq for r in commit("2024-01-01T00:00:00Z", {"a": ["1"], "odd/na:me=[é] %": ["2"]}).collect()} == {1}
    summary.summarize(spark, root)
    commit("2024-01-02T00:00:00Z", {"b": ["3", "4"], "none": ()})
    with pytest.raises(FileExistsError):
        commit("2024-01-01T00:00:00Z", {"a": ["9"]})
    summary.summarize(spark, root)
    assert commit("2024-01-03T00:00:00Z", {"a": ["5"]}).first().commit_seq == 3
    asked = spark.createDataFrame([(n, "reuse_latest", None) for n in ("a", "odd/na:me=[é] %", "b", "none")], "dataset_id string, mode string, email string")
    found, ids = activate(spark, root, asked)
    assert sorted((r.dataset_id, r.id) for r in ids.collect()) == [("a", "5"), ("b", "3"), ("b", "4"), ("odd/na:me=[é] %", "2")]
    assert {r.dataset_id: r.normalized_count for r in found.collect()} == {"a": 1, "b": 2, "none": 0, "odd/na:me=[é] %": 1}
    for row in found.where("normalized_count > 0").collect():
        assert list(Path(row.ids_path).glob("part-*.parquet")), row
    one = activate(spark, root, asked.where("dataset_id = 'b'"))[1]
    stored = [name for name in one.inputFiles() if f"{root}/" in name]
    assert stored and all("/commit_seq=2/" in name for name in stored)
    shutil.rmtree(f"{store.ids_path(root)}/commit_seq=2/shard=mixed-0")
    with pytest.raises(FileNotFoundError, match="no_ids"):
        activate(spark, root, asked.where("dataset_id = 'b'"))
