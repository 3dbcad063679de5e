"""Trees of snapshots: what changed between two, and whether they are still what was frozen."""

from __future__ import annotations

import glob
import hashlib
import os
import shutil

import pytest

from muster.plans import leaves, store
from muster.plans.commit import commit_snapshots
from muster.plans.diff import diff, diff_counts, differing_leaves
from muster.plans.verify import verify_snapshots
from muster.shared import fresh_path

LISTS = "dataset_id string, ord bigint, id string"


def commit(spark, root, stamp, lists, **options):
    rows = [(name, n, value) for name, values in lists.items() for n, value in enumerate(values)]
    searches = spark.createDataFrame(
        [(name, name, len(values), stamp, "w", "1") for name, values in lists.items()],
        "dataset_id string, search_query string, reported_count bigint, retrieved_at_utc string, history_web_env string, history_query_key string",
    )
    return commit_snapshots(spark, root, searches, spark.createDataFrame(rows, LISTS), **options)


def pairs_of(spark, root):
    begun = store.opened(spark, root)
    one, two = (begun.where(f"commit_seq = {n}").selectExpr("dataset_id", f"snapshot AS {side}") for n, side in ((1, "before"), (2, "after")))
    return one.join(two, "dataset_id")


@pytest.fixture(scope="module")
def versions(spark):
    """Lists that stay, change by one, grow beyond their leaves, begin, end, and repeat."""
    numbers = [f"id{i}" for i in range(3000)]
    first = {"same": numbers, "one": numbers, "grown": numbers[:20], "begun": [], "ended": numbers[:40], "none": [], "é\nlist": ["a", "b"]}
    second = first | {
        "one": ["new" if v == "id77" else v for v in numbers], "grown": numbers[:900], "begun": numbers[:30], "ended": [], "é\nlist": ["b", "c"],
    }
    root = fresh_path(spark, "versions")
    commit(spark, root, "2024-01-01T00:00:00Z", first)
    commit(spark, root, "2024-01-02T00:00:00Z", second)
    for number in (1, 2):
        leaves.index_commit(spark, root, number, leaf_rows=16, part_bytes=4000)
    return root, first, second


def test_diff_equals_sets(spark, versions):
    root, first, second = versions
    pairs = pairs_of(spark, root)
    found = {(r.dataset_id, r.id, r.change) for r in diff(spark, root, pairs).collect()}
    want = {(n, v, "removed") for n in first for v in set(first[n]) - set(second[n])}
    want |= {(n, v, "added") for n in first for v in set(second[n]) - set(first[n])}
    assert found == want
    counts = {r.dataset_id: (r.added, r.removed, r.recounted, r.kept) for r in diff_counts(spark, root, pairs).collect()}
    assert counts == {
        n: (len(set(second[n]) - set(first[n])), len(set(first[n]) - set(second[n])), 0, len(set(first[n]) & set(second[n]))) for n in first
    }
    assert diff(spark, root, pairs.limit(0)).count() == 0


def test_leaves_that_are_alike_are_not_read(spark, versions, tmp_path):
    """All parts but those of the leaves that differ are taken away, and the result is the same."""
    root, first, second = versions
    copy = str(tmp_path / "store")
    shutil.copytree(root, copy)
    pairs = pairs_of(spark, copy).where("dataset_id = 'one'")
    opened = differing_leaves(spark, copy, pairs).collect()
    wanted = {hashlib.sha256(v.encode()).hexdigest()[:2] for v in ("id77", "new")}
    assert {r.prefix for r in opened} == wanted and len(opened) <= 4
    places = {f"commit_seq={r.commit_seq}/part={r.part}" for r in opened}
    there = {"/".join(p.split("/")[-2:]): p for p in glob.glob(f"{copy}/leaves/commit_seq=*/part=*")}
    assert places < set(there) and len(there) > 10 * len(places)
    aside = tmp_path / "aside"
    for number, (place, path) in enumerate(there.items()):
        if place not in places:
            os.makedirs(aside, exist_ok=True)
            os.rename(path, aside / str(number))
    assert {(r.id, r.change) for r in diff(spark, copy, pairs).collect()} == {("id77", "removed"), ("new", "added")}


def test_index_is_the_tree_of_the_manifest_and_is_made_once(spark):
    root = fresh_path(spark, "store")
    commit(spark, root, "2024-01-01T00:00:00Z", {"a": [f"x{i}" for i in range(9000)], "b": ["y"], "c": []})
    made = leaves.index_commit(spark, root, 1)
    roots = {r.dataset_id: r.digest for r in made.where("at = 0").collect()}
    known = {r.dataset_id: r.ids_tree_sha256 for r in store.manifests(spark, root).collect()}
    assert roots == {n: d for n, d in known.items() if n != "c"}
    files = sorted(glob.glob(f"{root}/nodes/**/*", recursive=True) + glob.glob(f"{root}/leaves/**/*", recursive=True))
    again = leaves.index_commit(spark, root, 1)
    assert again.count() == made.count()
    assert files == sorted(glob.glob(f"{root}/nodes/**/*", recursive=True) + glob.glob(f"{root}/leaves/**/*", recursive=True))


def test_repeats_are_counted(spark):
    root = fresh_path(spark, "store")
    commit(spark, root, "2024-01-01T00:00:00Z", {"a": ["x", "y", "x"]}, dedup=False, canonical_sort=False)
    commit(spark, root, "2024-01-02T00:00:00Z", {"a": ["x", "y", "y", "z"]}, dedup=False, canonical_sort=False)
    for number in (1, 2):
        leaves.index_commit(spark, root, number)
    found = {(r.id, r.copies_before, r.copies_after, r.change) for r in diff(spark, root, pairs_of(spark, root)).collect()}
    assert found == {("x", 2, 1, "recounted"), ("y", 1, 2, "recounted"), ("z", None, 1, "added")}
    assert {r.verdict for r in verify_snapshots(spark, root).collect()} == {"ok"}


def test_unknown_and_bare_snapshots_raise(spark):
    root = fresh_path(spark, "store")
    commit(spark, root, "2024-01-01T00:00:00Z", {"a": ["x"]})
    commit(spark, root, "2024-01-02T00:00:00Z", {"a": ["y"]})
    with pytest.raises(FileNotFoundError, match="no index of commits"):
        diff(spark, root, pairs_of(spark, root))
    nowhere = spark.createDataFrame([("a", "x", "y")], "dataset_id string, before string, after string")
    with pytest.raises(FileNotFoundError, match="no such snapshot"):
        diff(spark, root, nowhere)


def test_each_damage_is_named(spark, tmp_path):
    """One flipped identifier, one lost file, one wrong count, one list too long, and an order that is not the list's."""
    root = str(tmp_path / "store")
    sizes = {"flip": 400, "lost": 400, "count": 5, "more": 40, "sound": 40, "empty": 0}
    lists = {n: [f"{n}{i}" for i in range(k)] for n, k in sizes.items()}
    for number, (name, values) in enumerate(lists.items()):
        commit(spark, root, f"2024-01-0{number + 1}T00:00:00Z", {name: values})
        leaves.index_commit(spark, root, number + 1, leaf_rows=16)
    commit(spark, root, "2024-02-01T00:00:00Z", {"order": ["b", "a", "c"]}, canonical_sort=False)
    assert {r.verdict for r in verify_snapshots(spark, root).collect()} == {"ok"}

    def rewrite(number, change):
        for path in glob.glob(f"{root}/ids/commit_seq={number}/shard=*"):
            changed = change(spark.read.parquet(path)).collect()
            schema = "dataset_id string, snapshot string, ord bigint, id string"
            spark.createDataFrame(changed, schema).coalesce(1).write.mode("overwrite").parquet(path)

    rewrite(1, lambda df: df.selectExpr("dataset_id", "snapshot", "ord", "CASE WHEN id = 'flip7' THEN 'flop7' ELSE id END AS id"))
    for path in glob.glob(f"{root}/ids/commit_seq=2/shard=*/*.parquet"):
        open(path, "wb").close()  # a file that cannot be read
    manifest = glob.glob(f"{root}/manifests/commit_seq=3/*.json")[0]
    text = open(manifest).read()
    for other in glob.glob(f"{root}/manifests/commit_seq=3/.*.crc"):
        os.unlink(other)
    with open(manifest, "w") as out:
        out.write(text.replace('"normalized_count":5', '"normalized_count":6'))
    rewrite(4, lambda df: df.union(df.selectExpr("dataset_id", "snapshot", "ord + 100", "concat(id, 'x')").limit(1)))
    rewrite(7, lambda df: df.selectExpr("dataset_id", "snapshot", "-ord", "id"))

    found = {r.dataset_id: r for r in verify_snapshots(spark, root).collect()}
    assert {n: r.verdict for n, r in found.items()} == {
        "flip": "altered", "lost": "lost", "count": "miscounted", "more": "more", "sound": "ok", "empty": "ok", "order": "altered",
    }
    hashes = sorted({hashlib.sha256(v.encode()).hexdigest()[:2] for v in ("flip7", "flop7")})
    assert (found["flip"].damaged_leaves, found["flip"].first_damaged_leaf) == (len(hashes), hashes[0])
    assert found["more"].damaged_leaves == 1 and found["count"].damaged_leaves is None and found["order"].damaged_leaves is None
    assert found["lost"].damaged_leaves == len({hashlib.sha256(v.encode()).hexdigest()[:2] for v in lists["lost"]})
    some = spark.createDataFrame([(r.dataset_id, r.snapshot) for r in found.values() if r.dataset_id in ("flip", "sound")], "dataset_id string, snapshot string")
    assert {r.dataset_id for r in verify_snapshots(spark, root, some).collect()} == {"flip", "sound"}
