"""Normalising, order and identity against plain Python on small lists."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from muster.functions.text import WHITESPACE
from muster.operators.digest import digest_of_lines, list_digest
from muster.operators.lookup import spread_lookup
from muster.operators.normalize import counts_by_dataset, measure, normalize, normalize_counted, sort_list
from muster.operators.order import dense_position, previous_in_order
from muster.operators.tree import tree_digest
from muster.shared import stage
from muster.sources.landed import text_lines

POLICIES = [(dedup, sort) for dedup in (True, False) for sort in (True, False)]


def expected_list(items, dedup, canonical_sort):
    kept = [str(item).strip() for item in items if item is not None and str(item).strip()]
    if dedup:
        kept = list(dict.fromkeys(kept))
    return sorted(kept) if canonical_sort else kept


def expected_digest(items, dedup, canonical_sort, separator="\n", encoding="utf-8"):
    return hashlib.sha256(separator.join(expected_list(items, dedup, canonical_sort)).encode(encoding)).hexdigest()


def frame(spark, lists, parts=5):
    rows = [(name, place, value) for name, items in lists.items() for place, value in enumerate(items)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "dataset_id string, ord bigint, value string").repartition(parts)


def random_lists():
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "z", "￿", "😀", "Z", "10", "9", "a\nb", ""]
    lists = {
        "hot": [rng.choice(alphabet) + str(rng.randrange(400)) for _ in range(4000)] + ["same"] * 3000,
        "order": ["10", "9", "a", "B", "é", "z", "￿", "😀", "Z"],
        "blank": ["", " ", WHITESPACE],
        "null": [None, "x", None],
        "one": ["a"],
        "two": ["b", "a"],
        "007": [" 7", "7 ", "7", "07"],
    }
    return {
        name: [v if v is None else rng.choice(["", " ", " ", "\t"]) + v + rng.choice(["", "　", "\u0085"]) for v in items]
        for name, items in lists.items()
    }


LISTS = random_lists()


@pytest.mark.parametrize("dedup,canonical_sort", POLICIES)
def test_normalize(spark, dedup, canonical_sort):
    ids = normalize(frame(spark, LISTS), dedup=dedup)
    placed = dense_position(ids, ["dataset_id"], ["id", "ord"] if canonical_sort else ["ord"])
    found = {}
    for row in placed.orderBy("dataset_id", "position").collect():
        found.setdefault(row.dataset_id, []).append((row.position, row.id))
    for name, items in LISTS.items():
        expected = expected_list(items, dedup, canonical_sort)
        assert found.get(name, []) == list(enumerate(expected, 1))


def test_first_occurrence_is_kept(spark):
    ids = {row.id: row.ord for row in normalize(frame(spark, {"d": [" b", "a", "b", "A", "a "]})).collect()}
    assert ids == {"b": 0, "a": 1, "A": 3}


def test_normalizing_twice_changes_nothing(spark):
    once = normalize(frame(spark, LISTS))
    assert normalize(once, "id").exceptAll(once).isEmpty() and once.exceptAll(normalize(once, "id")).isEmpty()


@pytest.mark.parametrize("dedup", [True, False])
def test_counts(spark, dedup):
    counts = counts_by_dataset(frame(spark, LISTS), dedup=dedup)
    found = {row.dataset_id: (row.raw_count, row.normalized_count) for row in counts.collect()}
    assert found == {name: (len(items), len(expected_list(items, dedup, False))) for name, items in LISTS.items()}


def test_integers_are_identifiers(spark):
    df = spark.createDataFrame([("d", 0, 10), ("d", 1, 9), ("d", 2, 10)], "dataset_id string, ord bigint, value bigint")
    assert sorted(row.id for row in normalize(df).collect()) == ["10", "9"]


def test_sort_list_orders_across_partitions(spark):
    ids = sort_list(normalize(frame(spark, LISTS), dedup=False), canonical_sort=True)
    keys = [(row.dataset_id, row.id, row.ord) for row in ids.collect()]
    assert keys == sorted(keys)


WAYS = [(1 << 20, 1 << 30), (100, 1 << 30), (100, 2000), (0, 2000)]


@pytest.mark.parametrize(
    "dedup,canonical_sort,flat_bytes,run_bytes",
    [(*policy, *WAYS[0]) for policy in POLICIES] + [(*policy, *way) for policy, way in zip(POLICIES, WAYS[1:] + WAYS[2:])],
)
def test_digest(spark, dedup, canonical_sort, flat_bytes, run_bytes):
    digests = digest_of_lines(
        frame(spark, LISTS), dedup=dedup, canonical_sort=canonical_sort, flat_bytes=flat_bytes, run_bytes=run_bytes
    )
    found = {row.dataset_id: row.ids_sha256 for row in digests.collect()}
    assert found == {name: expected_digest(items, dedup, canonical_sort) for name, items in LISTS.items()}


def test_digest_of_other_separators_and_encodings(spark):
    lists = {"d": ["é", "b"]}
    for flat_bytes in (1 << 20, 0):
        for separator, name, codec in (("\r\n", "utf-8", "utf-8"), ("", "latin-1", "latin-1"), ("\n", "utf-16le", "utf-16-le")):
            row = digest_of_lines(frame(spark, lists), separator=separator, encoding=name, flat_bytes=flat_bytes).first()
            assert row.ids_sha256 == expected_digest(lists["d"], True, False, separator, codec)
    with pytest.raises(ValueError):
        digest_of_lines(frame(spark, lists), encoding="utf-16")


def test_known_digests(spark):
    lists = {"none": [""], "a": ["a"], "ab": ["a", "b"], "ba": ["b", "a"], "joined": ["a\nb"]}
    found = {row.dataset_id: row.ids_sha256 for row in digest_of_lines(frame(spark, lists)).collect()}
    assert found["none"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert found["a"] == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    assert found["ab"] != found["ba"] and found["ab"] == found["joined"]
    # The digest of a list is not that of the file it is written to, which ends in a newline.
    assert found["ab"] != hashlib.sha256(b"a\nb\n").hexdigest()


def test_digests_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for parts in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            counted = stage(normalize_counted(frame(spark, LISTS, parts)))
            sizes = stage(measure(counted))
            ids = counted.where("id <> ''")
            flat = list_digest(ids, sizes, canonical_sort=True, flat_bytes=1000, run_bytes=3000)
            tree = tree_digest(ids, sizes, distinct=True, leaf_rows=10)
            seen.add(tuple(sorted(tuple(row) for row in flat.join(tree, "dataset_id").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def expected_tree(items, leaf_rows):
    bag = Counter(items)
    depth = 0
    while len(items) > leaf_rows * 256**depth:
        depth += 1
    leaves = {}
    for item, copies in bag.items():
        leaves.setdefault(hashlib.sha256(item.encode()).hexdigest()[: 2 * depth], []).append((item, copies))
    nodes = {
        prefix: hashlib.sha256("\n".join(f"{n} {item}" for item, n in sorted(pairs)).encode()).hexdigest()
        for prefix, pairs in leaves.items()
    }
    for level in range(depth, 0, -1):
        parents = {}
        for prefix, digest in sorted(nodes.items()):
            parents.setdefault(prefix[: 2 * level - 2], []).append(f"{prefix}:{digest}")
        nodes = {prefix: hashlib.sha256("\n".join(lines).encode()).hexdigest() for prefix, lines in parents.items()}
    return nodes[""]


@pytest.mark.parametrize("dedup", [True, False])
@pytest.mark.parametrize("leaf_rows", [1, 3, 5000])
def test_tree_digest(spark, dedup, leaf_rows):
    counted = stage(normalize_counted(frame(spark, LISTS), dedup=dedup))
    sizes = stage(measure(counted))
    digests = tree_digest(counted.where("id <> ''"), sizes, distinct=dedup, leaf_rows=leaf_rows)
    found = {row.dataset_id: row.ids_tree_sha256 for row in digests.collect()}
    lists = {name: expected_list(items, dedup, False) for name, items in LISTS.items()}
    assert found == {name: expected_tree(items, leaf_rows) for name, items in lists.items() if items}


def test_leaves_are_bounded_by_bytes(spark):
    items = [f"{i}" * 500 for i in range(40)]
    counted = stage(normalize_counted(frame(spark, {"d": items})))
    sizes = stage(measure(counted))
    (found,) = tree_digest(counted, sizes, distinct=True, leaf_rows=1000, leaf_bytes=2000).collect()
    assert found.ids_tree_sha256 == expected_tree(items, 1)
    with pytest.raises(Exception, match="too long"):
        tree_digest(counted, sizes, distinct=True, leaf_rows=1000, leaf_bytes=100, levels=0).collect()


def test_text_numbers_without_a_place_raise(spark):
    texts = spark.createDataFrame([("d", (1 << 39) - 1, "a\nb"), ("d", -(1 << 39), "c")], "k string, n bigint, t string")
    assert text_lines(texts, "k", "n", "t").select("ord").distinct().count() == 3
    beyond = spark.createDataFrame([("d", 1 << 40, "a")], "k string, n bigint, t string")
    with pytest.raises(Exception, match="no place"):
        text_lines(beyond, "k", "n", "t").collect()


@pytest.mark.parametrize("widths", [(), (7,), (7, 70), (1, 1000)])
def test_previous_in_order(spark, widths):
    rng = random.Random(5)
    sizes = {"a": 300, "b": 20, "c": 1}
    rows = [(key, place, rng.randrange(1000)) for key, n in sizes.items() for place in rng.sample(range(500), n)]
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint").repartition(4)
    found = {(r.k, r.p): r.before for r in previous_in_order(df, ["k"], "p", "v", "before", widths).collect()}
    expected = {}
    for key in "abc":
        last = None
        for _, place, value in sorted(row for row in rows if row[0] == key):
            expected[(key, place)] = last
            last = value
    assert found == expected


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast_rows,heavy_rows", [(10, 1), (2, 50), (2, 10_000)])
def test_spread_lookup(spark, how, broadcast_rows, heavy_rows):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 7 as string)) AS k", "id")
    table = stage(spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3)], "k string, v int"))
    found = spread_lookup(rows, table, ["k"], ["id"], how=how, broadcast_rows=broadcast_rows, heavy_rows=heavy_rows)
    expected = rows.join(table, "k", how)
    assert found.columns == ["k", "id", "v"]
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_a_heavy_key_is_split(spark):
    """A third of all rows under one key must not meet in one task."""
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) AS k", "id")
    table = stage(rows.groupBy("k").agg(F.count(F.lit(1)).alias("v")))
    before = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for key, value in zip(before, ("false", "-1")):
        spark.conf.set(key, value)
    try:
        found = spread_lookup(rows, table, ["k"], ["id"], broadcast_rows=100, heavy_rows=10)
        loads = found.where("k = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(r["count"] for r in loads) == 10_000
    assert len(loads) == 8 and max(r["count"] for r in loads) < 2500
