"""What changed between two snapshots, by descent through their hash trees.

Nodes of the two trees are compared level by level, from the roots, and only below those that
differ. Identifiers are read of the leaves that differ, and of no others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.lookup import spread_lookup
from muster.plans import leaves as L
from muster.plans import store
from muster.shared import stage

PAIR = ["dataset_id", "before", "after"]
ADDED, REMOVED, RECOUNTED = "added", "removed", "recounted"


def _sides(spark: SparkSession, root: str, pairs: DataFrame) -> DataFrame:
    """``(dataset_id, before, after, seq_before, seq_after)``; a snapshot that is not there raises, and one without an index."""
    pairs = stage(pairs.select(*PAIR).distinct(), "pairs")
    begun = store.opened(spark, root)
    for side in ("before", "after"):
        named = begun.select("dataset_id", F.col("snapshot").alias(side), F.col("commit_seq").alias(f"seq_{side}"))
        pairs = pairs.join(named, ["dataset_id", side], "left")
    pairs = stage(pairs.select(*PAIR, "seq_before", "seq_after"), "sides")
    if unknown := pairs.where("seq_before is null or seq_after is null").limit(5).collect():
        raise FileNotFoundError(f"no such snapshot: {[tuple(row)[:3] for row in unknown]}")
    numbers = pairs.select(F.explode(F.array("seq_before", "seq_after")).alias("commit_seq")).distinct()
    indexed = L.nodes(spark, root).select("commit_seq").distinct()
    counted = store.manifests(spark, root).where("normalized_count > 0").select("commit_seq").distinct()
    bare = numbers.join(counted, "commit_seq", "left_semi").join(indexed, "commit_seq", "left_anti")
    if bare := bare.limit(5).collect():
        raise FileNotFoundError(f"no index of commits {sorted(row.commit_seq for row in bare)}")
    return pairs


def _level(spark: SparkSession, root: str, front: DataFrame, at: int) -> DataFrame:
    """The nodes of level ``at`` below ``front(<pair>, seq_*, prefix)``, both sides of a pair in one row."""
    nodes = L.nodes(spark, root).where(F.col("at") == at)
    up = F.substring("prefix", 1, 2 * max(0, at - 1))
    found = []
    for side in ("before", "after"):
        own = nodes.select(
            "dataset_id", F.col("snapshot").alias(side), F.col("commit_seq").alias(f"seq_{side}"), up.alias("_up"), "prefix",
            F.struct("depth", "digest", "n_ids", "part").alias(f"node_{side}"),
        )
        above = front.withColumnRenamed("prefix", "_up")
        found.append(spread_lookup(own, above, ["dataset_id", side, f"seq_{side}", "_up"], ["prefix"]).drop("_up"))
    keys = [*PAIR, "seq_before", "seq_after", "prefix"]
    one, other = (rows.select(*keys, f"node_{side}") for rows, side in zip(found, ("before", "after"), strict=True))
    return one.join(other, keys, "full")


def _opened(rows: DataFrame, side: str) -> DataFrame:
    """The leaves of one side to be read."""
    node = F.col(f"node_{side}")
    return rows.where(node.isNotNull()).select(
        *PAIR, F.lit(side).alias("side"), F.col(f"seq_{side}").alias("commit_seq"), F.col(side).alias("snapshot"), "prefix",
        node["part"].alias("part"), node["n_ids"].alias("n_ids"),
    )


def differing_leaves(spark: SparkSession, root: str, pairs: DataFrame) -> DataFrame:
    """``(<pair>, side, commit_seq, snapshot, prefix, part, n_ids)``: leaves of either snapshot that differ.

    Trees of one depth are compared level by level. Where the depth differs, as when a list has outgrown its
    leaves, prefixes are of different length, and all leaves of both are returned.
    """
    front = _sides(spark, root, pairs).withColumn("prefix", F.lit(""))
    found, at = [], 0
    unlike = None
    while True:
        met = stage(_level(spark, root, front, at), "compared")
        if at == 0:
            even = F.col("node_before.depth").eqNullSafe(F.col("node_after.depth"))
            unlike = stage(met.where(~even).select(*front.columns), "other-depths")
            met = met.where(even)
        changed = met.where(~F.col("node_before.digest").eqNullSafe(F.col("node_after.digest")))
        depth = F.coalesce("node_before.depth", "node_after.depth")
        found += [_opened(changed.where(depth == at), side) for side in ("before", "after")]
        front = stage(changed.where(depth > at).select(*front.columns), "differing")
        if front.isEmpty():
            break
        at += 1
    if not unlike.isEmpty():
        for side in ("before", "after"):
            whole = L.nodes(spark, root).where("at = depth").withColumnsRenamed({"snapshot": side, "commit_seq": f"seq_{side}"})
            whole = whole.withColumn(f"node_{side}", F.struct("n_ids", "part")).drop("n_ids", "part")
            found.append(_opened(spread_lookup(whole, unlike.drop("prefix"), ["dataset_id", side, f"seq_{side}"], ["prefix"]), side))
    return reduce(DataFrame.unionByName, found)


def diff(spark: SparkSession, root: str, pairs: DataFrame) -> DataFrame:
    """``(dataset_id, before, after, id, copies_before, copies_after, change)`` of ``pairs(dataset_id, before, after)``.

    One row for each identifier that one of the two snapshots lacks, or holds another number of times (in lists
    kept with repeats). ``change`` is ``added``, ``removed`` or ``recounted``. A list without identifiers has no tree;
    all of the other one was added or removed. Pairs that are alike have no rows.
    """
    opened = stage(differing_leaves(spark, root, pairs), "leaves-to-open")
    places = stage(opened.select(*L.PLACE).distinct(), "places")
    # the places prune directories; the comparison tells Spark that they select some
    rows = spread_lookup(L.leaves(spark, root), places.where(F.col("commit_seq") > 0), L.PLACE, ["dataset_id", "prefix"])
    # few identifiers a leaf and as many leaves as differ: a hot list is many keys
    sides = rows.join(opened.drop("n_ids", "part"), ["commit_seq", "dataset_id", "snapshot", "prefix"])
    copies = {side: F.sum(F.when(F.col("side") == side, F.col("copies"))) for side in ("before", "after")}
    both = sides.groupBy(*PAIR, "id").agg(*(column.alias(f"copies_{side}") for side, column in copies.items()))
    change = F.when(F.col("copies_before").isNull(), ADDED).when(F.col("copies_after").isNull(), REMOVED).otherwise(RECOUNTED)
    return both.where(~F.col("copies_before").eqNullSafe(F.col("copies_after"))).withColumn("change", change)


def diff_counts(spark: SparkSession, root: str, pairs: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """``(dataset_id, before, after, added, removed, recounted, kept)``: distinct identifiers, one row for every pair.

    What is kept follows from the roots, so leaves that are alike are not read for it.
    """
    changes = diff(spark, root, pairs) if changes is None else changes
    kinds = [F.count(F.when(F.col("change") == kind, 1)).alias(kind) for kind in (ADDED, REMOVED, RECOUNTED)]
    counted = changes.groupBy(*PAIR).agg(*kinds)
    roots = L.nodes(spark, root).where("at = 0").select(
        "dataset_id", F.col("snapshot").alias("before"), F.col("commit_seq").alias("seq_before"), "n_ids"
    )
    sides = _sides(spark, root, pairs).join(roots, ["dataset_id", "before", "seq_before"], "left")
    none = F.lit(0).cast("bigint")
    joined = sides.join(counted, PAIR, "left")
    number = {kind: F.coalesce(kind, none) for kind in (ADDED, REMOVED, RECOUNTED)}
    kept = F.coalesce("n_ids", none) - number[REMOVED] - number[RECOUNTED]
    return joined.select(*PAIR, *(column.alias(kind) for kind, column in number.items()), kept.alias("kept"))
