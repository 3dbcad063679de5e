"""Whether what is stored is still what was frozen, for many snapshots in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.catalog import KEY
from muster.operators.digest import list_digest, with_empty_lists
from muster.operators.lookup import spread_lookup
from muster.operators.tree import leaf_nodes
from muster.plans import leaves as L
from muster.plans import store
from muster.shared import read_or_empty, stage

# What can be found of a snapshot.
OK = "ok"
LOST = "lost"  # nothing is stored of a list that has identifiers
FEWER = "fewer"  # identifiers are missing
MORE = "more"  # there are identifiers too many
ALTERED = "altered"  # as many as counted, but not the same, or in another order
MISCOUNTED = "miscounted"  # the identifiers are right and the count in the manifest is not


def _read(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """``(dataset_id, ord, id)`` with ``dataset_id`` naming list and snapshot; files that cannot be read count as lost."""
    stored = read_or_empty(
        spark, store.ids_path(root), store.IDS_SCHEMA, ignoreCorruptFiles="true", ignoreMissingFiles="true"
    )
    held = stored.select(L.list_key().alias("dataset_id"), "ord", "id", "commit_seq")
    # the number of the commit prunes directories
    keys = wanted.select("dataset_id", "commit_seq").where(F.col("commit_seq") > 0)
    return spread_lookup(held, keys, ["dataset_id", "commit_seq"], ["id", "ord"]).drop("commit_seq")


def verify_snapshots(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(dataset_id, snapshot, verdict, counted, found, damaged_leaves, first_damaged_leaf)`` of every manifest.

    Each list is counted and digested again under the policy of its own manifest: by canonical or by list order. A list
    whose digest differs is cut into leaves again and held against the stored index of its commit, if
    there is one: ``damaged_leaves`` of them depart, the first by prefix at ``first_damaged_leaf`` (empty for a list
    of one leaf). Without damage or index both are null. ``wanted(dataset_id, snapshot)`` picks snapshots; names without a manifest are
    no snapshots and have no row.
    """
    manifests = store.manifests(spark, root)
    if wanted is not None:
        manifests = manifests.join(wanted.select(*KEY).distinct(), KEY, "left_semi")
    known = stage(
        manifests.select(
            L.list_key().alias("dataset_id"), F.col("dataset_id").alias("name"), "snapshot", "commit_seq", "canonical_sort",
            F.col("normalized_count").alias("counted"), "ids_sha256",
        ),
        "manifests",
    )
    ids = stage(_read(spark, root, known), "identifiers")
    sizes = stage(L.keyed_sizes(ids), "sizes")
    parts = []
    for canonical_sort in (True, False):
        under = stage(known.where(F.col("canonical_sort") == canonical_sort).select("dataset_id"), "under")
        held = spread_lookup(ids, under, ["dataset_id"], ["id", "ord"])
        measured = stage(sizes.join(under, "dataset_id", "left_semi"), "measured")
        parts.append(with_empty_lists(under, list_digest(held, measured, canonical_sort=canonical_sort), "ids_sha256"))
    digests = parts[0].unionByName(parts[1]).withColumnRenamed("ids_sha256", "digest")
    joined = known.join(digests, "dataset_id").join(sizes, "dataset_id", "left")
    found = F.coalesce("normalized_count", F.lit(0)).cast("bigint")
    same = F.col("digest") == F.col("ids_sha256")
    verdict = (
        F.when(same & (found == F.col("counted")), OK)
        .when(same, MISCOUNTED)
        .when(found == 0, LOST)
        .when(found < F.col("counted"), FEWER)
        .when(found > F.col("counted"), MORE)
        .otherwise(ALTERED)
    )
    judged = stage(joined.select(*known.columns, "n_bytes", found.alias("found"), verdict.alias("verdict")), "judged")
    suspects = stage(judged.where(~F.col("verdict").isin(OK, MISCOUNTED)).select("dataset_id", "name", "snapshot", "commit_seq"), "suspects")
    if suspects.isEmpty():
        damage = judged.limit(0).select("dataset_id", F.lit(0).cast("bigint").alias("damaged_leaves"), F.lit("").alias("first_damaged_leaf"))
    else:
        damage = _damage(spark, root, suspects, ids)
    return judged.join(damage, "dataset_id", "left").select(
        F.col("name").alias("dataset_id"), "snapshot", "verdict", "counted", "found", "damaged_leaves", "first_damaged_leaf"
    )


def _damage(spark: SparkSession, root: str, suspects: DataFrame, ids: DataFrame) -> DataFrame:
    """``(dataset_id, damaged_leaves, first_damaged_leaf)`` of lists that have an index.

    Leaves are cut at the depth of the stored tree, whatever is left of the list.
    """
    nodes = L.nodes(spark, root).where("at = depth").select(L.list_key().alias("dataset_id"), "commit_seq", "depth", "prefix", "digest")
    stored = stage(spread_lookup(nodes, suspects.select("dataset_id", "commit_seq"), ["dataset_id", "commit_seq"], ["prefix"]), "stored")
    depths = stage(stored.groupBy("dataset_id").agg(F.max("depth").alias("_depth")), "depths")
    held = spread_lookup(ids, depths, ["dataset_id"], ["id", "ord"])
    bag = held.groupBy("dataset_id", "_depth", "id").agg(F.count(F.lit(1)).alias("copies"))
    prefix = F.substring(F.sha2("id", 256), F.lit(1), F.col("_depth") * 2)
    cut = bag.select("dataset_id", prefix.alias("prefix"), "id", "copies", F.lit("").alias("part"))
    again = leaf_nodes(cut).select("dataset_id", "prefix", F.col("digest").alias("again"))
    met = stored.select("dataset_id", "prefix", "digest").join(again, ["dataset_id", "prefix"], "full")
    departed = met.where(~F.col("digest").eqNullSafe(F.col("again")))
    return departed.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("damaged_leaves"), F.min("prefix").alias("first_damaged_leaf")
    )
