"""An identity of a list that is computed in parallel, whatever its size.

The distinct identifiers of a dataset are dealt to leaves by a prefix of their
SHA-256. The prefix is as long as the list needs to keep leaves near
``leaf_rows`` and ``leaf_bytes``, at two hex characters per level. A leaf is the SHA-256 of its sorted
lines ``copies id``; a node above is the SHA-256 of its sorted ``prefix:digest``
lines, at most 256 of them. The order of the list plays no part, and neither does
partitioning. It is not comparable with the flat digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.lookup import spread_lookup
from muster.shared import stage

LEAF_ROWS = 4096
LEAF_BYTES = 64 << 20
LEVELS = 4
FANOUT = 256


def _depth(leaf_rows: int, leaf_bytes: int, levels: int = LEVELS) -> Column:
    """How many levels above its leaves a list of ``normalized_count`` and ``n_bytes`` has."""
    depth = F.raise_error(F.lit("list too long for the depth of the tree")).cast("int")
    for level in range(levels, -1, -1):
        fits = (F.col("normalized_count") <= leaf_rows * FANOUT**level) & (F.col("n_bytes") <= leaf_bytes * FANOUT**level)
        depth = F.when(fits, level).otherwise(depth)
    return depth


def _leaf_digest() -> Column:
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("id", "copies"))),
        lambda pair: F.concat_ws(" ", pair["copies"].cast("string"), pair["id"]),
    )
    return F.sha2(F.array_join(lines, "\n"), 256)


def _node_digest() -> Column:
    children = F.transform(
        F.array_sort(F.collect_list(F.struct("prefix", "digest"))),
        lambda child: F.concat_ws(":", child["prefix"], child["digest"]),
    )
    return F.sha2(F.array_join(children, "\n"), 256)


def leaf_rows_of(
    ids: DataFrame, sizes: DataFrame, *, distinct: bool, leaf_rows: int = LEAF_ROWS, leaf_bytes: int = LEAF_BYTES
) -> DataFrame:
    """``(dataset_id, prefix, id, copies)``: each distinct identifier with the prefix of its leaf."""
    if distinct:
        bag = ids.select("dataset_id", "id", F.lit(1).cast("bigint").alias("copies"))
    else:
        bag = ids.groupBy("dataset_id", "id").agg(F.count(F.lit(1)).alias("copies"))
    depths = sizes.where(F.col("normalized_count") > 0).select("dataset_id", _depth(leaf_rows, leaf_bytes).alias("depth"))
    placed = spread_lookup(bag, depths, ["dataset_id"], ["id"])
    prefix = F.substring(F.sha2("id", 256), F.lit(1), F.col("depth") * 2)
    return placed.select("dataset_id", prefix.alias("prefix"), "id", "copies")


def leaf_nodes(leaves: DataFrame) -> DataFrame:
    """``(dataset_id, depth, prefix, digest, n_ids, part)`` of ``leaves(dataset_id, prefix, id, copies, part)``."""
    made = leaves.groupBy("dataset_id", "prefix", "part").agg(_leaf_digest().alias("digest"), F.count(F.lit(1)).alias("n_ids"))
    depth = F.expr("length(prefix) div 2").cast("int").alias("depth")
    return made.select("dataset_id", depth, "prefix", "digest", "n_ids", "part")


def upper_nodes(leaves: DataFrame) -> DataFrame:
    """``leaf_nodes`` and all nodes above them, with ``at``: the level, 0 for a root; ``part`` is null above leaves.

    ``leaves`` is staged. A level is an aggregation of the one below, at most 256 rows a group.
    """
    tall = leaves.agg(F.max("depth")).first()[0] or 0
    found = below = leaves.withColumn("at", F.col("depth"))
    for level in range(tall, 0, -1):
        above = (
            below.where(F.col("at") == level)
            .groupBy("dataset_id", "depth", F.substring("prefix", 1, 2 * (level - 1)).alias("parent"))
            .agg(_node_digest().alias("digest"), F.sum("n_ids").alias("n_ids"))
            .select(
                "dataset_id", "depth", F.col("parent").alias("prefix"), "digest", "n_ids",
                F.lit(None).cast("string").alias("part"), F.lit(level - 1).alias("at"),
            )
        )
        above = stage(above, "upper-nodes")
        found = found.unionByName(above)
        below = leaves.withColumn("at", F.col("depth")).where(F.col("at") == level - 1).unionByName(above)
    return found


def tree_digest(
    ids: DataFrame, sizes: DataFrame, *, distinct: bool, leaf_rows: int = LEAF_ROWS, leaf_bytes: int = LEAF_BYTES, levels: int = LEVELS
) -> DataFrame:
    """``(dataset_id, ids_tree_sha256)`` of normalised lists.

    ``ids`` and ``sizes(dataset_id, normalized_count, n_bytes)`` are staged by the caller.
    ``distinct`` says that no identifier repeats, which saves a shuffle. A list of more than
    ``leaf_rows`` * 256**``levels`` identifiers, or as many bytes by ``leaf_bytes``, raises.
    """
    if distinct:
        bag = ids.select("dataset_id", "id", F.lit(1).cast("bigint").alias("copies"))
    else:
        bag = ids.groupBy("dataset_id", "id").agg(F.count(F.lit(1)).alias("copies"))
    depth = _depth(leaf_rows, leaf_bytes, levels)
    levels_of = sizes.where(F.col("normalized_count") > 0).select("dataset_id", depth.alias("level"))

    prefix = F.substring(F.sha2("id", 256), F.lit(1), F.col("level") * 2)
    nodes = (
        spread_lookup(bag, levels_of, ["dataset_id"], ["id"])
        .groupBy("dataset_id", "level", prefix.alias("prefix"))
        .agg(_leaf_digest().alias("digest"))
    )
    for level in range(levels, 0, -1):
        # Nodes of this level are gathered under their parent; the others wait.
        gathered = F.col("level") == level
        parent = F.when(gathered, F.substring("prefix", 1, 2 * (level - 1))).otherwise(F.col("prefix"))
        nodes = (
            nodes.groupBy("dataset_id", "level", parent.alias("parent"))
            .agg(_node_digest().alias("joined"), F.first("digest").alias("waiting"))
            .select(
                "dataset_id",
                F.when(gathered, level - 1).otherwise(F.col("level")).alias("level"),
                F.col("parent").alias("prefix"),
                F.when(gathered, F.col("joined")).otherwise(F.col("waiting")).alias("digest"),
            )
        )
    return nodes.select("dataset_id", F.col("digest").alias("ids_tree_sha256"))
