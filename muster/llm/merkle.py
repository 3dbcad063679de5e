"""A Merkle tree over table rows, built by joining siblings level by level.

Rows are leaves, numbered in order within their group. At every level a node computes the
index of its slot-zero sibling (its own index less its slot in a run of ``FANOUT``), the
slot-zero rows are equijoined with the rows of each further slot on that index, and each
slot-zero row emits the parent of its run. The subroots of the groups are the leaves of one
more such tree. All state is DataFrames: a level is a written table an eighth of the one
below, a group of any size is spread by its indices, and one digest reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import stage
from muster.operators.lookup import spread_lookup
from muster.operators.order import dense_position

FANOUT = 8
NO_PATH = "array<struct<before:string,after:string>>"


def row_digest(*values: Column) -> Column:
    """SHA-256 of the values: ``-`` for a null, else the number of bytes, a colon and the value."""
    texts = [value.cast("string") for value in values]
    size = [F.octet_length(text).cast("string") for text in texts]
    parts = [F.coalesce(F.concat(n, F.lit(":"), text), F.lit("-")) for n, text in zip(size, texts, strict=True)]
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Tree:
    """``families[l]``: ``(tree, zero, kids)``, the runs of level l; ``roots``: ``(tree, root)``."""

    roots: DataFrame
    families: list[DataFrame] = field(default_factory=list)


def _slot(idx: Column, fanout: int) -> Column:
    return F.pmod(idx, F.lit(fanout)).cast("int").alias("slot")


def stage_leaves(leaves: DataFrame, label: str, *, fanout: int = FANOUT) -> DataFrame:
    """Write ``leaves(tree, idx, n, digest, …)`` for ``build``."""
    return stage(leaves.select("*", _slot(F.col("idx"), fanout)), label, partition_by="slot")


def _families(nodes: DataFrame, fanout: int) -> DataFrame:
    """Slot-zero rows of ``nodes(tree, slot, zero, n, digest)``, joined with each further slot."""
    joined = nodes.where(F.col("slot") == 0).select("tree", "zero", "n", F.col("digest").alias("_0"))
    for slot in range(1, fanout):
        siblings = nodes.where(F.col("slot") == slot).select("tree", "zero", F.col("digest").alias(f"_{slot}"))
        joined = joined.join(siblings, ["tree", "zero"], "left")
    kids = F.array_compact(F.array(*(f"_{slot}" for slot in range(fanout))))
    return joined.select("tree", "zero", "n", kids.alias("kids"))


def build(leaves: DataFrame, *, fanout: int = FANOUT) -> Tree:
    """The trees of ``leaves(tree, idx, n, digest)``, with ``idx`` from 0 to ``n`` - 1 in each.

    ``leaves`` come from ``stage_leaves``, which keeps each slot in a directory of its own, so that
    each of the joins reads its rows only. While a tree has several nodes, every ``fanout`` consecutive ones (fewer in the last run)
    become the SHA-256 of their joined digests. A lone leaf is its own root.
    """
    tall = leaves.agg(F.max("n")).first()[0] or 0
    nodes, roots, families = leaves.select("tree", "idx", "slot", "n", "digest"), leaves.where("n = 1").select("tree", F.col("digest").alias("root")), []
    while tall > 1:
        placed = nodes.where("n > 1").select("tree", (F.col("idx") - F.col("slot")).alias("zero"), "n", "digest", "slot")
        runs = stage(_families(placed, fanout), "tree-level")
        families.append(runs.select("tree", "zero", "kids"))
        idx = F.expr(f"zero div {fanout}")
        nodes = runs.select(
            "tree", idx.alias("idx"), _slot(idx, fanout), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
            F.sha2(F.array_join("kids", ""), 256).alias("digest"),
        )
        roots = roots.unionByName(nodes.where("n = 1").select("tree", F.col("digest").alias("root")))
        tall = -(-tall // fanout)
    return Tree(stage(roots, "tree-roots"), families)


def _siblings(slot: Column, fanout: int) -> Column:
    """What stands before and after a slot of ``kids``, as the one entry of a path."""
    before = F.array_join(F.slice("kids", F.lit(1), slot), "")
    after = F.array_join(F.slice("kids", slot + 2, F.lit(fanout)), "")
    return F.array(F.struct(before.alias("before"), after.alias("after")))


def attach_paths(leaves: DataFrame, tree: Tree, *, fanout: int = FANOUT) -> DataFrame:
    """``leaves(tree, idx, …)`` with ``path``: the siblings before and after, from the leaf up.

    From the top down each run takes the path of its own node, one row a run, and hands it to
    its members. Leaves join with runs, an eighth of their number, on the computed index.
    """
    no_path = F.array().cast(NO_PATH)
    above = tree.roots.select("tree", F.lit(0).cast("bigint").alias("idx"), no_path.alias("path"))
    runs = None
    for level in range(len(tree.families) - 1, -1, -1):
        below = tree.families[level].withColumn("idx", F.expr(f"zero div {fanout}"))
        # a run without a path of its own is the whole of its tree
        runs = below.join(above, ["tree", "idx"], "left").withColumn("path", F.coalesce("path", no_path)).drop("idx")
        if level:
            members = runs.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)))
            above = members.select(
                "tree", (F.col("zero") + F.col("_slot")).alias("idx"), F.concat(_siblings(F.col("_slot"), fanout), "path").alias("path")
            )
    if runs is None:
        return leaves.withColumn("path", no_path)
    path = F.when(F.col("kids").isNull(), no_path).otherwise(F.concat(_siblings(F.col("slot"), fanout), "path"))
    placed = leaves.withColumn("zero", F.col("idx") - F.col("slot")).join(runs, ["tree", "zero"], "left")
    return placed.select(*leaves.columns, path.alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to with the siblings in ``path``."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings in ``path``, from the leaf up; of nothing, that of the empty text."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def manifest(rows: DataFrame, group: str, order: str, leaf: str, keep: Sequence[str] = (), *, fanout: int = FANOUT) -> DataFrame:
    """``(order, leaf, <keep>, subroot, root, path)`` for each row of ``rows``.

    ``leaf`` holds the row's digest. Within a ``group`` (null is one) leaves ascend by
    ``order``, null first, then by digest and by ``keep``, so equal rows are leaves of their own
    whose order does not matter. Subroots are ordered by group, null first, in UTF-8 byte order.
    The path leads from the leaf through its subroot to the root. Other columns play no part, whatever their names; an empty
    table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    kept = [F.col(name).alias(f"_k{i}") for i, name in enumerate(keep)]
    named = [f"_k{i}" for i in range(len(keep))]
    hashed = stage(rows.select(tree.alias("tree"), F.col(order).alias("_order"), F.col(leaf).alias("digest"), *kept), "leaves")
    placed = dense_position(hashed, ["tree"], ["_order", "digest", *named]).withColumn("idx", F.col("position") - 1)
    counts = stage(hashed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree-sizes")
    sized = spread_lookup(placed, counts, ["tree"], ["idx"]).select("tree", "idx", "n", "digest", "_order", *named)
    leaves = stage_leaves(sized, "placed-leaves", fanout=fanout)
    below = build(leaves, fanout=fanout)

    n_groups = counts.count()
    tops = dense_position(below.roots.withColumn("_all", F.lit("")), ["_all"], ["tree"])
    tops = stage_leaves(
        tops.select(
            F.col("_all").alias("tree"), (F.col("position") - 1).alias("idx"), F.lit(n_groups).cast("bigint").alias("n"),
            F.col("root").alias("digest"), F.col("tree").alias("_group"),
        ),
        "subroots",
        fanout=fanout,
    )
    above = build(tops, fanout=fanout)
    top = above.roots.first()
    root = F.lit(top.root if top else None).cast("string")
    groups = attach_paths(tops, above, fanout=fanout).select(
        F.col("_group").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("_up")
    )
    found = spread_lookup(attach_paths(leaves, below, fanout=fanout), stage(groups, "group-paths"), ["tree"], ["idx"])
    return found.select(
        F.col("_order").alias(order), F.col("digest").alias(leaf), *[F.col(a).alias(b) for a, b in zip(named, keep, strict=True)],
        "subroot", root.alias("root"), F.concat("path", "_up").alias("path"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def verify_tampered(documents: DataFrame) -> DataFrame:
    """The tree of ``documents`` by lang, and which rows still lead to its root after tampering.

    Rows whose ``doc_id`` has a crc32 divisible by 3 are tampered with: A-Z of the text become
    lower case. A row whose text has none of them, or is null, is as it was and verifies. A null ``doc_id`` has
    no crc32 and stays.
    """
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    other = row_digest(*fields[:-1], F.translate("text", UPPER, LOWER))
    hashed = documents.select(
        "doc_id", "lang", row_digest(*fields).alias("leaf"), F.when(tampered, other).alias("changed")
    )
    found = manifest(hashed, "lang", "doc_id", "leaf", ["changed"])
    folded = found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
