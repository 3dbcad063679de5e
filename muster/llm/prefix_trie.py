"""A trie of conversation prefixes by ROLLUP over columns that hold a block's turns.

A conversation is cut into blocks of ``WIDTH`` turns, and the ids of a block's turns stand in
as many columns. ``GROUP BY block, node, ROLLUP(k1, …)`` aggregates all prefixes that end in a
block together, and ``grouping_id()`` tells how long each is. ``node`` names the prefix that
ends with the block before, by the smallest conversation that has it. To find it, one round
a block groups the conversations that fill the block and go on; one that goes on alone needs no further
rounds, as it is the smallest of all its later prefixes. So rounds follow the longest
prefix that conversations share, and not the longest conversation.

Sums over subtrees come from a second ROLLUP of values per conversation: for each, the words of
the turns where a smaller conversation has the same prefix (they are the ones saved), and
whether it is the smallest at an end without children.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import stage
from muster.llm.mixing import word_count
from muster.operators.digest import list_digest
from muster.operators.lookup import spread_lookup
from muster.operators.order import dense_position

WIDTH = 8
CELLS = (1 << 12, 1 << 24)  # widths of the cells of a running total, as in operators.order
BASE, LENT = 20, 4

_KEYS = [f"k{i}" for i in range(1, WIDTH + 1)]


def _short(text: Column) -> Column:
    """The first 128 bits of a SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def turn_id(role: Column, text: Column) -> Column:
    return _short(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)))


def placed_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, tid, words)``: the turns of each conversation numbered from 1.

    Order is by ``turn``, null first; equal ones by their ids. Null role or text is empty.
    Rows without a ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("_turn"), turn_id(role, text).alias("tid"),
        word_count(text).alias("words"),
    )
    placed = dense_position(stage(turns, "turns"), ["conv_id"], ["_turn", "tid"], out="pos")
    return stage(placed.select("conv_id", "pos", "tid", "words"), "placed-turns")


def with_lent_heads(placed: DataFrame, *, base: int = BASE, lent: int = LENT) -> tuple[DataFrame, DataFrame]:
    """``(turns, members)`` of conversations that begin with turns of another one.

    Conversation c begins with the first h turns of c - c % ``base``, h = crc32(c) % ``lent`` (all if
    fewer, none if that one is not there), and goes on with its own turns after the first h.
    ``turns(conv_id, depth, tid, words)`` counts from 1, ``members(conv_id, n_turns)`` holds
    every conversation, those that have no turns left as well.
    """
    heads = placed.where((F.col("pos") < lent) & (F.col("conv_id") % base == 0)).groupBy(F.col("conv_id").alias("_base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "tid", "words"))).alias("_head")
    )
    n_lent = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(lent)).cast("int")
    own = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own")).withColumn("_h", n_lent)
    joined = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % base).join(heads, "_base", "left")
    given = F.slice("_head", F.lit(1), F.col("_h"))
    convs = joined.select("conv_id", "_h", "_own", given.alias("_given"), F.coalesce(F.size(given), F.lit(0)).alias("_n"))
    convs = stage(convs.withColumn("_n", F.greatest("_n", F.lit(0))), "conversations")
    rest = spread_lookup(placed, convs.select("conv_id", "_h", "_n"), ["conv_id"], ["pos"]).where("pos > _h")
    turns = rest.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_n")).alias("depth"), "tid", "words").unionByName(
        convs.select("conv_id", F.posexplode("_given").alias("_i", "_t")).select(
            "conv_id", (F.col("_i") + 1).cast("bigint").alias("depth"), "_t.tid", "_t.words"
        )
    )
    n_turns = F.col("_n") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))
    return turns, convs.select("conv_id", n_turns.cast("bigint").alias("n_turns"))


def running_before(rows: DataFrame, key: str, position: str, value: str, out: str, widths: tuple[int, ...] = CELLS) -> DataFrame:
    """The sum of ``value`` over the rows of a key before this one, without a key in one window.

    ``position`` is unique within a key. A window runs inside a cell of positions; what stands before
    a cell comes from the same step over cells.
    """
    if not widths:
        earlier = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    width, *wider = widths
    cell, total, before, inside = (f"_{name}{len(widths)}" for name in ("cell", "total", "before", "inside"))
    celled = rows.withColumn(cell, F.col(position) - F.pmod(F.col(position), F.lit(width)))
    totals = celled.groupBy(key, cell).agg(F.sum(value).alias(total))
    totals = running_before(totals, key, cell, total, before, tuple(wider)).drop(total)
    within = Window.partitionBy(key, cell).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        celled.withColumn(inside, F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(totals, [key, cell])
        .withColumn(out, F.col(before) + F.col(inside))
        .drop(cell, before, inside)
    )


def _blocks(turns: DataFrame, members: DataFrame) -> DataFrame:
    """``(conv_id, block, n_turns, ks, ws, before)``; one without turns has an empty block 0.

    ``ks`` and ``ws`` are the ids and words of a block's turns, ``before`` the words before it.
    """
    held = turns.withColumn("block", F.expr(f"(depth - 1) div {WIDTH}")).groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("depth", "tid", "words"))).alias("_t")
    )
    cut = held.select("conv_id", "block", F.col("_t.tid").alias("ks"), F.col("_t.words").alias("ws"))
    summed = cut.withColumn("_sum", F.aggregate("ws", F.lit(0).cast("bigint"), lambda a, b: a + b))
    cumulated = running_before(stage(summed, "turn-blocks"), "conv_id", "block", "_sum", "before").drop("_sum")
    none = members.where("n_turns = 0").select(
        "conv_id", F.lit(0).cast("bigint").alias("block"), F.array().cast("array<binary>").alias("ks"),
        F.array().cast("array<bigint>").alias("ws"), F.lit(0).cast("bigint").alias("before"),
    )
    rows = cumulated.unionByName(none)
    return stage(spread_lookup(rows, members, ["conv_id"], ["block"]).select("conv_id", "block", "n_turns", "ks", "ws", "before"), "blocks")


def _joined(keys: Column) -> Column:
    return F.array_join(F.transform(keys, F.hex), "")


def _with_nodes(blocks: DataFrame) -> DataFrame:
    """Add ``node``: the smallest conversation with the same turns before the block; 0 in block 0."""
    shared, alone = [], []
    nothing = F.lit(0).cast("bigint")
    front = blocks.where("block = 0").withColumn("node", nothing)
    number = 0
    while True:
        # those that end with the block count for the minimum
        full = front.where(F.size("ks") == WIDTH).select("conv_id", "node", "n_turns", _short(_joined(F.col("ks"))).alias("_code"))
        on = F.col("n_turns") > (number + 1) * WIDTH
        groups = full.groupBy("node", "_code").agg(
            F.min("conv_id").alias("_least"), F.count(F.when(on, 1)).alias("_on")
        )
        met = spread_lookup(full.where(on), stage(groups.where("_on > 0"), "block-ends"), ["node", "_code"], ["conv_id"])
        number += 1
        met = stage(met.select("conv_id", F.lit(number).cast("bigint").alias("block"), F.col("_least").alias("node"), "_on"), "next-nodes")
        alone.append(met.where("_on = 1").select("conv_id", F.col("block").alias("_from"), F.col("node").alias("_first")))
        together = met.where("_on > 1").drop("_on")
        if together.isEmpty():
            break
        shared.append(together)
        front = blocks.where(F.col("block") == number).join(together.drop("block"), "conv_id")
    first = blocks.where("block = 0").withColumn("node", nothing)
    later = blocks.where("block > 0")
    starts = stage(reduce(DataFrame.unionByName, alone), "alone")
    later = spread_lookup(later, starts, ["conv_id"], ["block"], how="left")
    if shared:
        later = later.join(reduce(DataFrame.unionByName, shared), ["conv_id", "block"], "left")
    else:
        later = later.withColumn("node", F.lit(None).cast("bigint"))
    known = F.when(F.col("block") < F.coalesce("_from", F.col("block") + 1), F.col("node"))
    node = known.when(F.col("block") == F.col("_from"), F.col("_first")).otherwise(F.col("conv_id"))
    return stage(first.unionByName(later.withColumn("node", node).drop("_from", "_first")), "keyed-blocks")


def _rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes of ``rows(block, node, ks, …)``: ``(block, node, j, depth, path, up, …)``.

    ``j`` turns of the block belong to the prefix; ``path`` and ``up`` name it and the one before. The
    prefix of no turns stays in block 0 only, where it is the root.
    """
    columns = [F.get("ks", F.lit(i)).alias(k) for i, k in enumerate(_KEYS)]
    rolled = rows.sparkSession.sql(
        f"SELECT block, node, {WIDTH} - bit_count(grouping_id()) AS j, {', '.join(_KEYS)}, {aggregates} "
        f"FROM {{rows}} GROUP BY block, node, ROLLUP({', '.join(_KEYS)})",
        rows=rows.select("*", *columns).drop("ks"),
    )
    keys = F.array(*_KEYS)
    there = F.when(F.col("j") == 0, F.col("block") == 0).otherwise(F.element_at(keys, F.greatest("j", F.lit(1))).isNotNull())

    def name(n: Column) -> Column:
        return _short(F.concat_ws(":", "block", "node", _joined(F.slice(keys, F.lit(1), n))))

    depth = (F.col("block") * WIDTH + F.col("j")).alias("depth")
    kept = rolled.where(there).select(
        "*", depth, name(F.col("j")).alias("path"), name(F.greatest(F.col("j") - 1, F.lit(0))).alias("up")
    )
    return kept.drop(*_KEYS)


def _words_upto(blocks: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """Add ``_upto``: the words of the first ``at`` turns of ``conv_id``."""
    placed = rows.withColumn("_at", at).withColumn("block", F.when(F.col("_at") > 0, F.expr(f"(_at - 1) div {WIDTH}")))
    held = blocks.select("conv_id", "block", "ws", "before")
    inside = F.slice("ws", F.lit(1), F.pmod(F.col("_at") - 1, F.lit(WIDTH)).cast("int") + 1)
    total = F.col("before") + F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return placed.join(held, ["conv_id", "block"], "left").withColumn("_upto", F.coalesce(total, F.lit(0))).drop(
        "_at", "block", "ws", "before"
    )


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations; see ``op12`` for the columns.

    ``turns(conv_id, depth, tid, words)`` numbers the turns of each conversation from 1 without
    gaps, and ``members(conv_id, n_turns)`` has every conversation once. Without conversations there is
    no prefix, not even the root.
    """
    blocks = _blocks(turns, members)
    keyed = _with_nodes(blocks)
    nodes = stage(_rollup(keyed.select("block", "node", "conv_id", "ks"), "min(conv_id) AS conv_id"), "prefixes")
    top = members.agg(F.min("conv_id")).first()[0]

    # the prefix before: by name inside a block, and known at its border
    within = spread_lookup(
        nodes.where("j > 1"), stage(nodes.where(f"j between 1 and {WIDTH - 1}").select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id")), "uppers"),
        ["up"], ["path"],
    )
    border = nodes.where("j <= 1").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.when(F.col("block") == 0, F.lit(top)).otherwise(F.col("node"))).cast("bigint")
    )
    parents = stage(within.unionByName(border).select("depth", "conv_id", "parent_conv_id"), "parents")
    children = parents.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    children = stage(children, "children")

    # per conversation: the words a smaller one has already, and whether a leaf is counted by it
    first = nodes.groupBy("conv_id").agg(F.min("depth").alias("_first"))
    known = members.join(first, "conv_id", "left").withColumn("_first", F.coalesce("_first", F.col("n_turns") + 1))
    grown = children.select("conv_id", F.col("depth").alias("n_turns"), F.lit(True).alias("_grown"))
    known = known.join(grown, ["conv_id", "n_turns"], "left").withColumn(
        "_leaf", ((F.col("_first") <= F.col("n_turns")) & F.col("_grown").isNull()).cast("bigint")
    )
    known = _words_upto(blocks, known, F.greatest(F.col("_first") - 1, F.lit(0)))
    known = stage(known.select("conv_id", "n_turns", "_first", "_leaf", F.col("_upto").alias("_had")), "members")
    valued = spread_lookup(keyed, known.select("conv_id", "_leaf", "_had"), ["conv_id"], ["block"])
    summed = _rollup(
        valued.select("block", "node", "conv_id", "ks", "_leaf", "_had"),
        "min(conv_id) AS conv_id, count(*) AS n_convs, sum(_leaf) AS n_leaves, sum(_had) AS _saved",
    ).drop("block", "node", "j", "path", "up")
    least = known.select("conv_id", F.col("_had").alias("_own"))
    summed = summed.join(parents, ["depth", "conv_id"]).join(children, ["depth", "conv_id"], "left").join(least, "conv_id")
    summed = _words_upto(blocks, summed, F.greatest(F.col("depth") - 1, F.lit(0)))
    saved = F.col("_saved") - (F.col("n_convs") - 1) * F.col("_upto") - F.col("_own")

    ends = _ends(known, keyed, nodes)
    found = summed.join(ends, ["depth", "conv_id"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves", saved.cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _ends(known: DataFrame, keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(depth, conv_id, ends_sha256)`` of the prefixes that are whole conversations.

    The ids that end at a prefix are a list of any length: the digest of lists joins short ones, streams
    longer ones and hashes very long ones in rounds.
    """
    own = known.where("_first <= n_turns").select(F.col("n_turns").alias("depth"), F.col("conv_id").alias("_least"), "conv_id")
    end = F.when(F.col("n_turns") > 0, F.expr(f"(n_turns - 1) div {WIDTH}")).otherwise(0)
    other = known.where("_first > n_turns").select("conv_id", end.cast("bigint").alias("block"))
    last = keyed.join(other, ["conv_id", "block"])
    last = last.withColumn("path", _short(F.concat_ws(":", "block", "node", _joined(F.col("ks")))))
    met = spread_lookup(last.select("conv_id", "path"), nodes.select("path", "depth", F.col("conv_id").alias("_least")), ["path"], ["conv_id"])
    ids = own.unionByName(met.select("depth", "_least", "conv_id")).select(
        F.concat_ws(":", "depth", "_least").alias("dataset_id"), F.col("conv_id").alias("ord"), F.col("conv_id").cast("string").alias("id")
    )
    ids = stage(ids, "ends")
    sizes = stage(ids.groupBy("dataset_id").agg(F.sum(F.octet_length("id").cast("bigint") + 1).alias("n_bytes")), "end-sizes")
    digests = list_digest(ids, sizes, canonical_sort=False, separator=",")
    place = F.split("dataset_id", ":")
    return digests.select(
        place[0].cast("bigint").alias("depth"), place[1].cast("bigint").alias("conv_id"), F.col("ids_sha256").alias("ends_sha256")
    )
