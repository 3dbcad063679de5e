"""Mix sources to target weights by systematic sampling.

Within a source the documents stand in a fixed order; the prefix sum of their expected
copies, shifted by one random offset, crosses whole numbers, and a document is emitted
once per number crossed. The order is by size, so neighbours have like sizes and the
words taken differ from the target by about one document at most.

Expected copies are integers in units of 1/UNIT, so prefix sums are exact and do not
depend on how rows are dealt over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import stage

UNIT = 1_000_000_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``(source, source_size)`` to a target for each source.

    Sources take the weights in turn, in code-point order with null last. The targets
    share the total by weight; none exceeds ``cap`` times its source's size, and the
    excess is shared by weight among the others until none is above. Only three sums
    a round reach the driver, and each round settles at least one source.
    An empty total gives targets of 0.
    """
    # one row a source; a window without keys sees the list of sources only
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = stage(sizes.select("source", "source_size", weight.cast("bigint").alias("_w")), "mix-sources")
    limit = F.col("source_size") * cap
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped_size, free_weight, settled = 0, ranked.agg(F.sum("_w")).first()[0] or 0, -1
    share = 0.0
    while free_weight:
        share = (total - cap * capped_size) / free_weight
        above = F.col("_w") * F.lit(share) > limit
        n, size, weight_left = ranked.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0)),
        ).first()
        if n == settled:
            break
        settled, capped_size, free_weight = n, size, weight_left
    target = F.when(F.col("_w") * F.lit(share) > limit, limit.cast("double")).otherwise(F.col("_w") * F.lit(share))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def _offset(seed: int) -> Column:
    """One number below UNIT for each source, the same in every run."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    return F.pmod(F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("bigint"), F.lit(UNIT))


def _local_sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition and the prefix sum of ``_e`` within the partition, per source."""
    part = TaskContext.get().partitionId()
    current, total = None, 0
    for batch in source:
        expected = batch.column("_e").to_numpy(zero_copy_only=False).astype(np.int64)
        keys = batch.column("_key").to_pylist()
        sums = np.empty(len(expected), dtype=np.int64)
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if keys[start] != current:
                current, total = keys[start], 0
            run = total + np.cumsum(expected[start:i])
            sums[start:i] = run
            total = int(run[-1])
            start = i
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sums), pa.array(np.full(len(sums), part, dtype=np.int64))],
            names=[*batch.schema.names, "_sum", "_part"],
        )


def systematic_copies(rows: DataFrame, order: list[str], *, seed: int = 0) -> DataFrame:
    """Add ``copies`` to rows of ``(source, _e, …)``, ``_e`` the expected copies times UNIT.

    One range shuffle over ``(source, order)`` spreads a large source over many tasks. Each
    task sums its own rows; what stands before them is a sum over one row per source and
    task. Rows that tie in ``order`` are alike, so any of them may take the place of another.
    Partition sums stay below 2**63 for 10**9 copies a task; totals are exact decimals.
    """
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    by = ["_key", *order, "_e"]
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    placed = stage(ranged.mapInArrow(_local_sums, f"{fields}, _sum bigint, _part bigint"), "mix-sums")
    runs = placed.groupBy("_key", "_part").agg(F.sum(F.col("_e").cast("decimal(38,0)")).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # only what exceeds a whole number matters to the crossings that follow
    starts = starts.withColumn("_before", (F.col("_before") % UNIT).cast("bigint"))
    joined = placed.join(starts, ["_key", "_part"]).withColumn("_to", F.col("_before") + F.col("_sum") + _offset(seed))
    crossed = F.expr(f"_to div {UNIT} - (_to - _e) div {UNIT}")
    return joined.select(*[c for c in rows.columns if c != "_e"], crossed.cast("bigint").alias("copies"))


def mix(documents: DataFrame, *, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``(doc_id, source, text)`` to copies: ``doc_id, source, size, source_size, target, copies, taken``.

    A null text has size 0. Null is a source of its own, last in order. A source of size
    0 has target 0 and takes nothing. Repeated rows are sampled one by one. An empty
    table gives no rows. Other columns are not looked at.
    """
    sized = stage(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix_sized(sized, seed=seed, weights=weights, cap=cap)


def mix_sized(sized: DataFrame, *, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``mix`` over rows of a table that already have a ``size``; columns besides are kept.

    Names that begin with an underscore, and those ``mix`` adds, are taken.
    """
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, cap=cap)
    # AQE splits a source with a large share of the rows, or sends the targets to every task
    # when their measured size is below its threshold
    targets = targets.withColumnRenamed("source", "_source")
    known = sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).drop("_source")
    expected = F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))
    known = known.withColumn("_e", F.when(F.col("source_size") > 0, expected).otherwise(0).cast("bigint"))
    rest = [c for c in sized.columns if c not in ("size", "doc_id", "source")]
    known = known.withColumn("_tie", F.xxhash64(*rest) if rest else F.lit(0))  # a short sort key, whatever the columns
    taken = F.col("copies") * F.col("size")
    return systematic_copies(known, ["size", "doc_id", "_tie"], seed=seed).drop("_tie").withColumn("taken", taken)
