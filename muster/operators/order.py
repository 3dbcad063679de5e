"""Order within a dataset without putting a dataset into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.lookup import spread_lookup
from muster.shared import stage

# Widths of the cells in ``previous_in_order``, each a multiple of the one before: a
# cell holds at most 2**18 rows or 2**12 cells, and 10**14 offsets are 10**5 cells.
CELL_WIDTHS = (1 << 18, 1 << 30)


def range_stage(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sort by ``keys`` and ``order`` over range partitions, and write the result.

    Adds ``_seq``, which grows along the sort. Its upper bits are the partition, so
    ``_seq >> 33`` names a contiguous run of bounded size. Writing fixes both.
    """
    by = [*keys, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stage(ranged.withColumn("_seq", F.monotonically_increasing_id()), "ranged")


def dense_position(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """Number the rows of each key 1, 2, 3 … in ``order``, which must be unique within a key.

    One range shuffle. Each run of a key within a partition is numbered by itself;
    the runs (at most one per partition and key) carry the running total.
    """
    ranged = range_stage(rows, keys, order).withColumn("_part", F.shiftright("_seq", 33))
    runs = ranged.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        runs.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
        "runs",
    )
    joined = spread_lookup(ranged, starts, [*keys, "_part"], ["_seq"])
    position = F.col("_before") + F.col("_seq") - F.col("_first") + 1
    return joined.select(*rows.columns, position.cast("bigint").alias(out))


def previous_in_order(
    rows: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    out: str,
    widths: Sequence[int] = CELL_WIDTHS,
) -> DataFrame:
    """Add the ``value`` of the row before, by ``position``, which must be unique within a key.

    Positions are cut into cells of fixed width. ``lag`` runs inside a cell; the
    first row of a cell takes the last value of the nearest cell before it, found
    by the same step one level up.
    """
    if not widths:
        return rows.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(position)))
    width, *wider = widths
    level = len(widths)
    cell, edge, before, inside = (f"_{name}{level}" for name in ("cell", "edge", "before", "inside"))
    celled = rows.withColumn(cell, F.col(position) - F.pmod(F.col(position), F.lit(width)))
    edges = celled.groupBy(*keys, cell).agg(F.max_by(value, position).alias(edge))
    edges = previous_in_order(edges, keys, cell, edge, before, wider)
    within = Window.partitionBy(*keys, cell).orderBy(position)
    return (
        celled.withColumn(inside, F.lag(value).over(within))
        .join(edges.drop(edge), [*keys, cell])
        .withColumn(out, F.coalesce(inside, before))
        .drop(cell, inside, before)
    )
