"""Attaching one row per key to many rows per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.shared import stage

BROADCAST_ROWS = 100_000
HEAVY_ROWS = 10_000_000


def spread_lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    *,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``table``, which is staged and has one short row per key.

    The table is counted first and broadcast only up to ``broadcast_rows``. Beyond
    that it is a shuffled join in which every key with more than ``heavy_rows`` rows
    is split by a hash of ``spread_by``, and its table row copied to each part. By
    the threshold chosen there are fewer such keys than ``broadcast_rows``.
    """
    keys = list(keys)
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(table), keys, how)
    counts = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(heavy_rows, math.ceil(total / broadcast_rows))
    parts = F.ceil(F.col("_n") / limit).cast("bigint")
    heavy = F.broadcast(counts.where(F.col("_n") > limit).select(*keys, parts.alias("_parts")))
    one = F.lit(1).cast("bigint")
    salted = rows.join(heavy, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("_parts", one))
    )
    copies = table.join(heavy, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(one - 1, F.coalesce("_parts", one) - 1))
    )
    return salted.drop("_parts").join(copies.drop("_parts"), [*keys, "_salt"], how).drop("_salt")
