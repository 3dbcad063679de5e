"""Normalising identifier lists: text, strip, drop empty, dedup, order.

Input and output are tables ``(dataset_id, ord, <value>)``: one row per list
item, with the place in the list in ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.text import as_text, strip


def stripped(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(dataset_id, ord, id)`` with blanks kept as empty text."""
    text = F.coalesce(strip(as_text(lines, value)), F.lit(""))
    return lines.select("dataset_id", "ord", text.alias("id"))


def stable_dedup(ids: DataFrame) -> DataFrame:
    """Keep the first occurrence of each identifier of a dataset.

    The buffer is one bigint, so this is a hash aggregation with partial results
    on the map side: any number of copies of one identifier costs one row per task.
    """
    return ids.groupBy("dataset_id", "id").agg(F.min("ord").alias("ord")).select("dataset_id", "ord", "id")


def normalize(lines: DataFrame, value: str = "value", *, dedup: bool = True) -> DataFrame:
    """``(dataset_id, ord, id)`` without blanks, and without repeats if ``dedup``.

    Order is data here: list order is ``ord``, canonical order is ``id`` (then
    ``ord``) under the default binary collation, which is code-point order.
    """
    ids = stripped(lines, value).where(F.col("id") != "")
    return stable_dedup(ids) if dedup else ids


def normalize_counted(lines: DataFrame, value: str = "value", *, dedup: bool = True) -> DataFrame:
    """``(dataset_id, ord, id, copies)`` with blanks kept as ``id = ''``.

    One pass over the input gives the normalised list (``id <> ''``) and the raw
    count (the sum of ``copies``).
    """
    ids = stripped(lines, value)
    if not dedup:
        return ids.withColumn("copies", F.lit(1).cast("bigint"))
    return (
        ids.groupBy("dataset_id", "id")
        .agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("copies"))
        .select("dataset_id", "ord", "id", "copies")
    )


def measure_distinct(ids: DataFrame) -> DataFrame:
    """``measure`` of ``stripped`` rows without repeats. What is shuffled is 16 bytes of SHA-256 for an identifier."""
    mark = F.substring(F.unhex(F.sha2("id", 256)), 1, 16)
    once = ids.groupBy("dataset_id", mark.alias("_mark")).agg(
        F.count(F.lit(1)).alias("_copies"), F.max(F.octet_length("id")).alias("_bytes")
    )
    kept = F.col("_bytes") > 0
    return once.groupBy("dataset_id").agg(
        F.sum("_copies").alias("raw_count"),
        F.count(F.when(kept, 1)).alias("normalized_count"),
        F.coalesce(F.sum(F.when(kept, F.col("_bytes").cast("bigint") + 1)), F.lit(0)).cast("bigint").alias("n_bytes"),
    )


def _first_of_batch(keys: list[str]):
    """The step that leaves one row, with the least ``ord``, of the rows of a batch that agree in ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                once = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("ord", "min")])
                yield from once.rename_columns([*keys, "ord"]).select(batch.schema.names).cast(batch.schema).combine_chunks().to_batches()

    return run


def sorted_once(ids: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``ids`` range-partitioned and sorted by ``by``, each once, with its least ``ord``.

    ``by`` ends in ``id`` and, with ``ord``, names all columns. One shuffle does for the repeats and for the order. Copies
    meet in one task, so they are first made one within a batch: a text that comes any number of times costs a row a batch.
    """
    columns = [*by, "ord"]
    rows = ids.select(*columns)
    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    ranged = rows.mapInArrow(_first_of_batch(by), fields).repartitionByRange(*by)
    return ranged.groupBy(*by).agg(F.min("ord").alias("ord")).select(*columns).sortWithinPartitions(*by)


def list_order(canonical_sort: bool) -> list[str]:
    """The columns that order a normalised list within its dataset."""
    return ["id", "ord"] if canonical_sort else ["ord"]


def sort_list(ids: DataFrame, *, canonical_sort: bool) -> DataFrame:
    """Range-partition and sort by dataset and list order.

    ``ord`` is part of the range key, so a run of equal identifiers can be split.
    """
    keys = ["dataset_id", *list_order(canonical_sort)]
    return ids.repartitionByRange(*keys).sortWithinPartitions(*keys)


def measure(counted: DataFrame) -> DataFrame:
    """``(dataset_id, raw_count, normalized_count, n_bytes)`` of ``normalize_counted``.

    ``n_bytes`` is the length of the normalised list as lines of UTF-8. Datasets
    with nothing but blanks are kept.
    """
    kept = F.col("id") != ""
    return counted.groupBy("dataset_id").agg(
        F.sum("copies").alias("raw_count"),
        F.count(F.when(kept, 1)).alias("normalized_count"),
        F.coalesce(F.sum(F.when(kept, F.octet_length("id").cast("bigint") + 1)), F.lit(0)).cast("bigint").alias("n_bytes"),
    )


def counts_by_dataset(lines: DataFrame, value: str = "value", *, dedup: bool = True) -> DataFrame:
    """``(dataset_id, raw_count, normalized_count)``."""
    return measure(normalize_counted(lines, value, dedup=dedup)).drop("n_bytes")
