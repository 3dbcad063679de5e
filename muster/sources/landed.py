"""Tables that arrive from outside: landed pages and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.pages import PAGE_SCHEMA

# Places per text in ``ord``; the upper bits hold the number of the text.
LINE_BITS = 24


def read_pages(spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options: str) -> DataFrame:
    """Landed result pages, ``PAGE_SCHEMA``, from parquet or JSON."""
    return spark.read.schema(PAGE_SCHEMA).format(fmt).options(**options).load(path)


def text_lines(texts: DataFrame, dataset: str, number: str, text: str) -> DataFrame:
    """``(dataset_id, ord, value)`` plus ``number`` and ``pos``: the lines of a text column.

    Texts are cut at LF; ``ord`` orders by text number, then by place in the text.
    A text of more than 2**24 lines raises, and so does a number outside -2**39 to 2**39 - 1,
    for which ``ord`` has no place.
    """
    lines = texts.select(
        F.col(dataset).cast("string").alias("dataset_id"),
        F.col(number).cast("bigint").alias(number),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "value"),
    )
    place = F.when(F.col("pos") < (1 << LINE_BITS), F.col("pos")).otherwise(
        F.raise_error(F.lit("text has too many lines"))
    )
    top = 1 << (63 - LINE_BITS)
    base = F.when(F.col(number).between(-top, top - 1), F.col(number)).otherwise(
        F.raise_error(F.lit("text number has no place in the order")).cast("bigint")
    )
    order = base * F.lit(1 << LINE_BITS) + place
    return lines.select("dataset_id", order.alias("ord"), "value", number, F.col("pos").cast("bigint").alias("pos"))
