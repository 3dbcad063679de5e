"""Pages that are still arriving: the loop over result pages as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muster.operators.pages import PAGE_SCHEMA, flatten_pages, succeeded


def stream_pages(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Pages as their files arrive under ``path``."""
    return spark.readStream.schema(PAGE_SCHEMA).format(fmt).options(**options).load(path)


def append_identifiers(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the items of every successful page to the table at ``path``, each file once.

    No state is kept: each offset must succeed once in what lands. The page check
    runs on the landed pages before they are frozen.
    """
    items = flatten_pages(pages.where(succeeded()))
    return (
        items.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def extracted_so_far(pages: DataFrame) -> DataFrame:
    """``(dataset_id, extracted)``, updated as pages arrive; state is one count per dataset."""
    landed = pages.where(succeeded())
    return landed.groupBy("dataset_id").agg(F.sum(F.size("ids")).alias("extracted"))
