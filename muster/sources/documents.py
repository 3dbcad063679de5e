"""JSON documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.sources.lines import file_name


def read_json_documents(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, *, encoding: str = "utf-8", **options: str
) -> DataFrame:
    """One row per document under ``path``, with the file it came from.

    Each file holds one document, indented or not. A document that does not parse
    raises. Keys the schema does not name are not read.
    """
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    rows = reader.option("encoding", encoding).options(**options).json(path)
    return rows.select(file_name().alias("file"), "*")


def read_json_values(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """``(file, value)``: documents of any shape, as VARIANT."""
    rows = spark.read.options(**options).text(path, wholetext=True)
    return rows.select(file_name().alias("file"), F.parse_json("value").alias("value"))


def json_field(column: str, path: str, kind: str = "string"):
    """One field of a JSON text column; null where it is absent."""
    return F.get_json_object(column, path).cast(kind)
