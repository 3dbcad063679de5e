"""Reading, staging and Arrow helpers shared by the operators of this package."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.shared import fresh_path, stage

__all__ = ["batches", "column", "input_partitions", "read_table", "row_hash", "sha256_hex", "stage", "stage_small", "word_pieces"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_small(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` with zstd, for wide binary columns, and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_hash(df: DataFrame) -> Column:
    """A hash over all columns of a row, which of them are null included."""
    return F.xxhash64(F.concat(*[F.col(c).isNull().cast("string") for c in df.columns]), *df.columns)


def input_partitions(df: DataFrame) -> int:
    """Partitions of a scan: a number that grows with the bytes read."""
    return max(1, df.rdd.getNumPartitions())


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batches(source: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches, so that the texts held as Python objects stay few.

    At the end Arrow gives back what it holds, as workers wait for tasks of other stages.
    """
    for batch in source:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


PIECE = 1 << 20  # bytes of a text that are split into words at a time


def word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """Lists of words; a long text comes in pieces cut at white space (0x20, 0x09-0x0D)."""
    start = 0
    while start < len(data):
        end = start + PIECE
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end].split()
        start = end


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
