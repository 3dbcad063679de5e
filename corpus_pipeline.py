"""From raw documents to token ids: five stages, each over all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. Each result is written as
Parquet in the folder all executors share and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import bpe, line_dedup, mixing, simhash, toxicity
from muster.llm.common import read_table, row_hash, stage_small
from muster.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model of the labels of the documents given."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(*COLUMNS), "text", model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; no document goes.

    Copies of a text count once, so that a copied document keeps its lines for the next stage.
    """
    cut = line_dedup.drop_boilerplate(docs.select(*COLUMNS), host="source", text="text", copies_once=True)
    size = F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times.

    Sampling moves ids, sizes and hashes of rows; whole rows meet their copies at the end. Equal rows
    are sampled one by one and their copies summed. Null and empty texts have no words and are not taken.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("row_key", row_hash(docs))
    sized = stage_small(keyed.select("doc_id", "source", "row_key", mixing.word_count(F.col("text")).alias("size")), "sizes")
    taken = mixing.mix_sized(sized).groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")
    )
    taken = stage_small(taken, "copies")
    if not taken.where("_rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", "row_key"])
    same = keyed["doc_id"].eqNullSafe(taken["_id"]) & (keyed["row_key"] == taken["_key"])
    joined = keyed.join(taken.where("_copies > 0"), same)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, lang, n_tokens, ids)`` of every document taken."""
    keyed = docs.select(F.struct("doc_id", "source", "lang").alias("key"), "text")
    encoded = bpe.encode_documents(keyed, "key", "text", vocabulary_path())
    return encoded.select("key.*", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the first stage's decoding nor the last one's merges; tests/llm holds
#: the rows against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_small(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
