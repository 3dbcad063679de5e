"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import (
    bpe, cap_filters, chat_format, html_text, katz, line_dedup, media, merkle, mixing, prefix_trie, simhash, token_shards, toxicity,
)
from muster.llm.common import read_table

VOCABULARY = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, "doc_id", "text", model)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted")
    )


@_query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages, "html")


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op4_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_text_features(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query
def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = cap_filters.near_classes(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return classes.withColumnRenamed("id", "vec_id")


@_query
def op6_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path())


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(pages).select("doc_id", "text", "n_lines", "n_dropped")


@_query
def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return classes.select(
        F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id"
    )


@_query
def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return katz.katz_scores(documents, "doc_id", "text", "held_out")


@_query
def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folder, dictionary = token_shards.write_shards(
        read_table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path()
    )
    return token_shards.read_shards(files, folder, dictionary)


@_query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_tampered(read_table(spark, sf_dir, "documents"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = prefix_trie.placed_turns(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.with_lent_heads(placed))


@_query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_control_texts(read_table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.expand(rows))
