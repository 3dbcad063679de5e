"""The inputs of the registered queries, derived from the given tables.

Each rule has the same form in ``oracle.py``. Every rule is arithmetic on the keys
of a row, so no table is ranked or gathered to build an input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.functions import naming as N
from muster.sources.landed import text_lines

PAGE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list per document source: the lines of its documents."""
    return text_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def noisy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` with padding and blanks of several kinds."""
    value, pos = F.col("value"), F.col("pos")
    kind = (F.col("doc_id") + pos) % 5
    noisy = (
        F.when(kind == 0, F.concat(F.lit(" "), value, F.lit("\t")))
        .when(kind == 1, F.concat(F.lit("\u00a0"), value))
        .when(kind == 2, F.concat(F.lit("\u3000"), value, F.lit("\u0085")))
        .when(kind == 3, F.when(pos % 2 == 0, "").otherwise("   \u00a0"))
        .otherwise(value)
    )
    return lines(spark, sf_dir).withColumn("value", noisy)


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list per event type: the users, with very many repeats."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset_id"), F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("id")
    )


def second_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later version of ``noisy_lines``: every line, blank ones too, begins with a mark."""
    return noisy_lines(spark, sf_dir).withColumn("value", F.concat(F.lit("v2:"), F.col("value")))


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``noisy_lines`` some time later: of every fifty lines one is gone and one has changed."""
    lines = noisy_lines(spark, sf_dir)
    kind = (F.col("doc_id") + F.col("pos")) % 50
    return lines.where(kind != 7).withColumn("value", F.when(kind == 9, F.concat("value", F.lit(" changed"))).otherwise(F.col("value")))


def with_blank_lists(lines: DataFrame) -> DataFrame:
    """``lines`` and, for each list, another one that holds its places but nothing but blanks."""
    blank = lines.select(F.concat(F.lit("blank-"), "dataset_id").alias("dataset_id"), "ord", F.lit(" \t").alias("value"))
    return lines.select("dataset_id", "ord", "value").unionByName(blank)


def page_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten searches: the events by the last digit of their number."""
    dataset = F.concat(F.lit("d"), F.col("event_id") % 10)
    counts = table(spark, sf_dir, "events").groupBy(dataset.alias("dataset_id"))
    return counts.agg(F.count(F.lit(1)).alias("reported_count"))


def verdict_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_searches`` and two whose count is none: null, and below zero."""
    searches = page_searches(spark, sf_dir)
    total = searches.agg(F.sum("reported_count").alias("n"))
    unknown = total.select(F.lit("unknown").alias("dataset_id"), F.lit(None).cast("bigint").alias("reported_count"))
    negative = total.select(F.lit("negative").alias("dataset_id"), (-F.col("n")).alias("reported_count"))
    return searches.unionByName(unknown).unionByName(negative)


def result_pages(spark: SparkSession, sf_dir: str, *, faults: bool = True) -> DataFrame:
    """Their result pages of 100, with repeated requests and, if asked, faults in some datasets."""
    events = table(spark, sf_dir, "events")
    offset = F.expr("event_id div 10")
    items = events.select(
        F.concat(F.lit("d"), F.col("event_id") % 10).alias("dataset_id"),
        offset.alias("off"),
        (offset - offset % PAGE).alias("page_start"),
        F.col("user_id").cast("string").alias("id"),
    )
    whole = items.groupBy("dataset_id", "page_start").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("off", "id"))), lambda item: item["id"]).alias("ids")
    )
    placed = whole.join(F.broadcast(page_searches(spark, sf_dir)), "dataset_id")  # ten rows at any scale
    dataset, start, ids = F.col("dataset_id"), F.col("page_start"), F.col("ids")
    last = start + PAGE >= F.col("reported_count")

    def at(name: str, offset: int) -> Column:
        return (dataset == name) & (start == offset)

    no_ids = F.lit(None).cast("array<string>")
    extra = F.array_repeat(F.lit("extra"), 50)
    never = F.lit(False)
    shifted, dead = (at("d3", 300), at("d8", 700)) if faults else (never, never)
    gone = at("d0", 200) | ((dataset == "d4") & last) if faults else never
    faulty = ids if not faults else (
        F.when(at("d1", 300), F.array().cast("array<string>"))
        .when(at("d2", 400), no_ids)
        .when(at("d3", 300), F.concat(extra, ids))
        .when((dataset == "d5") & last, F.concat(ids, F.slice(extra, 1, 7)))
        .otherwise(ids)
    )
    kept = placed.where(~gone).select(
        "dataset_id",
        F.when(shifted, start - 50).otherwise(start).alias("page_start"),
        faulty.alias("ids"),
        ((start / PAGE) % 3 == 1).alias("late"),
        at("d6", 0).alias("again"),
        at("d7", 200).alias("hollow"),
        dead.alias("dead"),
    )

    def attempt(number: int, ids: Column, error: str | None = None) -> Column:
        return F.struct(
            F.lit(number).alias("attempt"), ids.alias("ids"), F.lit(error).cast("string").alias("error")
        )

    answer = F.col("ids")
    made = (
        F.when(F.col("dead"), F.array(attempt(0, no_ids, "timeout"), attempt(1, no_ids, "timeout")))
        .when(F.col("late"), F.array(attempt(0, no_ids, "timeout"), attempt(1, answer)))
        .when(F.col("again"), F.array(attempt(0, answer), attempt(1, F.array(F.lit("other")))))
        .when(F.col("hollow"), F.array(attempt(0, no_ids), attempt(1, answer)))
        .otherwise(F.array(attempt(0, answer)))
    )
    return kept.select("dataset_id", "page_start", F.explode(made).alias("made")).select(
        "dataset_id", "page_start", "made.attempt", "made.ids", "made.error"
    )


def fetch_log_columns(events: DataFrame) -> DataFrame:
    number = F.col("event_id")
    return events.select(
        (F.col("user_id") % 5).cast("string").alias("dataset_id"),
        F.expr("event_id div 10").alias("page_start"),
        (number % 10).cast("int").alias("attempt"),
        ((F.col("value") < 20) | (number % 10 < 2)).alias("failed"),
        "event_id",
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_log_columns(table(spark, sf_dir, "events")).drop("event_id")


def timed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fetch_log`` with the time of each request, and the time at which its row lands: for one in seven 5 seconds later."""
    number, attempt = F.col("event_id"), F.col("event_id") % 10
    at = F.expr("event_id div 10") * 100 + attempt * attempt * 400 + (number * 7919) % 1000
    return fetch_log_columns(table(spark, sf_dir, "events")).withColumns(
        {"at_ms": F.lit(1_704_067_200_000) + at, "landed_ms": at + F.when(number % 7 == 0, 5000).otherwise(0)}
    ).drop("event_id")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot names as they were committed, name clashes included: one list per customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("dataset_id"),
        N.snapshot_name(N.stamp_ntz(F.col("o_orderdate")), F.col("o_orderpriority")).alias("snapshot"),
        F.col("o_orderkey").alias("commit_seq"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commits`` without clashes; three in ten customers never save one as latest."""
    return _once(commits(spark, sf_dir))


def _once(commits: DataFrame) -> DataFrame:
    once = commits.groupBy("dataset_id", "snapshot").agg(F.max("commit_seq").alias("commit_seq"))
    number = F.col("commit_seq")
    update = (number % 3 != 0) & (F.col("dataset_id").cast("bigint") % 10 < 7)
    return once.withColumn("update_latest", update).withColumn("normalized_count", number % 17)


def stored_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).where(F.col("commit_seq") % 11 != 0)


def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per identifier, of the snapshots whose lists were written and not empty."""
    written = snapshots(spark, sf_dir).where((F.col("commit_seq") % 13 != 0) & (F.col("normalized_count") > 0))
    return written.select(
        "dataset_id", "snapshot", F.explode(F.sequence(F.lit(1).cast("bigint"), "normalized_count")).alias("ord")
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snapshots`` in commits: the n-th of every customer is in commit n. One commit in five died before its manifests,
    and some shards were lost."""
    number = F.col("commit_seq")
    lost, empty = number % 13 == 0, F.col("normalized_count") == 0
    turn = F.row_number().over(Window.partitionBy("dataset_id").orderBy("commit_seq")).cast("bigint")
    shard = F.when(empty, "empty").when(lost, "lost").otherwise(F.concat(F.lit("mixed-"), (number % 2).cast("string")))
    # dealt by customer at once: names are made unique and numbered without another shuffle
    return (
        _once(commits(spark, sf_dir).repartition("dataset_id"))
        .withColumns({"shard": shard, "turn": turn})
        .withColumn("commit_seq", F.col("turn"))
        .withColumn("has_manifest", F.col("turn") % 5 != 3)
        .drop("turn")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = ("create_new", "reuse_latest", "reuse_latest_or_create", "Reuse_Latest")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("dataset_id"),
        F.element_at(F.array(*map(F.lit, modes)), (F.col("c_custkey") % 4 + 1).cast("int")).alias("mode"),
        (F.col("c_acctbal") > 0).alias("has_email"),
    )


def request_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        F.when(key % 5 == 0, "").otherwise("a@example.org").alias("email"),
        F.when(key % 7 == 0, "  \t").when(key % 7 == 1, None).otherwise(F.col("c_name")).alias("query"),
        (key % 4 - 1).cast("int").alias("page_size"),
        (key % 3).cast("int").alias("max_retry_attempts"),
        F.when(key % 2 == 0, None).otherwise(1.5).alias("delay"),
        F.when(key % 6 < 3, "").otherwise("k").alias("api_key"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("dataset_id"),
        (key % 4).alias("reported_count"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, None).otherwise("w").alias("history_web_env"),
        F.when(key % 5 == 0, None).otherwise("q").alias("history_query_key"),
    )


def searches(spark: SparkSession, sf_dir: str, stamp: str) -> DataFrame:
    """One search per document source, and one without results per language."""
    documents = table(spark, sf_dir, "documents")
    by_source = documents.groupBy(F.col("source").alias("dataset_id")).agg(F.count(F.lit(1)).alias("reported_count"))
    by_lang = documents.select(F.concat(F.lit("lang-"), "lang").alias("dataset_id")).distinct()
    both = by_source.unionByName(by_lang.withColumn("reported_count", F.lit(0).cast("bigint")))
    return both.select(
        "dataset_id",
        F.concat(F.col("dataset_id"), F.lit("[All Fields]")).alias("search_query"),
        "reported_count",
        F.lit(stamp).alias("retrieved_at_utc"),
        F.upper("dataset_id").alias("translated_query"),
        F.lit("w").alias("history_web_env"),
        F.lit("1").alias("history_query_key"),
        *search_settings(),
    )


def search_settings() -> list[Column]:
    """Settings that differ from search to search, and are null in some."""
    size, even = F.length("dataset_id"), F.col("reported_count") % 2 == 0
    return [
        F.when(even, size * 100).cast("int").alias("page_size"),
        F.when(~even, size / 8).cast("double").alias("request_delay_seconds"),
        F.when(size % 2 == 0, size).cast("int").alias("max_retry_attempts"),
    ]
