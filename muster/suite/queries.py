"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions import naming as N
from muster.functions import requests as R
from muster.operators import catalog as C
from muster.operators import manifest as M
from muster.operators import pages as P
from muster.operators.digest import content_digest, digest_of_lines, file_digests, list_digest
from muster.operators.normalize import counts_by_dataset, measure, normalize, normalize_counted, stable_dedup
from muster.operators.order import dense_position
from muster.operators.retries import backoff_schedule, failed_datasets, retry_outcome
from muster.operators.tree import tree_digest
from muster.plans import store, summary
from muster.plans.commit import commit_snapshots
from muster.plans.diff import diff, diff_counts
from muster.plans.leaves import index_commit, nodes, nodes_path
from muster.plans.resolve import activate
from muster.plans.verify import verify_snapshots
from muster.shared import PACKED, fresh_path, stage
from muster.sinks.documents import write_json
from muster.sinks.text import write_lines, write_normalized_lines
from muster.sources import tree
from muster.sources.documents import json_field, read_json_documents
from muster.sources.files import list_files, open_path
from muster.sources.landed import read_pages
from muster.sources.lines import part_number, read_lines
from muster.streaming.due import queue_requests, stream_log
from muster.streaming.landing import append_identifiers, stream_pages
from muster.streaming.verdicts import follow_verdicts, land_identifiers, last_verdicts
from muster.suite import inputs as I

LATE = "2024-01-02T00:00:00Z"
EARLY = "2024-01-01T00:00:00Z"

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _REGISTRY[name] = function
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Normalising and identity


@_query("normalize_lines")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(I.noisy_lines(spark, sf_dir), dedup=False)


@_query("normalize_policy_matrix")
def normalize_policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = I.noisy_lines(spark, sf_dir)
    parts = []
    for dedup in (False, True):
        ids = stage(normalize(noisy, dedup=dedup), "normalized")
        for canonical_sort, order in ((False, ["ord"]), (True, ["id", "ord"])):
            placed = dense_position(ids, ["dataset_id"], order)
            parts.append(
                placed.select(
                    F.lit(dedup).alias("dedup"), F.lit(canonical_sort).alias("canonical_sort"), "dataset_id", "id", "position"
                )
            )
    return _union(parts)


@_query("stable_dedup")
def stable_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_dedup(I.identifiers(spark, sf_dir)).select("dataset_id", "id", "ord")


@_query("canonical_position")
def canonical_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = normalize(I.noisy_lines(spark, sf_dir))
    return dense_position(ids, ["dataset_id"], ["id"]).select("dataset_id", "id", "position")


@_query("counts_by_dataset")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by_dataset(I.noisy_lines(spark, sf_dir))


@_query("digest_canonical")
def digest_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_of_lines(I.noisy_lines(spark, sf_dir), dedup=True, canonical_sort=True)


@_query("digest_stable")
def digest_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_of_lines(I.noisy_lines(spark, sf_dir), dedup=True, canonical_sort=False)


@_query("digest_as_is")
def digest_as_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_of_lines(I.noisy_lines(spark, sf_dir), dedup=False, canonical_sort=False)


@_query("digest_sorted")
def digest_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_of_lines(I.noisy_lines(spark, sf_dir), dedup=False, canonical_sort=True)


@_query("digest_chained")
def digest_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list is longer than the bound here, so all are hashed in rounds."""
    orders = I.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset_id"), F.col("l_orderkey").alias("ord"), F.col("l_orderkey").alias("value")
    )
    counted = stage(normalize_counted(orders), "normalized")
    sizes = stage(measure(counted), "sizes")
    run_bytes = sizes.agg(F.sum("n_bytes")).first()[0] // 4 + 1
    return list_digest(counted, sizes, canonical_sort=True, flat_bytes=0, run_bytes=run_bytes)


@_query("digest_bucketed")
def digest_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stage(normalize_counted(I.noisy_lines(spark, sf_dir), dedup=False), "normalized")
    sizes = stage(measure(counted), "sizes")
    return tree_digest(counted.where(F.col("id") != ""), sizes, distinct=False, leaf_rows=16)


@_query("content_digest")
def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", content_digest(F.col("text")).alias("sha256"))


@_query("file_digest")
def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as text files, a few per source; and the identity of the same lists.

    The two differ: a file ends with a line end, and a list does not.
    """
    name = F.concat_ws("-", "source", F.col("doc_id") % 4)
    ids = stage(I.table(spark, sf_dir, "documents").select(name.alias("dataset_id"), F.col("doc_id").alias("ord"), F.col("text").alias("id")))
    path = fresh_path(spark, "files")
    (
        ids.repartition("dataset_id").sortWithinPartitions("dataset_id", "ord").select("dataset_id", "id")
        .write.partitionBy("dataset_id").text(path)
    )
    files = file_digests(spark, path).select(
        F.regexp_extract("path", "dataset_id=([^/]+)/", 1).alias("dataset_id"), "length", "sha256"
    )
    sizes = stage(ids.groupBy("dataset_id").agg(F.sum(F.octet_length("id").cast("bigint") + 1).alias("n_bytes")))
    return files.join(list_digest(ids, sizes, canonical_sort=False), "dataset_id")


# Pages and requests


@_query("page_verdict")
def page_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_verdict(I.result_pages(spark, sf_dir), I.verdict_searches(spark, sf_dir))


@_query("page_grid")
def page_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_grid(I.result_pages(spark, sf_dir), widths=(400, 800))


@_query("flatten_pages")
def flatten_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flatten_pages(P.first_success(I.result_pages(spark, sf_dir, faults=False)))


@_query("landed_stream")
def landed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = fresh_path(spark, "landing")
    P.first_success(I.result_pages(spark, sf_dir, faults=False)).write.parquet(landing)
    target = fresh_path(spark, "streamed")
    append_identifiers(stream_pages(spark, landing), target, fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.schema("dataset_id string, ord bigint, id string").parquet(target)


@_query("landed_replay")
def landed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, and all of them again after a restart from the checkpoint: each offset is read once."""
    landing, target, checkpoint = (fresh_path(spark, name) for name in ("landing", "streamed", "offsets"))
    won = P.first_success(I.result_pages(spark, sf_dir, faults=False))
    for _ in range(2):
        won.write.mode("append").parquet(landing)
        land_identifiers(stream_pages(spark, landing), target, checkpoint).awaitTermination()
    return spark.read.schema("dataset_id string, ord bigint, id string").parquet(target)


@_query("stream_verdicts")
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts land, then the others after a restart: the last verdicts are those of all pages."""
    landing, target, checkpoint = (fresh_path(spark, name) for name in ("landing", "verdicts", "offsets"))
    pages, searches = I.result_pages(spark, sf_dir), stage(I.verdict_searches(spark, sf_dir), "searches")
    for landed in (pages.where("attempt = 0"), pages.where("attempt > 0")):
        landed.write.mode("append").parquet(landing)
        follow_verdicts(stream_pages(spark, landing), searches, target, checkpoint).awaitTermination()
    return last_verdicts(searches, target).select("dataset_id", "reported_count", "verdict")


@_query("due_requests")
def due_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lands in three parts, with restarts between them, rows out of order and the part before once more."""
    landing, target, checkpoint = (fresh_path(spark, name) for name in ("landing", "due", "offsets"))
    log = stage(I.timed_log(spark, sf_dir), "log")
    third = F.lit(log.agg(F.max("landed_ms")).first()[0] / 3 + 1)
    rows = log.withColumn("part", F.floor(F.col("landed_ms") / third)).withColumn("at", F.timestamp_millis("at_ms"))
    rows = rows.withColumn("attempt", F.col("attempt").cast("bigint")).drop("at_ms", "landed_ms")
    for part in range(3):
        rows.where(F.col("part").between(part - 1, part)).drop("part").write.mode("append").parquet(landing)
        queue_requests(
            stream_log(spark, landing), target, checkpoint, delay_seconds=0.34, max_attempts=5, lateness="10 seconds", cell=64
        ).awaitTermination()
    due = spark.read.schema("dataset_id string, page_start bigint, attempt bigint, due_at timestamp, action string").parquet(target)
    return due.withColumn("due_at", F.unix_millis("due_at")).withColumnRenamed("due_at", "due_ms")


@_query("page_progress")
def page_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = P.first_success(I.result_pages(spark, sf_dir, faults=False))
    return P.page_progress(won, I.page_searches(spark, sf_dir))


@_query("landed_pages")
def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as JSON by one job and read by another, what failed included."""
    path = write_json(I.result_pages(spark, sf_dir), fresh_path(spark, "landed"))
    return read_pages(spark, path, fmt="json").select(
        "dataset_id", "page_start", "attempt", F.size("ids").alias("n_ids"), F.try_element_at("ids", F.lit(-1)).alias("last_id"), "error"
    )


@_query("retry_outcome")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry_outcome(I.fetch_log(spark, sf_dir), max_attempts=3)


@_query("failed_datasets")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_datasets(I.result_pages(spark, sf_dir), max_attempts=1)


@_query("backoff_schedule")
def backoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_schedule(I.fetch_log(spark, sf_dir), delay_seconds=R.DELAY_WITHOUT_KEY, max_attempts=5)


@_query("request_violations")
def request_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    arguments = I.request_arguments(spark, sf_dir)
    names = ("email", "query", "page_size", "max_retry_attempts")
    return arguments.select(
        "request_id",
        R.request_violation(*map(F.col, names)).alias("violation"),
        R.resolved_delay(F.col("delay"), F.col("api_key")).alias("request_delay_seconds"),
    )


@_query("header_check")
def header_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = R.header_is_broken(F.col("reported_count"), F.col("history_web_env"), F.col("history_query_key"))
    return I.headers(spark, sf_dir).select("dataset_id", "reported_count", broken.alias("broken"))


@_query("mode_check")
def mode_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = I.requests(spark, sf_dir).groupBy("mode").agg(F.count(F.lit(1)).alias("n_requests"))
    return modes.withColumn("valid", R.mode_is_valid(F.col("mode")))


# Names, manifests and the catalog


@_query("utc_stamp")
def utc_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events").select("event_id", N.stamp_ntz(F.col("ts")).alias("retrieved_at_utc"))


@_query("snapshot_name")
def snapshot_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0")
    stamp = F.concat(F.lit("2024-05-06T07:08:"), second, F.lit("Z"))
    return I.table(spark, sf_dir, "part").select(
        "p_partkey",
        N.query_hash(F.col("p_name")).alias("query_hash"),
        N.snapshot_name(stamp, F.col("p_name")).alias("snapshot"),
    )


@_query("layout_paths")
def layout_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.concat(F.lit("/store/"), F.col("dataset_id"))
    directory, latest = N.snapshot_dir(root, F.col("snapshot")), N.latest_dir(root)
    return I.snapshots(spark, sf_dir).select(
        "dataset_id",
        "snapshot",
        N.manifest_path(directory).alias("manifest_path"),
        N.ids_path(directory).alias("ids_path"),
        N.manifest_path(latest).alias("latest_manifest_path"),
        N.ids_path(latest).alias("latest_ids_path"),
    )


@_query("manifest_rows")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stage(normalize_counted(I.noisy_lines(spark, sf_dir)), "normalized")
    ids = counted.where(F.col("id") != "")
    sizes = stage(measure(counted), "sizes")
    digests = list_digest(ids, sizes, canonical_sort=True).join(tree_digest(ids, sizes, distinct=True), "dataset_id")
    searches = M.assign_shards(M.complete_searches(I.searches(spark, sf_dir, LATE)), sizes)
    rows = M.manifest_rows(searches, sizes, digests, dedup=True, canonical_sort=True)
    return rows.drop("engine_version")


@_query("snapshot_collisions")
def snapshot_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collisions(I.commits(spark, sf_dir))


@_query("latest_pointer")
def latest_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_pointer(I.stored_manifests(spark, sf_dir))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_snapshots(I.stored_ids(spark, sf_dir), I.stored_manifests(spark, sf_dir))


@_query("list_snapshots")
def list_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir)


@_query("most_recent_snapshot")
def most_recent_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.most_recent_snapshots(_listing(spark, sf_dir))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointers = C.latest_pointer(I.snapshots(spark, sf_dir))
    return C.latest_state(I.requests(spark, sf_dir), pointers, _listing(spark, sf_dir))


@_query("latest_available")
def latest_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)


@_query("resolve_requests")
def resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve_requests(I.requests(spark, sf_dir), _state(spark, sf_dir))


# Files


def _as_ids(lines: DataFrame) -> DataFrame:
    return lines.select("dataset_id", "ord", F.col("value").alias("id"))


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_lines(spark, path, partitions="dataset_id string", **options)


def put_files(files: DataFrame, root: str) -> None:
    """Write each ``text`` of ``(place, text)`` as the file ``place`` below ``root``, by tasks."""

    def run(source):
        for batch in source:
            store, at = open_path(root)
            for place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store.create_dir(f"{at}/{place}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{at}/{place}") as out:
                    out.write(text.encode())
            yield batch.select(["place"])

    files.select("place", "text").mapInArrow(run, "place string").write.format("noop").mode("overwrite").save()


def _in_file_order(read: DataFrame, value: str) -> DataFrame:
    """Part files hold a list in the order of the numbers in their names."""
    numbered = read.withColumn("part", part_number())
    return dense_position(numbered, ["dataset_id"], ["part", "file", "ord"]).select(
        "dataset_id", F.col("value").alias(value), "position"
    )


@_query("reader_matrix")
def reader_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_lines(_as_ids(I.noisy_lines(spark, sf_dir)), fresh_path(spark, "text"))
    parts = []
    for strip in (True, False):
        for skip in (True, False):
            read = _read(spark, path, strip_lines=strip, skip_empty_lines=skip)
            parts.append(
                read.groupBy("dataset_id")
                .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))
                .select(
                    F.lit(strip).alias("strip_lines"), F.lit(skip).alias("skip_empty_lines"), "dataset_id", "n_lines", "n_chars"
                )
            )
    return _union(parts)


@_query("encoded_roundtrip")
def encoded_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_lines(_as_ids(I.lines(spark, sf_dir)), fresh_path(spark, "text"), encoding="latin-1")
    read = _read(spark, path, encoding="latin-1", skip_empty_lines=False, strip_lines=False)
    return _in_file_order(read, "value")


@_query("encoding_audit")
def encoding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text written in another charset, read as UTF-8 without the strict check."""
    path = write_lines(_as_ids(I.lines(spark, sf_dir)), fresh_path(spark, "text"), encoding="latin-1")
    read = _read(spark, path, strip_lines=False, skip_empty_lines=False, strict=False)
    return read.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count(F.when(~F.is_valid_utf8("value"), 1)).alias("n_invalid")
    )


@_query("text_roundtrip")
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list, and at position 0 the lists of which nothing is left: they are empty files."""
    lines = I.with_blank_lists(I.noisy_lines(spark, sf_dir))
    path = write_normalized_lines(lines, fresh_path(spark, "text"), canonical_sort=True)
    empty = list_files(spark, path).where("length = 0").select(
        F.regexp_extract("path", "dataset_id=([^/]+)/", 1).alias("dataset_id"),
        F.lit(None).cast("string").alias("id"),
        F.lit(0).cast("bigint").alias("position"),
    )
    return _in_file_order(_read(spark, path), "id").unionByName(empty)


@_query("verbatim_roundtrip")
def verbatim_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_lines(_as_ids(I.noisy_lines(spark, sf_dir)), fresh_path(spark, "text"))
    return _in_file_order(_read(spark, path, strip_lines=False, skip_empty_lines=False), "value")


@_query("json_roundtrip")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.snapshots(spark, sf_dir)
    path = write_json(rows, fresh_path(spark, "json"))
    return spark.read.schema(rows.schema).json(path)


@_query("json_documents")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_json(I.table(spark, sf_dir, "customer"), fresh_path(spark, "json"))
    schema = "c_custkey bigint, c_name string, c_acctbal double, c_comment string"
    return read_json_documents(spark, path, schema, multiLine="false").drop("file")


@_query("json_documents_indented")
def json_documents_indented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a file, over several lines: a file for every supplier."""
    path = fresh_path(spark, "json")
    document = F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey"), {"pretty": "true"})
    place = F.format_string("%03d/%d.json", F.col("s_suppkey") % 1000, F.col("s_suppkey").cast("bigint"))
    put_files(I.table(spark, sf_dir, "supplier").select(place.alias("place"), document.alias("text")), path)
    schema = "s_suppkey bigint, s_name string, s_nationkey bigint, s_note string"
    return read_json_documents(spark, path, schema, recursiveFileLookup="true").drop("file")


@_query("tree_snapshots")
def tree_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories as another tool writes them, one list a file, read back with their manifests.

    All lines of a hundred documents are a list, so lists stay bounded and their number grows with the table.
    """
    block = F.concat(F.lit("block-"), F.floor(F.col("doc_id") / 100).cast("string"))
    blocks = I.lines(spark, sf_dir).groupBy(block.alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "value")))["value"].alias("values")
    )
    lists = stage(blocks, "blocks")
    root = fresh_path(spark, "tree")
    manifest = F.struct(F.col("dataset_id").alias("search_query"), F.col("n").alias("reported_count"))
    texts = {"manifest.json": F.to_json(manifest, {"pretty": "true"}), "ids.txt": F.concat(F.array_join("values", "\n"), F.lit("\n"))}
    put_files(
        _union([lists.select(F.concat("dataset_id", F.lit(f"/latest/{name}")).alias("place"), text.alias("text")) for name, text in texts.items()]),
        root,
    )
    manifests, ids = tree.load_tree(spark, root, "search_query string, reported_count bigint")
    placed = dense_position(ids, ["dataset_id"], ["ord"]).select("dataset_id", "id", "position")
    return placed.join(manifests.drop("snapshot"), "dataset_id")


@_query("json_field")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events").select(
        "event_id",
        json_field("props", "$.k", "bigint").alias("k"),
        json_field("props", "$.missing").alias("missing"),
    )


# The store


def make_store(spark: SparkSession, sf_dir: str) -> str:
    """A store with two commits, of its own for each query: all documents, then a second version under an earlier stamp."""
    root = fresh_path(spark, "store")
    commit_snapshots(spark, root, I.searches(spark, sf_dir, LATE), I.noisy_lines(spark, sf_dir), "value")
    commit_snapshots(spark, root, I.searches(spark, sf_dir, EARLY), I.second_lines(spark, sf_dir), "value")
    return root


@_query("load_snapshot")
def load_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = make_store(spark, sf_dir)
    first = store.manifests(spark, root).where("commit_seq = 1")
    return store.load_snapshots(spark, root, first)[1]


@_query("load_latest")
def load_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.load_latest(spark, make_store(spark, sf_dir))[1]


@_query("snapshot_report")
def snapshot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = make_store(spark, sf_dir)
    first = store.manifests(spark, root).where("commit_seq = 1")
    return C.snapshot_report(*store.load_snapshots(spark, root, first))


@_query("store_catalog")
def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By SQL over the registered view."""
    store.register_views(spark, make_store(spark, sf_dir))
    return spark.sql(
        "SELECT dataset_id, snapshot, commit_seq, complete, is_latest, normalized_count FROM snapshot_catalog"
    )


@_query("store_identifiers")
def store_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By SQL over the other registered view."""
    store.register_views(spark, make_store(spark, sf_dir))
    return spark.sql("SELECT dataset_id, snapshot, count(*) AS n, min(id) AS first_id FROM identifiers GROUP BY 1, 2")


@_query("snapshot_paths")
def snapshot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests that come with loaded identifiers, and where everything lies."""
    root = make_store(spark, sf_dir)
    found = store.load_latest(spark, root)[0]
    below = {c: F.replace(c, F.lit(f"{root}/"), F.lit("")).alias(c) for c in ("snapshot_directory", "manifest_path", "ids_path")}
    return found.select("dataset_id", "snapshot", "raw_count", "normalized_count", *below.values())


@_query("store_collisions")
def store_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the store holds already, of a batch in which every other search has a new stamp."""
    root = make_store(spark, sf_dir)
    stamp = F.when(F.col("reported_count") % 2 == 0, F.lit(LATE)).otherwise(F.lit("2024-01-03T00:00:00Z"))
    new = M.complete_searches(I.searches(spark, sf_dir, LATE).withColumn("retrieved_at_utc", stamp))
    return C.collisions(new, store.opened(spark, root))


LEAF = 16  # identifiers a leaf, so that lists of the given tables have trees of several levels


def make_versions(spark: SparkSession, sf_dir: str) -> str:
    """A store with two versions of every list and their hash trees."""
    root = fresh_path(spark, "versions")
    commit_snapshots(spark, root, I.searches(spark, sf_dir, EARLY), I.noisy_lines(spark, sf_dir), "value")
    commit_snapshots(spark, root, I.searches(spark, sf_dir, LATE), I.changed_lines(spark, sf_dir), "value")
    for number in (1, 2):
        index_commit(spark, root, number, leaf_rows=LEAF)
    return root


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    begun = store.opened(spark, root)
    before, after = (begun.where(F.col("commit_seq") == n).select("dataset_id", F.col("snapshot").alias(side)) for n, side in ((1, "before"), (2, "after")))
    return before.join(after, "dataset_id")


@_query("snapshot_diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came and went between two versions of every list."""
    root = make_versions(spark, sf_dir)
    return diff(spark, root, _pairs(spark, root)).select("dataset_id", "id", "change")


@_query("snapshot_diff_counts")
def snapshot_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = make_versions(spark, sf_dir)
    return diff_counts(spark, root, _pairs(spark, root)).drop("before", "after")


def damaged_copy(spark: SparkSession, root: str) -> str:
    """A copy of a store in which the second commit is damaged, by the last character of each list's name.

    Lists are lost as a whole, lack identifiers, hold changed ones, or have a wrong count.
    """
    copy = fresh_path(spark, "damaged")
    kind = F.when(F.col("commit_seq") == 2, F.ascii(F.substring("dataset_id", -1, 1)) % 5).otherwise(0)
    some = F.length("id") % 7 == 3
    ids = spark.read.schema(store.IDS_SCHEMA).parquet(store.ids_path(root))
    left = ids.where((kind != 1) & ~((kind == 2) & some))
    left = left.withColumn("id", F.when((kind == 3) & some, F.concat("id", F.lit("~"))).otherwise(F.col("id")))
    left.write.option("compression", PACKED).partitionBy("commit_seq", "shard").parquet(store.ids_path(copy))
    store.opened(spark, root).write.partitionBy("commit_seq").parquet(store.opened_path(copy))
    nodes(spark, root).write.partitionBy("commit_seq", "at").parquet(nodes_path(copy))
    wrong = store.manifests(spark, root).withColumn(
        "normalized_count", F.col("normalized_count") + F.when(kind == 4, 1).otherwise(0)
    )
    for number in (1, 2):
        write_json(wrong.where(F.col("commit_seq") == number).drop("commit_seq"), f"{store.manifests_path(copy)}/commit_seq={number}")
    return copy


@_query("verify_snapshots")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which snapshots of a damaged store are still what they were, and where the others depart."""
    return verify_snapshots(spark, damaged_copy(spark, make_versions(spark, sf_dir)))


def make_history(spark: SparkSession, sf_dir: str) -> str:
    """A store of many commits, summarized twice on the way and not after the last ones."""
    root = fresh_path(spark, "history")
    begun = stage(I.history(spark, sf_dir), "history")
    for low, high in ((0, 4), (4, 8), (8, 1 << 40)):
        some = begun.where((F.col("commit_seq") > low) & (F.col("commit_seq") <= high))
        # names are dealt by range, since commits are few and grow with the table; lists are made where their names are
        dealt = some.repartitionByRange(*store.PLACE, *C.KEY)
        numbered = dealt.select(*C.KEY, "shard", "commit_seq")
        numbered.write.mode("append").partitionBy("commit_seq").parquet(store.opened_path(root))
        held = dealt.where(~F.col("shard").isin("empty", "lost"))
        rows = held.withColumn("ord", F.explode(F.sequence(F.lit(1).cast("bigint"), "normalized_count")))
        rows = rows.select(*C.KEY, "ord", F.col("ord").cast("string").alias("id"), *store.PLACE)
        rows.write.mode("append").partitionBy(*store.PLACE).parquet(store.ids_path(root))
        kept = dealt.where("has_manifest").select(*C.KEY, "normalized_count", "update_latest", "commit_seq")
        kept.write.mode("append").partitionBy("commit_seq").json(store.manifests_path(root))
        if high <= 8:
            summary.summarize(spark, root, slice_rows=1000)
    return root


@_query("catalog_increments")
def catalog_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot of a store, from its summary and the commits that the summary does not hold."""
    return summary.snapshot_catalog(spark, make_history(spark, sf_dir)).select(
        "dataset_id", "snapshot", "commit_seq", "has_ids", "has_manifest", "complete", "is_latest"
    )


@_query("resolve_increments")
def resolve_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request of every customer comes to in that store."""
    asked = I.requests(spark, sf_dir)
    return C.resolve_requests(asked, summary.latest_state(spark, make_history(spark, sf_dir), asked))


def _activated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Create snapshots of all ten lists from landed pages, then ask again and reuse them."""
    root = fresh_path(spark, "store")
    searches = I.page_searches(spark, sf_dir)
    searches = searches.withColumns(
        {
            "search_query": F.col("dataset_id"),
            "retrieved_at_utc": F.lit(EARLY),
            "history_web_env": F.lit("w"),
            "history_query_key": F.lit("1"),
        }
    )
    number = F.substring("dataset_id", 2, 1).cast("int")
    asked = searches.select(
        "dataset_id",
        F.lit(R.REUSE_LATEST_OR_CREATE).alias("mode"),
        F.lit("a@example.org").alias("email"),
        "search_query",
        F.when(number % 2 == 0, 50 + number).alias("page_size"),
        F.when(number % 3 == 0, 2 + number).alias("max_retry_attempts"),
        F.when(number < 3, number / 2).cast("double").alias("request_delay_seconds"),
        F.when(number > 6, "k").alias("api_key"),
    )
    activate(spark, root, asked.fillna(R.DEFAULT_PAGE_SIZE, ["page_size"]).fillna(R.DEFAULT_MAX_ATTEMPTS, ["max_retry_attempts"]),
             searches, I.result_pages(spark, sf_dir, faults=False))
    again = asked.select("dataset_id", F.lit(R.REUSE_LATEST).alias("mode"), F.lit("").alias("email"))
    return activate(spark, root, again)


@_query("activate_requests")
def activate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activated(spark, sf_dir)[1]


@_query("activate_manifests")
def activate_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the requests asked for, as their manifests have it."""
    return _activated(spark, sf_dir)[0].select(
        "dataset_id", "snapshot", "search_query", "reported_count", "raw_count", "normalized_count",
        "page_size", "max_retry_attempts", "request_delay_seconds", "ids_sha256",
    )
