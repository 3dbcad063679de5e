"""Identities of identifier lists and of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.text import charset
from muster.operators.chain import RUN_BYTES, chained_digest, one_run_digest
from muster.operators.lookup import spread_lookup
from muster.operators.normalize import list_order, measure, normalize_counted
from muster.shared import stage
from muster.sources.files import list_files, read_each, sha256_of

# A list up to this size is joined in memory; a longer one is hashed in rounds.
FLAT_BYTES = 4 << 20


def _joined_in_order(order: list[str], separator: str) -> Column:
    """One text per group: the identifiers in list order."""
    if order == ["ord"]:
        pairs = F.array_sort(F.collect_list(F.struct("ord", "id")))
        return F.array_join(F.transform(pairs, lambda pair: pair["id"]), separator)
    return F.array_join(F.array_sort(F.collect_list("id")), separator)


def list_digest(
    ids: DataFrame,
    sizes: DataFrame,
    *,
    canonical_sort: bool,
    separator: str = "\n",
    encoding: str = "utf-8",
    flat_bytes: int = FLAT_BYTES,
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """``(dataset_id, ids_sha256)`` of normalised lists that are not empty.

    SHA-256 over the identifiers in list order with ``separator`` between them and
    none at the end. ``ids`` and ``sizes(dataset_id, n_bytes)`` are staged by the
    caller. Lists of at most ``flat_bytes`` become one value, and lists of at most
    ``run_bytes`` one sorted run; the others go through ``chained_digest``.
    """
    encoding = charset(encoding)
    if encoding in ("utf-16", "utf-32"):
        raise ValueError(f"{encoding} has no fixed byte order; name one with it")
    order = list_order(canonical_sort)
    bound = max(flat_bytes, run_bytes)
    size = F.col("n_bytes")
    totals = sizes.agg(
        F.sum(F.when(size > flat_bytes, size)).alias("beyond_flat"),
        F.sum(F.when(size > bound, size)).alias("beyond_run"),
    ).first()
    text = F.encode(_joined_in_order(order, separator), encoding)

    def flat(rows: DataFrame) -> DataFrame:
        return rows.groupBy("dataset_id").agg(F.sha2(text, 256).alias("ids_sha256"))

    if not totals.beyond_flat:
        return flat(ids)
    sized = spread_lookup(ids, sizes.select("dataset_id", "n_bytes"), ["dataset_id"], ["id", "ord"])
    binary = sized.withColumn("value", F.encode("id", encoding))
    gap = separator.encode(encoding)
    parts = [one_run_digest(binary.where((size > flat_bytes) & (size <= bound)), order, separator=gap)]
    if totals.beyond_run:
        longest = binary.where(size > bound)
        parts.append(
            chained_digest(longest, order, n_bytes=totals.beyond_run, separator=gap, run_bytes=run_bytes)
        )
    digests = flat(sized.where(size <= flat_bytes))
    for part in parts:
        digests = digests.unionByName(part.withColumnRenamed("sha256", "ids_sha256"))
    return digests


def digest_of_lines(
    lines: DataFrame,
    value: str = "value",
    *,
    dedup: bool = True,
    canonical_sort: bool = False,
    separator: str = "\n",
    encoding: str = "utf-8",
    flat_bytes: int = FLAT_BYTES,
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """``(dataset_id, ids_sha256)`` of raw lists under a normalisation policy.

    A dataset whose lines are all blank has the digest of the empty text. The
    policy is part of the identity: the same list has another digest under another.
    """
    counted = stage(normalize_counted(lines, value, dedup=dedup), "normalized")
    sizes = stage(measure(counted), "sizes")
    digests = list_digest(
        counted.where(F.col("id") != ""),
        sizes,
        canonical_sort=canonical_sort,
        separator=separator,
        encoding=encoding,
        flat_bytes=flat_bytes,
        run_bytes=run_bytes,
    )
    return with_empty_lists(sizes.select("dataset_id"), digests)


def with_empty_lists(datasets: DataFrame, digests: DataFrame, column: str = "ids_sha256") -> DataFrame:
    """Give the datasets without identifiers the digest of the empty text."""
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return datasets.join(digests, "dataset_id", "left").withColumn(column, F.coalesce(column, empty))


def content_digest(column: Column) -> Column:
    """SHA-256 of the bytes of one value."""
    return F.sha2(column.cast("binary"), 256)


def file_digests(spark: SparkSession, path: str | list[str], *, pattern: str = "*") -> DataFrame:
    """``(path, length, sha256)`` of the raw bytes of every file under ``path``.

    Every file is read a block at a time by one task, whatever its size, its extension and
    what its bytes are; SHA-256 of one file is sequential. Empty files are there as well.
    """
    return read_each(list_files(spark, path, pattern=pattern), sha256_of, "sha256", "string")
