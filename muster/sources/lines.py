"""Text files as tables of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from muster.functions.text import LINE_SAFE_CHARSETS, charset, strip
from muster.operators.lookup import spread_lookup
from muster.shared import stage
from muster.sources.files import head_of, list_files, open_path, read_each

# Spark's reader drops a UTF-8 byte order mark at the start of a file; Python keeps it.
MARK = b"\xef\xbb\xbf"
_COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
_ROW_BITS = 33  # how monotonically_increasing_id counts rows inside a partition


def file_name(column: str | Column = "_metadata.file_path") -> Column:
    """The full name of a file, in the one form of several that local files have."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def part_number(file: str | Column = "file") -> Column:
    """The number in the name of a part file: beyond 99,999 it no longer sorts as text."""
    return F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("bigint")


def _size_in_bytes(spark: SparkSession, key: str) -> int:
    text = spark.conf.get(key).lower().removesuffix("b")
    for unit, shift in (("k", 10), ("m", 20), ("g", 30), ("t", 40)):
        if text.endswith(unit):
            return int(text[:-1]) << shift
    return int(text)


def line_order(spark: SparkSession) -> Column:
    """A bigint that grows with the lines of one file, whichever task reads them.

    A split is never shorter than the smaller of two settings (but for the last of a
    file), so dividing its start by that tells splits apart in file order; the
    running row number orders the lines inside a split. No shuffle is needed.
    """
    granule = min(
        _size_in_bytes(spark, "spark.sql.files.maxPartitionBytes"),
        max(1, _size_in_bytes(spark, "spark.sql.files.openCostInBytes")),
    )
    split = F.floor(F.col("_metadata.file_block_start") / granule).cast("bigint")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    too_long = F.raise_error(F.lit("file too long for the size of its splits")).cast("bigint")
    return F.when(split < (1 << 63 - _ROW_BITS), split).otherwise(too_long) * F.lit(1 << _ROW_BITS) + row


def _declared(reader: DataFrameReader, fixed: str, partitions: str | None) -> DataFrameReader:
    return reader.schema(f"{fixed}, {partitions}") if partitions else reader


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    *,
    encoding: str = "utf-8",
    strip_lines: bool = True,
    skip_empty_lines: bool = True,
    strict: bool = True,
    keep_mark: bool = True,
    partitions: str | None = None,
    where: str | Column | None = None,
    **options: str,
) -> DataFrame:
    """``(file, ord, value)``, plus any partition columns, from text files under ``path``.

    ``partitions`` declares the partition columns, such as ``dataset_id string`` for
    what the text sink writes; if it is not given, Spark guesses, and ``007`` is 7.

    Lines end at LF, CR or CRLF only. With ``strict``, bytes that are not valid in
    the encoding raise; without it they are kept (see ``invalid_lines``).

    ``where`` filters by partition columns, such as ``dataset_id = 'b'``, before lines are
    numbered, so that only the directories it selects are read. A filter on the result
    comes after the numbering and prunes nothing.

    A byte order mark stays in the first line of a file, as it does in Python. To find the
    files that have one, the first three bytes of each are read, or, where Arrow cannot
    open the path, the whole text; ``keep_mark=False`` saves that where there is none to
    keep. In compressed files the mark is dropped.
    """
    encoding = charset(encoding)
    if encoding in LINE_SAFE_CHARSETS:
        source = _declared(spark.read, "value string", partitions).options(**options).text(path)
        source = source if where is None else source.where(where)
        extra = [c for c in source.columns if c != "value"]
        lines = source.select(
            *extra, file_name().alias("file"), line_order(spark).alias("ord"), "value"
        )
        if keep_mark:
            lines = _with_marks(lines, marked_files(spark, path, **options))
        if encoding != "utf-8":
            lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
        elif strict:
            lines = lines.withColumn("value", F.validate_utf8("value"))
    else:
        # Line ends are not single bytes here, so each file is decoded whole; Spark
        # raises for files of 2 GiB and more.
        fixed = "path string, modificationTime timestamp, length bigint, content binary"
        source = _declared(spark.read, fixed, partitions).format("binaryFile").options(**options).load(path)
        source = source if where is None else source.where(where)
        extra = source.columns[4:]
        text = F.decode("content", encoding)
        # A line end closes a line; it does not open an empty one after it.
        closed = F.regexp_replace(text, r"(\r\n|\r|\n)\z", "")
        parts = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(closed, r"\r\n|\r|\n", -1))
        lines = source.select(
            *extra, file_name().alias("file"), F.posexplode(parts).alias("ord", "value")
        ).withColumn("ord", F.col("ord").cast("bigint"))
    if strip_lines:
        lines = lines.withColumn("value", strip(F.col("value")))
    if skip_empty_lines:
        lines = lines.where(F.col("value") != "")
    return lines


def marked_files(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """``(file)``: the uncompressed files that begin with a byte order mark."""
    paths = [path] if isinstance(path, str) else list(path)
    if opens(paths):
        heads = read_each(list_files(spark, paths, pattern=options.get("pathGlobFilter", "*")), head_of, "head", "binary")
        marked = heads.where((F.col("head") == F.lit(MARK)) & ~F.col("path").rlike(_COMPRESSED))
        return marked.select(F.col("path").alias("file"))
    # Such a file is 3 bytes longer than what the reader returns.
    source = spark.read.options(**options).text(path, lineSep="\n")
    read = source.groupBy(file_name().alias("file"), F.col("_metadata.file_size").alias("size")).agg(
        F.sum(F.octet_length("value") + F.lit(1)).alias("bytes")
    )
    # Every line but the last surely ends in LF, so one byte is in doubt.
    return read.where((F.col("size") - F.col("bytes")).between(2, 3) & ~F.col("file").rlike(_COMPRESSED)).select("file")


def opens(paths: list[str]) -> bool:
    """Whether Arrow can list these paths: it knows their scheme, and they hold no wildcards."""
    try:
        return not any(set("*?[{") & set(p) for p in paths) and all(open_path(p) for p in paths)
    except (OSError, ValueError):
        return False


def _plain_name(file: str) -> Column:
    """A file's name without percent encoding."""
    return F.url_decode(F.replace(file_name(file), F.lit("+"), F.lit("%2B")))


def _with_marks(lines: DataFrame, marked: DataFrame) -> DataFrame:
    marked = stage(marked, "marked")
    if marked.isEmpty():
        return lines
    marked = marked.select(file_name("file").alias("_name"))
    named = lines.select("file", "ord", _plain_name("file").alias("_name"))
    in_marked = spread_lookup(named, marked, ["_name"], ["ord"])
    first = stage(in_marked.groupBy("file").agg(F.min("ord").alias("ord")).withColumn("_mark", F.lit(True)), "first")
    whole = F.concat(F.lit(MARK), F.col("value").cast("binary")).cast("string")
    found = spread_lookup(lines, first, ["file", "ord"], ["ord"], how="left")
    return found.withColumn("value", F.when(F.col("_mark"), whole).otherwise(F.col("value"))).select(*lines.columns)


def as_lists(lines: DataFrame, dataset: str = "file") -> DataFrame:
    """``(dataset_id, ord, value)`` with one list per file, or per value of another column."""
    return lines.select(F.col(dataset).cast("string").alias("dataset_id"), "ord", "value")


def invalid_lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """The lines under ``path`` that are not valid UTF-8, as bytes."""
    lines = read_lines(spark, path, strip_lines=False, skip_empty_lines=False, strict=False, **options)
    return lines.where(~F.is_valid_utf8("value")).withColumn("value", F.col("value").cast("binary"))
