"""Lists as text files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.naming import partition_value
from muster.functions.text import LINE_SAFE_CHARSETS, charset, one_line
from muster.operators.normalize import normalize, sort_list
from muster.shared import stage
from muster.sources.files import open_path


def write_lines(
    ids: DataFrame,
    path: str,
    *,
    canonical_sort: bool = False,
    encoding: str = "utf-8",
    line_ending: str = "\n",
    mode: str = "overwrite",
) -> str:
    """Write ``(dataset_id, ord, id)`` as it is, one identifier per line.

    Each dataset becomes a directory ``dataset_id=…`` of part files; taken by the number in
    their names, they hold the list in order. A value with a line break inside raises.
    Files are written beside the old ones and take their place, dataset by dataset, when
    all are there. So a job that fails changes nothing, and other datasets stay.
    """
    encoding = charset(encoding)
    if encoding not in LINE_SAFE_CHARSETS:
        raise ValueError(f"text files are not written in {encoding}")
    value = one_line(F.col("id"))
    if encoding != "utf-8":
        value = F.encode(value, encoding).cast("string")  # the writer copies bytes
    lines = sort_list(ids, canonical_sort=canonical_sort).select("dataset_id", value.alias("value"))
    writer = lines.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dataset_id").option("lineSep", line_ending).text(path)
    return path


def write_empty_lists(datasets: DataFrame, path: str) -> None:
    """Give each of ``datasets(dataset_id)`` a directory with one empty file, in place of what it had."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_path(path)
        for batch in source:
            for name in batch.column(0).to_pylist():
                folder = f"{root}/dataset_id={name}"
                if store.get_file_info(folder).type == fs.FileType.Directory:
                    store.delete_dir(folder)
                store.create_dir(folder, recursive=True)
                store.open_output_stream(f"{folder}/part-00000-empty.txt").close()
            yield batch

    names = datasets.select(partition_value(F.col("dataset_id")).alias("name"))
    names.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def write_normalized_lines(
    lines: DataFrame,
    path: str,
    value: str = "value",
    *,
    dedup: bool = True,
    canonical_sort: bool = False,
    encoding: str = "utf-8",
    line_ending: str = "\n",
) -> str:
    """Normalise, then write; what the datasets had before is replaced.

    A dataset of which nothing is left becomes an empty file.
    """
    ids = stage(normalize(lines, value, dedup=dedup), "normalized")
    write_lines(ids, path, canonical_sort=canonical_sort, encoding=encoding, line_ending=line_ending)
    write_empty_lists(lines.select("dataset_id").distinct().join(ids, "dataset_id", "left_anti"), path)
    return path


# The same sink under the name of what it mostly holds.
write_identifiers = write_normalized_lines

