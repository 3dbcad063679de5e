"""Rows as JSON documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from muster.shared import replace_path


def write_json(rows: DataFrame, path: str, *, sort_keys: bool = True, mode: str = "overwrite") -> str:
    """One document per line, keys in order, nulls written, text not escaped to ASCII.

    ``overwrite`` writes beside ``path`` and takes its place when all documents are there,
    so a job that fails leaves the old ones.
    """
    columns = sorted(rows.columns) if sort_keys else rows.columns
    target = f"{path}.{uuid.uuid4().hex}" if mode == "overwrite" else path
    rows.select(*columns).write.mode("errorifexists" if mode == "overwrite" else mode).option(
        "ignoreNullFields", False
    ).json(target)
    if mode == "overwrite":
        replace_path(rows.sparkSession, target, path)
    return path
