"""Stamps, snapshot names and layout paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout of a snapshot directory and its name.
FORMAT_VERSION = "1.0"
MANIFEST_FILE = "manifest.json"
IDS_FILE = "ids.txt"
SNAPSHOTS_DIR = "snapshots"
LATEST_DIR = "latest"
IDS_TABLE = "ids"
MANIFESTS_TABLE = "manifests"
NAME_SEPARATOR = "__q_"
QUERY_HASH_LENGTH = 12
# Fixed value: the characters Spark escapes in the names of partition directories.
_ESCAPED = r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""


def stamp_ntz(column: Column) -> Column:
    """``yyyy-MM-ddTHH:MM:SSZ`` from a zone-free timestamp, cut to the second."""
    text = F.substring(column.cast("string"), 1, 19)
    return F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))


def stamp_instant(column: Column) -> Column:
    """The same stamp from an instant, in UTC whatever the session time zone is."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    zero = F.lit(0)
    return stamp_ntz(epoch + F.make_dt_interval(zero, zero, zero, F.unix_seconds(column)))


def path_stamp(stamp: Column) -> Column:
    return F.replace(stamp, F.lit(":"), F.lit("-"))


def query_hash(query: Column, length: int = QUERY_HASH_LENGTH) -> Column:
    """The first ``length`` hex characters of the SHA-256 of the query as given."""
    if length <= 0:
        raise ValueError("length must be positive")
    return F.substring(F.sha2(query, 256), 1, length)


def snapshot_name(stamp: Column, query: Column) -> Column:
    """A directory name that sorts by time and tells queries apart."""
    return F.concat(path_stamp(stamp), F.lit(NAME_SEPARATOR), query_hash(query))


def snapshot_dir(root: Column, snapshot: Column) -> Column:
    return F.concat_ws("/", root, F.lit(SNAPSHOTS_DIR), snapshot)


def latest_dir(root: Column) -> Column:
    return F.concat_ws("/", root, F.lit(LATEST_DIR))


def partition_value(column: Column) -> Column:
    """A value as Spark writes it into the name of a partition directory."""
    escaped = F.transform(
        F.split(column, ""),
        lambda c: F.when(c.rlike(_ESCAPED), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c),
    )
    return F.array_join(escaped, "")


def stored_path(commit_seq: Column, shard: Column) -> Column:
    """Where the identifiers of a snapshot lie below the root of a store."""
    return F.concat(
        F.lit(f"{IDS_TABLE}/commit_seq="), commit_seq.cast("string"), F.lit("/shard="), partition_value(shard)
    )


def stored_manifest_path(commit_seq: Column) -> Column:
    """Where the manifests of a commit lie below the root of a store."""
    return F.concat(F.lit(f"{MANIFESTS_TABLE}/commit_seq="), commit_seq.cast("string"))


def manifest_path(directory: Column, file_name: str = MANIFEST_FILE) -> Column:
    return F.concat_ws("/", directory, F.lit(file_name))


def ids_path(directory: Column, file_name: str = IDS_FILE) -> Column:
    return F.concat_ws("/", directory, F.lit(file_name))
