"""SHA-256 of lists of any size, a bounded run at a time.

SHA-256 is sequential, so a long list cannot be hashed in parallel; it can be
hashed in rounds. The list is range-sorted into bounded runs. Round k feeds the
k-th run of every dataset, each from the saved state of its round k-1, and stages
the new states. A task sees one run per dataset, and a lost executor costs at most
the current round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.lookup import BROADCAST_ROWS
from muster.shared import fresh_path, stage

RUN_BYTES = 1 << 30


def _feeder(separator: bytes, resumable: bool):
    """The per-partition step. Self-contained, so executors need not have this package.

    Values come with ``separator`` in front, so a run of rows is one slice of an Arrow buffer
    and no row becomes a Python object. Without ``resumable`` the digest is ``hashlib``'s; with
    it, the state between rounds is that of the OpenSSL functions beneath, and a worker first
    shows on a known text that it can save and resume such a state.
    """

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        class Plain:
            state = None

            def __init__(self) -> None:
                self.digest = hashlib.sha256()
                self.update = self.digest.update

            def hex(self) -> str:
                return self.digest.hexdigest()

        def saved_states():
            import ctypes

            import _hashlib

            try:
                crypto = ctypes.CDLL(_hashlib.__file__)
                update, final, init = crypto.SHA256_Update, crypto.SHA256_Final, crypto.SHA256_Init
            except (AttributeError, OSError) as error:
                raise RuntimeError("this Python's OpenSSL gives no access to the state of a SHA-256") from error
            size = 112  # sizeof(SHA256_CTX): 8 + 2 + 16 words, 2 ints

            class Saved:
                def __init__(self, state: bytes | None = None) -> None:
                    self.context = ctypes.create_string_buffer(size)
                    if state is None:
                        init(self.context)
                    else:
                        ctypes.memmove(self.context, state, size)

                def update(self, data) -> None:
                    view = memoryview(data)
                    if len(view):
                        held = np.frombuffer(view, dtype=np.uint8)
                        update(self.context, ctypes.c_void_p(held.ctypes.data), ctypes.c_size_t(len(held)))

                @property
                def state(self) -> bytes:
                    return self.context.raw

                def hex(self) -> str:
                    digest = ctypes.create_string_buffer(32)
                    final(digest, ctypes.create_string_buffer(self.context.raw, size))
                    return digest.raw.hex()

            text = bytes(range(256)) * 3
            first = Saved()
            first.update(text[:333])
            again = Saved(first.state)
            again.update(text[333:])
            if len(first.state) != size or again.hex() != hashlib.sha256(text).hexdigest():
                raise RuntimeError("the state of a SHA-256 cannot be saved and resumed on this machine")
            return Saved

        new = saved_states() if resumable else Plain
        schema = pa.schema([("dataset_id", pa.string()), ("state", pa.binary()), ("sha256", pa.string())])
        current, digest, started = None, None, False

        def finished() -> pa.RecordBatch:
            columns = [pa.array([v], t) for v, t in zip((current, digest.state, digest.hex()), schema.types)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            names, values, states = batch.columns
            if not len(names):
                continue
            ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
            data = memoryview(values.buffers()[2] or b"")
            changes = pc.indices_nonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)))
            starts = [0, *(i + 1 for i in changes.to_pylist())]
            for start, stop in zip(starts, [*starts[1:], len(names)]):
                name, state = names[start].as_py(), states[start].as_py()
                if digest is None or name != current:
                    if digest is not None:
                        yield finished()
                    current, started, digest = name, False, new()
                if state is not None:
                    digest, started = new(state), True
                    start += 1
                if start < stop:
                    skip = 0 if started else len(separator)
                    digest.update(data[int(ends[start]) + skip : int(ends[stop])])
                    started = True
        if digest is not None:
            yield finished()

    return feed


_STATE_SCHEMA = "dataset_id string, state binary, sha256 string"


def _hashed(rows: DataFrame, order: Sequence[str], separator: bytes, *, resumable: bool) -> DataFrame:
    """Feed ``rows(dataset_id, kind, order…, value, state)``; a saved state has the lower ``kind``."""
    return (
        rows.repartition("dataset_id")
        .sortWithinPartitions("dataset_id", "kind", *order)
        .select("dataset_id", F.concat(F.lit(separator), F.col("value")).alias("value"), "state")
        .mapInArrow(_feeder(separator, resumable), _STATE_SCHEMA)
    )


def _values(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    return rows.select(
        "dataset_id", F.lit(1).alias("kind"), *order, "value", F.lit(None).cast("binary").alias("state")
    )


def one_run_digest(rows: DataFrame, order: Sequence[str], *, separator: bytes = b"\n") -> DataFrame:
    """``(dataset_id, sha256)`` like ``chained_digest``, of lists known to be short enough for one run."""
    return _hashed(_values(rows, order), order, separator, resumable=False).select("dataset_id", "sha256")


def chained_digest(
    rows: DataFrame,
    order: Sequence[str],
    *,
    n_bytes: int,
    separator: bytes = b"\n",
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """``(dataset_id, sha256)`` of the binary column ``value`` joined in ``order``.

    ``rows`` holds ``dataset_id``, ``value`` and the order columns, whose values
    must be unique within a dataset; ``n_bytes`` is about what all values weigh.
    """
    spark = rows.sparkSession
    n_parts = max(1, math.ceil(n_bytes / run_bytes))
    ranged = rows.select("dataset_id", *order, "value").repartitionByRange(n_parts, "dataset_id", *order)
    # A directory per range partition, so that a round opens the files of its runs only.
    runs = stage(ranged.withColumn("part", F.spark_partition_id()), "runs", partition_by="part")
    by_part = Window.partitionBy("dataset_id").orderBy("part")
    turns = stage(
        runs.groupBy("dataset_id", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("dataset_id", "part", (F.row_number().over(by_part) - 1).alias("turn"))
        .withColumn("last", F.max("turn").over(Window.partitionBy("dataset_id"))),
        "turns",
    )
    # One row per round, and no more rounds than range partitions.
    datasets_in = dict(turns.groupBy("turn").count().collect())

    folder = fresh_path(spark, "states")
    nothing = F.lit(None).cast("binary")
    no_place = [F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in order]
    for turn in range(len(datasets_in)):
        current = turns.where(F.col("turn") == turn)
        if datasets_in[turn] <= BROADCAST_ROWS:
            current = F.broadcast(current)
        fed = _values(runs.join(current.select("dataset_id", "part"), ["dataset_id", "part"]), order)
        if turn:
            before = spark.read.schema(_STATE_SCHEMA).parquet(f"{folder}/turn={turn - 1}")
            resumed = before.join(current.select("dataset_id"), "dataset_id", "left_semi")
            fed = fed.unionByName(
                resumed.select("dataset_id", F.lit(0).alias("kind"), *no_place, nothing.alias("value"), "state")
            )
        _hashed(fed, order, separator, resumable=True).write.parquet(f"{folder}/turn={turn}")
    ends = turns.where(F.col("turn") == F.col("last")).select("dataset_id", "turn")
    states = spark.read.schema(f"{_STATE_SCHEMA}, turn int").parquet(folder)
    return states.join(ends, ["dataset_id", "turn"]).select("dataset_id", "sha256")
