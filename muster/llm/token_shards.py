"""Token ids in files of separately compressed documents with a shared dictionary.

A zstandard dictionary is trained on serialized id arrays of a bounded sample of
documents. Every document is a frame of its own, so a short one is read alone: by the
offset index at the end of its file and the dictionary, whose hash the file names.

File: MAGIC, dictionary SHA-256, bytes per id; frames; then the index (doc ids, which of
them are not null, frame offsets, token counts), its place and the number of documents.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import batches, input_partitions, stage, stage_small
from muster.llm.pretokens import PieceTable, vocabulary
from muster.shared import fresh_path

MAGIC = b"TOKSHRD1"
HEAD = struct.Struct("<8s32sI")
TAIL = struct.Struct("<QQ8s")
END_ID = 0
LEVEL = 3
ROWS = 4096  # documents whose frames are held at a time
SAMPLE_DOCUMENTS = 400  # documents the dictionary is trained on
SAMPLE_BYTES = 32 << 10  # at most, of each of them
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 64 << 20  # compressed bytes a file is meant to have


@lru_cache(maxsize=2)
def library_encoder(path: str) -> PieceTable:
    """The tokenizers library behind the piece table of this Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return PieceTable(vocabulary(path), lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


def id_bytes(path: str) -> int:
    return 2 if vocabulary(path).size <= 1 << 16 else 4


def train_dictionary(rows: DataFrame, key: str, text: str, path: str) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES from the id arrays of SAMPLE_DOCUMENTS documents.

    The documents are those whose keys hash lowest, so the choice needs no text and is the
    same in every run; of each, the first SAMPLE_BYTES are used. This bounds the model only:
    every document is stored whole. Too small a sample gives the sample itself as content.
    """
    chosen = [r[0] for r in rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(SAMPLE_DOCUMENTS).collect()]
    if not chosen:
        return b""
    width = id_bytes(path)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            ids = [_narrow(i, width)[:SAMPLE_BYTES] for i in library_encoder(path).encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    some = rows.where(F.col(key).isin(chosen)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    sample = some.mapInArrow(run, f"key {dict(rows.dtypes)[key]}, ids binary").orderBy("key", "ids").limit(SAMPLE_DOCUMENTS).collect()
    samples = [bytes(r.ids) for r in sample if r.ids]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _narrow(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u4" if width == 4 else "<u2").tobytes()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def compress_documents(rows: DataFrame, key: str, text: str, path: str, dictionary: bytes) -> DataFrame:
    """``(key, n_tokens, frame)``: the ids of each whole text and END_ID, one zstandard frame."""
    width = id_bytes(path)
    end = END_ID.to_bytes(width, "little")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        for batch in batches(source, ROWS):
            counts, frames = [], []
            for ids in library_encoder(path).encode(batch.column(1)):
                counts.append(len(ids) + 1)
                frames.append(compressor.compress(_narrow(ids, width) + end))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["key", "n_tokens", "frame"]
            )

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens bigint, frame binary"
    )


class ShardWriter:
    def __init__(self, folder: str, part: int, dictionary: bytes, width: int) -> None:
        self.store, at = fs.FileSystem.from_uri(folder)
        self.store.create_dir(at, recursive=True)
        # the name is new for every attempt of a task: a lost one leaves a file no list names
        self.name = f"shard-{part:06d}-{uuid.uuid4().hex}.tok"
        self.out = self.store.open_output_stream(f"{at}/{self.name}")
        self.out.write(HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))
        self.offsets, self.keys, self.counts = [HEAD.size], [], []

    def add(self, key: int | None, count: int, frame: bytes) -> None:
        self.out.write(frame)
        self.keys.append(key)
        self.counts.append(count)
        self.offsets.append(self.offsets[-1] + len(frame))

    def close(self) -> tuple[str, int, int]:
        index = io.BytesIO()
        index.write(np.array([k or 0 for k in self.keys], dtype="<i8").tobytes())
        index.write(np.array([k is not None for k in self.keys], dtype=np.uint8).tobytes())
        index.write(np.array(self.offsets, dtype="<u8").tobytes())
        index.write(np.array(self.counts, dtype="<u8").tobytes())
        self.out.write(index.getvalue())
        self.out.write(TAIL.pack(self.offsets[-1], len(self.keys), MAGIC))
        self.out.close()
        return self.name, len(self.keys), sum(self.counts)


class ShardReader:
    """Reads a shard file: the index at once, documents one by one."""

    def __init__(self, folder: str, name: str, dictionary: bytes) -> None:
        store, at = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{at}/{name}")
        size = self.file.size()
        magic, digest, self.width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        where, self.count, end = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{name} is no complete shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        index, n = self.file.read_at(size - TAIL.size - where, where), self.count
        self.keys = np.frombuffer(index, "<i8", n, 0)
        self.has_key = np.frombuffer(index, np.uint8, n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", n, 9 * n + 8 * (n + 1)).astype(np.int64)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, position: int) -> np.ndarray:
        """The ids of one document, by one read of its frame."""
        start, end = self.offsets[position : position + 2].tolist()
        return self._unpacked(self.file.read_at(end - start, start), position)

    def _unpacked(self, frame: bytes, position: int) -> np.ndarray:
        data = self.decompressor.decompress(frame, max_output_size=int(self.counts[position]) * self.width)
        ids = np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")
        if len(ids) != self.counts[position]:
            raise ValueError("a frame's length is not that of the index")
        return ids

    def key(self, position: int) -> int | None:
        return int(self.keys[position]) if self.has_key[position] else None


def write_shards(rows: DataFrame, key: str, text: str, path: str, folder: str | None = None) -> tuple[DataFrame, str, bytes]:
    """Encode all texts and write them as shard files in ascending ``key``.

    Returns the list of files ``(shard, name, n_docs, n_tokens, start)``, their folder (in
    the shared one unless given) and the dictionary. Texts are compressed before the range
    shuffle, so what moves is the frames. Keys are bigints; null comes first, equal keys by
    length and frame. Null and empty texts are END_ID alone. No rows give no files.
    """
    spark = rows.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    dictionary = train_dictionary(rows, key, text, path)
    width = id_bytes(path)
    frames = stage_small(compress_documents(rows, key, text, path, dictionary), "token-frames")
    total = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(1, min(input_partitions(frames), 8), -(-total // SHARD_BYTES))
    ranged = frames.repartitionByRange(parts, "key", "n_tokens", "frame").sortWithinPartitions("key", "n_tokens", "frame")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        for batch in source:
            for k, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or ShardWriter(folder, part, dictionary, width)
                writer.add(k, n, frame)
        if writer:
            name, n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": part, "name": name, "n_docs": n_docs, "n_tokens": n_tokens}],
                schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    files = stage(ranged.mapInArrow(run, "shard int, name string, n_docs bigint, n_tokens bigint"), "token-files")
    # one row a file of SHARD_BYTES: the only thing numbered in one task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))
    return stage(placed, "token-index"), folder, dictionary


def read_shards(files: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files, one task a file."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = ShardReader(folder, name, dictionary)
                starts = start + np.cumsum(shard.counts) - shard.counts
                for first in range(0, shard.count, 1024):
                    some = range(first, min(shard.count, first + 1024))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard.key(i) for i in some], pa.int64()),
                            pa.array(starts[first : some.stop]),
                            pa.array(shard.counts[first : some.stop]),
                            pa.array([zlib.crc32(shard.ids(i).tobytes()) for i in some], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    listed = files.select("name", "start").repartition(max(1, files.count()), "name")
    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
