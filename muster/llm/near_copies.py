"""One of each group of near copies, by min-hashes of word shingles and a check on the texts.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of
``SIMILAR`` or more. Texts that share one of ``BANDS`` keys, each of ``ROWS`` min-hashes, are
candidates: 0.9998 of pairs at a similarity of 0.8 are. Every link is checked on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import batches, stage
from muster.operators.lookup import spread_lookup

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
TRIED = 3  # hubs of a text that it is compared with, those with the most keys in common first
HUB_ROWS = 1000  # texts that are compared with a hub in one task; more are dealt over several

_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """XXH64 of the distinct five-word shingles; a text of fewer words is one shingle."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(" ".join(words))], dtype=np.uint64)
    runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(" ".join, runs)), np.uint64, len(words) - SHINGLE + 1))


def band_keys(values: np.ndarray, kind: int) -> list[int]:
    """The keys of a text of class ``kind``, as bigints."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(values), 4096):
        np.minimum(least, (values[i : i + 4096, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(b.tobytes(), 2 * n + kind) - (1 << 63) for n, b in enumerate(bands)]


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common / (len(one) + len(two) - common)


def _keyed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        kinds, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keys = [band_keys(shingles(t), k) for k, t in zip(kinds, texts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "unit", "_toxic", "keys"]
        )


def _checked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hub, values = None, np.zeros(0, dtype=np.uint64)
    for batch in batches(source):
        near = []
        for number, text, other in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if number != hub:
                hub, values = number, shingles(other)
            near.append(similarity(shingles(text), values) >= SIMILAR)
        yield batch.select(["unit"]).filter(pa.array(near, pa.bool_()))


def distinct_texts(found: DataFrame) -> DataFrame:
    """``(doc_id, unit, _toxic)`` of the rows ``(doc_id, unit, _toxic, text)`` without copies.

    ``unit`` is a hash of class and text; of rows with equal ones the smallest ``doc_id``
    stays. A text that is near one of the same class with a smaller ``unit`` goes, so one
    of each group is left. A text is compared with the smallest unit of each of its keys.
    """
    id_kind = dict(found.dtypes)["doc_id"]
    keyed = found.mapInArrow(_keyed, f"doc_id {id_kind}, unit bigint, _toxic int, keys array<bigint>")
    units = stage(
        keyed.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.first("_toxic").alias("_toxic"), F.first("keys").alias("keys")),
        "labelled-texts",
    )
    keys = units.select("unit", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("unit").alias("hub"), F.max("unit").alias("_most")).where("hub < _most")
    shared = spread_lookup(keys, stage(hubs.select("key", "hub"), "hubs"), ["key"], ["unit"]).where("unit <> hub")
    tried = shared.groupBy("unit", "hub").agg(F.count(F.lit(1)).alias("n")).groupBy("unit").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("n", "hub")), asc=False), 1, TRIED).alias("_best")
    )
    pairs = stage(tried.select("unit", F.explode("_best.hub").alias("hub")), "candidates")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("bigint").alias("parts"))
    parts = stage(parts, "hub-parts")

    needed = pairs.select("unit").union(pairs.select("hub")).distinct().join(units.select("unit", "doc_id"), "unit")
    texts = found.select("doc_id", "unit", "text").join(stage(needed, "compared"), ["doc_id", "unit"])
    texts = texts.groupBy("unit").agg(F.first("text").alias("text"))
    part = F.pmod(F.xxhash64("unit"), F.col("parts")).alias("part")
    left = spread_lookup(pairs, parts, ["hub"], ["unit"]).select("unit", "hub", part).join(texts, "unit")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    right = parts.select("hub", copies).join(
        texts.select(F.col("unit").alias("hub"), F.col("text").alias("other")), "hub"
    )
    both = left.join(right, ["hub", "part"]).select("unit", "hub", "text", "other")
    near = both.mapInArrow(_checked, "unit bigint").distinct()
    return units.select("doc_id", "unit", "_toxic").join(near, "unit", "left_anti")
