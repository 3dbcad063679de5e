"""SimHash near-duplicates found through a table of pivot distances.

Every fingerprint gets its Hamming distances to a fixed set of reference fingerprints
(the pivots) and to zero. By the triangle inequality, two fingerprints within ``RADIUS``
bits differ by at most ``RADIUS`` in every coordinate of the table, which discards pairs
without comparing fingerprints.

To join on the table rather than test all pairs, each pivot differs from zero inside one
byte only (the eight Walsh patterns of that byte). Differing bits then move only the
coordinates of the bytes they lie in. Three bits touch three of the eight bytes at most, so
of five untouched bytes three lie in the same half of the word: in at least one of the
eight triples ``TRIPLES`` two linked fingerprints agree in all coordinates. Joining on the
coordinates of each triple finds every link. Survivors of the maximum test are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import batches, row_hash, stage, word_pieces
from muster.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCK = 2048  # fingerprints of a bucket compared at a time
WALSH = [0b00000000, 0b01010101, 0b00110011, 0b01100110, 0b00001111, 0b01011010, 0b00111100, 0b01101001]
PIVOTS = np.array([w << (8 * byte) for byte in range(8) for w in WALSH], dtype=np.uint64)
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def fingerprint(text: str | None) -> int:
    """The bits set in more than half of the XXH64 values of the word 3-shingles.

    Repeats count. A text of one or two words is one shingle; one without words, or null,
    has fingerprint 0.
    """
    ones = np.zeros(64, dtype=np.int64)
    total = 0
    carry: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for words in word_pieces((text or "").encode("utf-8").lower()):
        words = carry + words
        if len(words) >= SHINGLE:
            values = np.fromiter(
                (digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))),
                dtype="<u8",
                count=len(words) - SHINGLE + 1,
            )
            total += len(values)
            for i in range(0, len(values), 1 << 16):
                bits = np.unpackbits(values[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int32)
            carry = words[1 - SHINGLE :]
        else:
            carry = words
    if total == 0:
        if not carry:
            return 0
        return digest(b" ".join(carry), SEED)
    packed = np.packbits(ones * 2 > total, bitorder="little")
    return int(packed.view("<u8")[0])


def _fingerprints(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])


def fingerprints(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, fp)``: the fingerprint of each whole text as the bits of a bigint."""
    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        _fingerprints, f"id {kind}, fp bigint"
    )


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to each pivot, one row per fingerprint."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _tables(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once per triple, keyed by the triple's coordinates in its table row."""
    for batch in source:
        signed = batch.column("fp").to_numpy(zero_copy_only=False)
        table = pivot_table(signed.view(np.uint64))
        # relative to the distance to zero, a pivot's coordinate depends on its own byte only
        relative = (table - table[:, :1]).reshape(-1, 8, len(WALSH))
        for number, triple in enumerate(TRIPLES):
            coordinates = np.ascontiguousarray(relative[:, triple, :]).reshape(len(signed), -1)
            cell = pa.array([xxhash.xxh64_intdigest(c.tobytes()) - (1 << 63) for c in coordinates], type=pa.int64())
            band = pa.array(np.full(len(signed), number, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([band, cell, batch.column("fp")], names=["band", "cell", "fp"])


def close_pairs(fp_a: np.ndarray, row_a: np.ndarray, fp_b: np.ndarray, row_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(i, j)`` of pairs within RADIUS bits: first the maximum test, then the check.

    The pivot columns are tried one after another, each on the pairs that are left.
    """
    left, right = np.nonzero(np.abs(row_a[:, None, 0] - row_b[None, :, 0]) <= RADIUS)
    for pivot in range(1, row_a.shape[1]):
        if len(left) < 4096:
            break
        near = np.abs(row_a[left, pivot] - row_b[right, pivot]) <= RADIUS
        left, right = left[near], right[near]
    # what few pairs remain take all coordinates at once
    for start in range(0, len(left), 1 << 16):
        part = slice(start, start + (1 << 16))
        worst = np.abs(row_a[left[part]] - row_b[right[part]]).max(axis=1) <= RADIUS
        right[part] = np.where(worst, right[part], -1)
    keep = right >= 0
    left, right = left[keep], right[keep]
    same = np.bitwise_count(fp_a[left] ^ fp_b[right]) <= RADIUS
    return left[same], right[same]


def _forest(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the sets of ``left[k]`` and ``right[k]`` by repeated minima over all pairs."""
    while len(left):
        a, b = parent[left], parent[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        moved = low < high
        if not moved.any():
            return
        left, right = left[moved], right[moved]
        np.minimum.at(parent, high[moved], low[moved])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _links_of(fps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one cell, in blocks."""
    parent = np.arange(len(fps))
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), BLOCK):
            left, right = close_pairs(fps[i : i + BLOCK], rows[i : i + BLOCK], fps[j : j + BLOCK], rows[j : j + BLOCK])
            _forest(parent, left + i, right + j)
    child = np.nonzero(parent != np.arange(len(fps)))[0]
    return fps[child], fps[parent[child]]


def _verify(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal ``(band, cell, part_a, part_b)``; rows come sorted by these."""
    for key, fps, rows, side in _runs(source):
        if key[2] == key[3]:
            a, b = _links_of(fps, rows)
        else:
            one, two = side == key[2], side != key[2]
            a, b = _across(fps[one], rows[one], fps[two], rows[two])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _across(fp_a: np.ndarray, row_a: np.ndarray, fp_b: np.ndarray, row_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two parts of a large cell."""
    fps = np.concatenate([fp_a, fp_b])
    parent = np.arange(len(fps))
    for i in range(0, len(fp_a), BLOCK):
        for j in range(0, len(fp_b), BLOCK):
            left, right = close_pairs(fp_a[i : i + BLOCK], row_a[i : i + BLOCK], fp_b[j : j + BLOCK], row_b[j : j + BLOCK])
            _forest(parent, left + i, right + j + len(fp_a))
    child = np.nonzero(parent != np.arange(len(fps)))[0]
    return fps[child], fps[parent[child]]


def _runs(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    key_names = ("band", "cell", "part_a", "part_b")
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    current: tuple | None = None
    for batch in source:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in key_names], axis=1)
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        rows = pivot_table(fps)  # a row of the table is eight times the fingerprint: made again rather than sent
        side = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
        for start, end in zip([0, *edges], [*edges, len(fps)], strict=True):
            key = tuple(keys[start].tolist())
            if key != current:
                if held and sum(len(h[0]) for h in held) > 1:
                    yield current, *(np.concatenate([h[i] for h in held]) for i in range(3))
                current, held = key, []
            held.append((fps[start:end], rows[start:end], side[start:end]))
    if held and sum(len(h[0]) for h in held) > 1:
        yield current, *(np.concatenate([h[i] for h in held]) for i in range(3))


def near_links(distinct_fps: DataFrame, *, part_rows: int = 8192) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` within RADIUS bits of each other.

    A cell of the table is one task's run while it has at most ``part_rows`` fingerprints.
    A larger one is cut into parts by the fingerprint's hash, and every pair of parts is
    a run of its own, so no task holds more than two parts. Of the links in a run only a
    spanning forest is returned: no reachability is lost, and the rows never exceed the
    fingerprints compared.
    """
    tables = stage(
        distinct_fps.select("fp").mapInArrow(_tables, "band int, cell bigint, fp bigint"), "pivot-cells"
    )
    large = (
        tables.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        .select("band", "cell", F.ceil(F.col("_n") / part_rows).cast("int").alias("parts"))
    )
    shared = tables.join(large, ["band", "cell"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    paired = shared.withColumn("part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    runs = paired.select(
        "band", "cell", F.least("part", "_other").alias("part_a"), F.greatest("part", "_other").alias("part_b"),
        "part", "fp",
    )
    key = ["band", "cell", "part_a", "part_b"]
    return runs.repartition(*key).sortWithinPartitions(*key, "fp").mapInArrow(_verify, "a bigint, b bigint")


def near_classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, fp, component_id)`` for every row: ``component_id`` is the smallest id reachable.

    Equal fingerprints are one node, however many rows have them. Null and empty texts have
    fingerprint 0 and link like any other. Rows with equal ids are kept. A null id stays
    null and takes the component of its fingerprint (null if it has no other member).
    """
    marked = stage(fingerprints(rows, key, text), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = stage(rooted, "roots")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage(rooted.join(lowest, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the smallest ``doc_id``, once.

    Every row is judged by its own text, also where rows share a ``doc_id``: of those in a group
    that share the smallest, the one with the smallest hash over all columns stays, and of equal rows one. Rows
    whose ``doc_id`` is null have no place in the order; they are kept, and link nothing. Null
    and empty texts have fingerprint 0 and are near copies of each other. Only ids, hashes and
    fingerprints are shuffled until the rows to keep are known.
    """
    marked = docs.withColumn("_row", row_hash(docs))
    placed = marked.where(F.col("doc_id").isNotNull())
    keyed = placed.select(F.struct("doc_id", "_row").alias("_id"), "text")
    classes = near_classes(keyed, "_id", "text").where(F.col("id") == F.col("component_id"))
    kept = stage(classes.groupBy(F.col("id.doc_id").alias("doc_id"), F.col("id._row").alias("_row")).agg(F.count(F.lit(1)).alias("_n")), "kept")
    once = placed.join(kept.where("_n = 1"), ["doc_id", "_row"], "left_semi")
    equal = kept.where("_n > 1")
    if not equal.isEmpty():
        once = once.unionByName(placed.join(equal, ["doc_id", "_row"], "left_semi").dropDuplicates(["doc_id", "_row"]))
    return once.unionByName(marked.where(F.col("doc_id").isNull())).select(*docs.columns)
