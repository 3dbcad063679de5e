"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector belongs to those filters whose inner product with it
exceeds a threshold, a cap of the sphere around it. Directions are the products of two
random codes over two random halves of the space, so a vector is list-decoded: codewords
of either half are scored once, and sums above the threshold are enumerated. The threshold
of a vector is ``EXPECTED`` filters a code by chance, lowered until it has ``LEAST``, so no
vector is without filters. Vectors are joined on filters and pairs verified.

What travels is a sketch of 8 bits a component. Filters come from the sketch by integer
arithmetic, so every task finds the same ones, and the sketch bounds the cosine from both
sides: most pairs are decided by it, the rest by the whole vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import batches, stage, stage_small
from muster.llm.components import components

THRESHOLD = 0.9
CODES = 7
EXPECTED = 1.0
LEAST = 5
TOP = 16
SMALL_DIM = 8  # vectors this short are compared without filters
PART_ROWS = 4096  # members of a filter that one run compares with each other
SMALL_RUN = 24
BLOCK = 1024


# Codes and decoding


def code_size(n: int) -> int:
    """Codewords of each half, so that a filter has about one vector by chance."""
    return 1 << max(5, math.ceil(math.log2(math.sqrt(max(1, n) * LEAST))))


@lru_cache(maxsize=16)
def codebook(dim: int, size: int, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Two dim x size matrices of whole numbers: the codes of two random halves of the space."""
    random = np.random.default_rng([dim, size, code])
    turn = np.linalg.qr(random.standard_normal((dim, dim)))[0]
    halves = []
    for part in (turn[:, : dim // 2], turn[:, dim // 2 :]):
        words = random.standard_normal((size, part.shape[1]))
        words /= np.linalg.norm(words, axis=1, keepdims=True) * math.sqrt(2)
        halves.append(np.round(part @ words.T * 4096))
    return halves[0], halves[1]


def sketch(vectors: np.ndarray) -> np.ndarray:
    """Rows as whole numbers from -127 to 127, the largest component at either end."""
    return np.round(vectors * (127.0 / np.abs(vectors).max(axis=1, keepdims=True))).astype(np.int8)


def decode(sketches: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, cell)`` of every filter of every row, in order of owner.

    All sums are whole numbers below 2**53, so they do not depend on how rows are batched.
    """
    n, dim = sketches.shape
    if dim < SMALL_DIM:
        return np.arange(n), np.zeros(n, dtype=np.int64)
    whole = sketches.astype(np.float64)
    norms = np.sqrt((whole * whole).sum(axis=1))
    alpha = NormalDist().inv_cdf(1 - EXPECTED / size**2) / math.sqrt(dim)
    top = min(TOP, size)
    owners, cells = [], []
    for code in range(CODES):
        one, two = codebook(dim, size, code)
        s1, s2 = whole @ one, whole @ two
        at1, at2 = (np.argsort(-s, axis=1, kind="stable")[:, :top] for s in (s1, s2))
        b1, b2 = np.take_along_axis(s1, at1, 1), np.take_along_axis(s2, at2, 1)
        sums = b1[:, :, None] + b2[:, None, :]
        # the k-th best sum is always one of the k best of either half
        best = np.sort(sums[:, :LEAST, :LEAST].reshape(n, -1), axis=1)[:, -LEAST]
        limit = np.minimum(alpha * 4096 * norms, best)
        row, i, j = np.nonzero(sums >= limit[:, None, None])
        found = (code * size + at1[row, i]) * size + at2[row, j]
        owners.append(row)
        cells.append(found)
        if top < size:
            # sums with a codeword beyond the top ones
            for r in np.nonzero((b1[:, -1] + b2[:, 0] >= limit) | (b1[:, 0] + b2[:, -1] >= limit))[0]:
                i, j = np.nonzero(s1[r][:, None] + s2[r][None, :] >= limit[r])
                new = (code * size + i) * size + j
                new = new[~np.isin(new, found[row == r])]
                owners.append(np.full(len(new), r))
                cells.append(new)
    owner, cell = np.concatenate(owners), np.concatenate(cells).astype(np.int64)
    order = np.lexsort((cell, owner))
    return owner[order], cell[order]


# Vectors and classes of equal ones


def _as_matrix(values: pa.Array) -> list[np.ndarray | None]:
    """The components of each list in double precision, or None if it has no direction."""
    offsets = values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
    valid = np.ones(len(values), dtype=bool) if values.null_count == 0 else values.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for number, ok in enumerate(valid):
        row = flat[offsets[number] : offsets[number + 1]]
        out.append(row if ok and len(row) and np.isfinite(row).all() and row.any() else None)
    return out


def _keyed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, 4096):
        rows = _as_matrix(batch.column(1))
        data = [None if r is None else (r + 0.0).tobytes() for r in rows]  # + 0.0: no negative zeros
        keys = [None if d is None else xxhash.xxh3_128_digest(d) for d in data]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["id", "key", "vector"]
        )


def _filtered(size: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1024):
            vectors = [np.frombuffer(v) for v in batch.column("vector").to_pylist()]
            cids, weights = (batch.column(c).to_numpy() for c in ("cid", "members"))
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                here = np.nonzero(dims == dim)[0]
                sketches = sketch(np.stack([vectors[i] for i in here]))
                owner, cell = decode(sketches, size)
                packed = [row.tobytes() for row in sketches]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(cell), dim, dtype=np.int32)),
                        pa.array(cell),
                        pa.array(cids[here][owner]),
                        pa.array(weights[here][owner]),
                        pa.array([packed[i] for i in owner], pa.binary()),
                    ],
                    names=["dim", "cell", "cid", "members", "sketch"],
                )

    return run


# Pairs within a filter


class _Run:
    """The members of one filter, or of two parts of a large one."""

    def __init__(self, size: int, cell: int, cids: np.ndarray, members: np.ndarray, sketches: np.ndarray, side: np.ndarray | None) -> None:
        self.size, self.cell, self.cids, self.members, self.sketches, self.side = size, cell, cids, members, sketches, side
        self.whole = sketches.astype(np.float64)
        self.norms = np.sqrt((self.whole**2).sum(axis=1))
        # how far a sketch may turn a vector: half a unit in every component
        self.turn = np.arcsin(np.minimum(1.0, 0.5 * math.sqrt(sketches.shape[1]) / self.norms)) + 1e-9

    def earlier(self) -> np.ndarray:
        """Which filters before this one each member is in, as rows of 0 and 1."""
        if not hasattr(self, "_earlier"):
            owner, cell = decode(self.sketches, self.size)
            before = cell < self.cell
            names, column = np.unique(cell[before], return_inverse=True)
            self._earlier = np.zeros((len(self.cids), len(names)), dtype=np.float32)
            self._earlier[owner[before], column] = 1.0
        return self._earlier

    def compare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links per member, a forest of the links, and the pairs that the sketch leaves open."""
        n = len(self.cids)
        links, parent = np.zeros(n, dtype=np.int64), np.arange(n)
        open_a, open_b = [], []
        for i in range(0, n, BLOCK):
            for j in range(i, n, BLOCK):
                rows, columns = slice(i, i + BLOCK), slice(j, j + BLOCK)
                cosine = self.whole[rows] @ self.whole[columns].T / (self.norms[rows, None] * self.norms[None, columns])
                slack = self.turn[rows, None] + self.turn[None, columns]
                near = cosine >= THRESHOLD - slack
                if i == j:
                    near = np.triu(near, 1)
                if self.side is not None:
                    near &= self.side[rows, None] != self.side[None, columns]
                a, b = np.nonzero(near)
                if not len(a):
                    continue
                earlier = self.earlier()
                if len(a) * 8 > near.size:
                    first = (earlier[rows] @ earlier[columns].T == 0)[a, b]
                else:
                    first = np.concatenate([
                        ~(earlier[a[k : k + 4096] + i] * earlier[b[k : k + 4096] + j]).any(axis=1) for k in range(0, len(a), 4096)
                    ])
                a, b = a[first], b[first]
                sure = cosine[a, b] >= THRESHOLD + slack[a, b]
                open_a.append(a[~sure] + i)
                open_b.append(b[~sure] + j)
                a, b = a[sure] + i, b[sure] + j
                np.add.at(links, a, self.members[b])
                np.add.at(links, b, self.members[a])
                _join(parent, a, b)
        open_pairs = np.concatenate(open_a or [np.empty(0, int)]), np.concatenate(open_b or [np.empty(0, int)])
        return links, parent, *open_pairs


def _join(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Unite the sets of left[k] and right[k]; every entry of ``parent`` stays its set's least."""
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent[parent], parent):
            parent[:] = parent[parent]


LINKS, EDGE, OPEN = 0, 1, 2


def _compare(size: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(source):
            yield from _compared(batch, size)

    return run


KEY = ("dim", "cell", "part_a", "part_b")


def _whole_runs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of sorted rows, cut between runs."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEY], axis=1)
        last = np.nonzero((keys != keys[-1]).any(axis=1))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if held and cut == 0:
            same = all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in KEY)
            if not same:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _compared(table: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
    get = lambda name: table.column(name).to_numpy().astype(np.int64)
    keys = np.stack([get(c) for c in KEY], axis=1)
    cids, members, part = get("cid"), get("members"), get("part")
    starts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1])
    ends = np.append(starts[1:], len(keys))
    packed = table.column("sketch").to_pylist()
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for run in _with_links(packed, keys[:, 0], starts, ends):
        start, end = starts[run], ends[run]
        sketches = np.frombuffer(b"".join(packed[start:end]), dtype=np.int8).reshape(end - start, -1)
        side = None if keys[start, 2] == keys[start, 3] else part[start:end]
        found = _Run(size, int(keys[start, 1]), cids[start:end], members[start:end], sketches, side)
        links, parent, a, b = found.compare()
        some, child = np.nonzero(links)[0], np.nonzero(parent != np.arange(len(parent)))[0]
        out.append((LINKS, found.cids[some], links[some]))
        out.append((EDGE, found.cids[child], found.cids[parent[child]]))
        out.append((OPEN, found.cids[a], found.cids[b]))
    if out:
        kind = np.concatenate([np.full(len(a), k, dtype=np.int32) for k, a, _ in out])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(np.concatenate([a for _, a, _ in out])), pa.array(np.concatenate([b for _, _, b in out]))],
            names=["kind", "a", "b"],
        )


def _with_links(packed: list[bytes], dims: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs that may hold a link: large ones, and small ones with a near pair, tested all at once."""
    sizes = ends - starts
    chosen = [np.nonzero(sizes > SMALL_RUN)[0]]
    for dim in np.unique(dims[starts]):
        for count in range(2, SMALL_RUN + 1):
            some = np.nonzero((sizes == count) & (dims[starts] == dim))[0]
            for k in range(0, len(some), 1024):
                runs = some[k : k + 1024]
                rows = (starts[runs][:, None] + np.arange(count)).ravel()
                whole = np.frombuffer(b"".join([packed[r] for r in rows]), dtype=np.int8).astype(np.float32).reshape(len(runs), count, dim)
                norms = np.sqrt((whole * whole).sum(axis=2))
                cosine = whole @ whole.transpose(0, 2, 1) / (norms[:, :, None] * norms[:, None, :])
                slack = 2 * np.arcsin(np.minimum(1.0, 0.5 * math.sqrt(dim) / norms.min(axis=1))) + 1e-4
                near = (cosine >= THRESHOLD - slack[:, None, None]) & np.triu(np.ones((count, count), dtype=bool), 1)
                chosen.append(runs[near.any(axis=(1, 2))])
    return np.sort(np.concatenate(chosen))


def _scaled(data: bytes) -> np.ndarray:
    """A vector whose squares cannot overflow or vanish."""
    vector = np.frombuffer(data)
    return vector / np.abs(vector).max()


def _exact(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        one, two = ([_scaled(v) for v in batch.column(c).to_pylist()] for c in ("vector_a", "vector_b"))
        linked = [x @ y >= THRESHOLD * math.sqrt(x @ x) * math.sqrt(y @ y) for x, y in zip(one, two, strict=True)]
        yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b", "members_a", "members_b"])


def near_classes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Links are pairs with a cosine of THRESHOLD or more. Equal vectors are one class from the
    start, so copies cost one comparison however many there are. A filter with very many
    classes is cut into parts and its pairs of parts are runs of their own; a run gives the
    number of links of each class and a forest of them, not the pairs. A pair counts in the
    first filter it shares. Null, empty and zero vectors, and those with null, NaN or infinite
    components, link with nothing, each its own component. Vectors of different lengths never
    link. Null ids are counted as others' links but are no component's name; they are not kept.
    """
    kind = dict(rows.dtypes)[key]
    keyed = stage_small(
        rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")).mapInArrow(
            _keyed, f"id {kind}, key binary, vector binary"
        ),
        "vectors",
    )
    equal = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("members"), F.min("vector").alias("vector")
    )
    classes = stage_small(equal.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    size = code_size(classes.count())
    cells = stage_small(
        classes.select("cid", "members", "vector").mapInArrow(
            _filtered(size), "dim int, cell bigint, cid bigint, members bigint, sketch binary"
        ),
        "cap-filters",
    )
    crowded = stage(
        cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PART_ROWS)
        .select("dim", "cell", F.ceil(F.col("_n") / PART_ROWS).cast("int").alias("_parts")),
        "crowded-filters",
    )
    split = cells.join(crowded, ["dim", "cell"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    part = F.pmod(F.xxhash64("cid"), F.col("_parts")).cast("int")
    split = split.withColumn("part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    runs = split.select(
        "dim", "cell", F.least("part", "_other").alias("part_a"), F.greatest("part", "_other").alias("part_b"),
        "part", "cid", "members", "sketch",
    )
    dealt = runs.repartition(*KEY).sortWithinPartitions(*KEY, "cid")
    found = stage(dealt.mapInArrow(_compare(size), "kind int, a bigint, b bigint"), "cap-links")
    links, edges = _with_open(found, classes)
    counted = links.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = components(edges)
    rooted = stage(
        classes.select("key", "cid", "least", "members")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .join(counted.withColumnRenamed("cid", "_cid"), F.col("cid") == F.col("_cid"), "left")
        .select(
            "key", "least", F.coalesce("root", "cid").alias("root"),
            (F.coalesce("n", F.lit(0)) + F.col("members") - 1).cast("bigint").alias("n_links"),
        ),
        "rooted-classes",
    )
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stage(rooted.join(lowest, "root").select("key", "n_links", "component_id"), "linked-classes")
    full = keyed.select("id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return full.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    )


def _with_open(found: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and edges, those of open pairs decided by the whole vectors."""
    side = lambda s: classes.select(
        F.col("cid").alias(s), F.col("members").alias(f"members_{s}"), F.col("vector").alias(f"vector_{s}")
    )
    pairs = found.where(F.col("kind") == OPEN).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    decided = stage(
        pairs.select("a", "b", "members_a", "members_b", "vector_a", "vector_b").mapInArrow(
            _exact, "a bigint, b bigint, members_a bigint, members_b bigint"
        ),
        "open-pairs",
    )
    links = (
        found.where(F.col("kind") == LINKS).select(F.col("a").alias("cid"), F.col("b").alias("n"))
        .unionByName(decided.select(F.col("a").alias("cid"), F.col("members_b").alias("n")))
        .unionByName(decided.select(F.col("b").alias("cid"), F.col("members_a").alias("n")))
    )
    edges = found.where(F.col("kind") == EDGE).select("a", "b").unionByName(decided.select("a", "b"))
    return links, edges
