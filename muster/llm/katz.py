"""Scoring by a word bigram model with Katz backoff.

    P(w | v) = d(c) c / (T(v) + 1)          if the pair (v, w) was seen c times in training
             = a(v) P(w)                    otherwise

``d`` is the Good-Turing discount for counts up to DISCOUNTED and 1 above. ``a(v)`` is what
the seen words leave of 1, over what they leave of the unigram mass, so the probabilities
of the V known words and the one unknown word add up to 1 exactly. T(v) counts the training
tokens after v. The 1 beside it leaves mass in contexts whose counts are all high. Unigrams
back off in the same way to the unknown word. A text starts in its own context and ends with
an end token; after an unknown word the unigram is used.

Tables are partitioned: words by their hash, pairs by the first word, pairs after very
frequent words by both. What moves between the steps are blocks: the distinct entries that
one chunk of documents has for one partition, as compressed arrays. Every entry of a block is
counted, and no table is held by one task or the driver. A pair goes out without its documents,
and its count comes back in the same order: the chunk finds its pairs again to place the counts,
so that what moves and is stored is in proportion to the tokens, however many partitions there are.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import batches, stage, stage_small, word_pieces
from muster.shared import PACKED, fresh_path, scratch, short_shuffles

DISCOUNTED = 5  # counts up to this are discounted
CHUNK_BYTES = 16 << 20  # text of a chunk; a longer text is a chunk of its own
BUCKET_WORDS = 500_000  # entries of chunks' vocabularies that one word partition is meant to have
BUCKET_TOKENS = 2_500_000  # tokens that one pair partition is meant to have
HOT_SHARE = 1e-4  # contexts with more of all tokens are spread: 10,000 at most
START, END = -2, -1


# Blocks


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte planes together."""
    head = struct.pack("<I", len(arrays))
    body = []
    for array in arrays:
        head += struct.pack("<2sQ", array.dtype.str[1:].encode(), len(array))
        body.append(np.ascontiguousarray(array.view(np.uint8).reshape(len(array), array.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (count,) = struct.unpack_from("<I", raw)
    at, kinds = 4, []
    for _ in range(count):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        kinds.append((np.dtype("<" + kind.decode()), n))
        at += 10
    out = []
    for kind, n in kinds:
        size = kind.itemsize * n
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def small(array: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    top = int(array.max(initial=0))
    return array.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _spread(ids: np.ndarray, n: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % n


# Discounts


def discounts(counts_of: list[int]) -> np.ndarray:
    """d(1) to d(DISCOUNTED) from the numbers of entries seen 1, 2, … DISCOUNTED + 1 times.

    Good-Turing as Katz has it. Where the numbers of entries are too few for a discount
    between 0 and 1, half a count is taken instead.
    """
    n = [0, *counts_of]
    out = []
    top = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        value = math.nan
        if n[r] and top < 1:
            value = ((r + 1) * n[r + 1] / (n[r] * r) - top) / (1 - top)
        out.append(value if 0 < value < 1 else (r - 0.5) / r)
    return np.array(out)


class Unigrams:
    """Probabilities of words by their training count."""

    def __init__(self, tokens: int, types: int, counts_of: list[int], documents: int) -> None:
        self.tokens, self.types, self.documents = tokens, types, documents
        self.discount = discounts(counts_of)
        r = np.arange(1, DISCOUNTED + 1)
        low = np.array(counts_of[:DISCOUNTED], dtype=np.float64)
        seen = (low * r * self.discount).sum() + tokens - (low * r).sum()
        self.unknown = 1.0 - seen / (tokens + 1)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        scale = np.where(counts > DISCOUNTED, 1.0, np.append(0.0, self.discount)[np.minimum(counts, DISCOUNTED)])
        return np.where(counts > 0, scale * counts / (self.tokens + 1), self.unknown)


# Step 1: chunks of documents with their own vocabulary


def _chunks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    vocabulary: dict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    size = 0

    def flush() -> pa.RecordBatch:
        tokens = np.concatenate([t for _, _, t in held]) if held else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(tokens, minlength=len(vocabulary)), kind="stable")  # frequent words get low numbers
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order))
        tokens = rank[tokens]
        spelled = list(vocabulary)
        lengths = np.array([len(t) for _, _, t in held], dtype=np.uint64)
        kept_out = np.array([h for _, h, _ in held], dtype=bool)
        trained = np.bincount(tokens[~np.repeat(kept_out, lengths.astype(np.int64))], minlength=len(vocabulary))
        words = zstandard.ZstdCompressor(level=1).compress(b" ".join([spelled[i] for i in order]))
        row = {
            "chunk": (part << 24) + number,
            "words": words,
            "n_words": len(vocabulary),
            "n_tokens": len(tokens),
            "n_trained": int((~kept_out).sum()),
            "counts": pack(small(trained)),
            "documents": pack(kept_out.astype(np.uint8), small(lengths)),
            "tokens": pack(tokens),
        }
        ids = pa.array([[i for i, _, _ in held]], pa.list_(id_kind))
        names = list(row)
        return pa.RecordBatch.from_arrays([*(pa.array([row[n]]) for n in names), ids], names=[*names, "ids"])

    id_kind = None
    for batch in batches(source):
        id_kind = batch.column(0).type
        for key, text, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode("utf-8")
            found = [np.fromiter(map(vocabulary.__getitem__, w), np.uint32, len(w)) for w in word_pieces(data.lower())]
            held.append((key, bool(out), np.concatenate(found) if found else np.empty(0, np.uint32)))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield flush()
                number, size, held = number + 1, 0, []
                vocabulary.clear()
    if held:
        yield flush()


# Step 2: counts of words


def _word_blocks(n_buckets: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1):
            chunk, packed, counts = (batch.column(i)[0].as_py() for i in range(3))
            text = zstandard.ZstdDecompressor().decompress(packed)
            words = text.split(b" ") if text else []
            (trained,) = unpack(counts)
            bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % n_buckets
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows = []
            for b in range(n_buckets):
                at = order[ends[b] : ends[b + 1]]
                if len(at):
                    blob = zstandard.ZstdCompressor(level=1).compress(b" ".join([words[i] for i in at]))
                    rows.append((b, chunk, blob, pack(small(at), small(trained[at]))))
            if rows:
                b, c, w, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(w, pa.binary()), pa.array(d, pa.binary())],
                    names=["key", "chunk", "words", "data"],
                )

    return run


def _by_key(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key, of a sorted source."""
    current, held = None, []
    for batch in source:
        for row in batch.to_pylist():
            if row["key"] != current:
                if held:
                    yield current, held
                current, held = row["key"], []
            held.append(row)
    if held:
        yield current, held


COUNTS_OF = [f"r{r}" for r in range(1, DISCOUNTED + 2)]


def _counts_of(counts: np.ndarray) -> dict[str, int]:
    found = np.bincount(counts[counts <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
    return {name: int(found[r]) for r, name in enumerate(COUNTS_OF, 1)}


def _count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block, its words' numbers and training counts; and a row of totals."""
    for bucket, rows in _by_key(source):
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        blocks = []
        for row in rows:
            words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
            at, trained = unpack(row["data"])
            blocks.append((row["chunk"], at, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), trained))
        counts = np.zeros(len(numbers), dtype=np.int64)
        for _, _, word, trained in blocks:
            counts[word] += trained.astype(np.int64)  # a word is once in a block
        out = [
            {"chunk": chunk, "data": pack(at, (np.int64(bucket) << 32) + word, small(counts[word]))}
            for chunk, at, word, _ in blocks
        ]
        total = {"n": int(counts.sum()), "v": int((counts > 0).sum()), **_counts_of(counts)}
        yield pa.RecordBatch.from_pylist([*out, total], schema=WORD_COUNTS)


WORD_COUNTS = pa.schema(
    [("chunk", pa.int64()), ("data", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), *((c, pa.int64()) for c in COUNTS_OF)]
)


# Step 3: pairs of each chunk


def _pair_blocks(unigrams: Unigrams, n_buckets: int, hot: float) -> Callable:
    schema = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1):
            (row,) = batch.to_pylist()
            _, blocks = _pairs_of(row, unigrams, n_buckets, hot)
            rows = [{"key": b.bucket, "chunk": row["chunk"], "data": b.packed()} for b in blocks]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


class Pairs(NamedTuple):
    """The distinct pairs of a chunk in one partition, by context; and the documents each is in."""

    bucket: int
    heads: np.ndarray  # contexts
    head_count: np.ndarray
    head_pairs: np.ndarray  # pairs of each context
    token: np.ndarray
    token_count: np.ndarray
    trained: np.ndarray
    entries: np.ndarray  # documents of each pair
    document: np.ndarray
    times: np.ndarray

    def packed(self) -> bytes:
        """What step 4 needs: the pairs without their documents, a token's id and count once."""
        tokens, first, at = np.unique(self.token, return_index=True, return_inverse=True)
        count = self.token_count[first]
        order = np.argsort(-count, kind="stable")  # frequent tokens get low numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        down = count[order]
        return pack(
            self.heads, small(self.head_count), small(self.head_pairs),
            tokens[order], small(down - np.append(down[1:], 0)), small(rank[at]), small(self.trained),
        )


def _pairs_of(row: dict, unigrams: Unigrams, n_buckets: int, hot: float) -> tuple[tuple, Iterator[Pairs]]:
    """What a chunk's documents have without pairs, and its pairs by partition.

    Steps 3 and 5 both ask for it: the order of the pairs depends on the row alone.
    """
    kept_out, lengths = unpack(row["documents"])
    lengths = lengths.astype(np.int64)
    (tokens,) = unpack(row["tokens"])
    n_words, n_docs = row["n_words"], len(lengths)
    word, count = np.empty(n_words + 2, dtype=np.int64), np.zeros(n_words + 2, dtype=np.int64)
    for block in row["blocks"] or ():
        at, ids, counts = unpack(block)
        word[at], count[at] = ids, counts
    start, end = n_words, n_words + 1
    word[[start, end]] = START, END
    count[[start, end]] = unigrams.documents

    # the context and the token at every place, the end of each text included
    places = lengths + 1
    last = np.cumsum(places) - 1
    token = np.full(int(places.sum()), end, dtype=np.int64)
    inside = np.ones(len(token), dtype=bool)
    inside[last] = False
    token[inside] = tokens
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[last - lengths] = start
    document = np.repeat(np.arange(n_docs), places)

    by_document = lambda values: np.bincount(document, weights=values, minlength=n_docs)
    seen = count[token]
    scale = unigrams.tokens + 1.0 * (unigrams.types + 1)
    base = by_document(np.log10((seen + 1) / scale))
    known = by_document(seen > 0).astype(np.int64)
    alone = count[context] == 0
    local = by_document(np.where(alone, np.log10(unigrams.probability(seen)), 0.0))
    info = (kept_out, places, known, base, local)

    if alone.any():
        context, token, document = context[~alone], token[~alone], document[~alone]
    if not len(token):
        return info, iter(())
    entry, times = np.unique((context * (n_words + 2) + token) * n_docs + document, return_counts=True)
    pair_of, document = entry // n_docs, entry % n_docs
    first = np.nonzero(np.diff(pair_of, prepend=-1))[0]
    context, token = np.divmod(pair_of[first], n_words + 2)
    trained = np.add.reduceat(np.where(kept_out[document] == 0, times, 0), first)
    entries = np.diff(np.append(first, len(entry)))

    bucket = _spread(word[context], n_buckets)
    spread = count[context] > hot
    if spread.any():
        both = word[context[spread]] * 1_000_003 + word[token[spread]]
        bucket[spread] = _spread(both, n_buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))

    def blocks() -> Iterator[Pairs]:
        for b in range(n_buckets):
            pairs = order[cuts[b] : cuts[b + 1]]
            if not len(pairs):
                continue
            of = context[pairs]
            heads = np.nonzero(np.diff(of, prepend=-1))[0]
            n = entries[pairs]
            at = np.repeat(first[pairs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            yield Pairs(
                b, word[of[heads]], count[of[heads]], np.diff(np.append(heads, len(of))),
                word[token[pairs]], count[token[pairs]], trained[pairs], n, document[at], times[at],
            )

    return info, blocks()


# Step 4: counts of pairs, and what the pairs of each chunk have of them


def _count_pairs(unigrams: Unigrams, hot: float) -> Callable:
    schema = pa.schema(
        [("chunk", pa.int64()), ("wid", pa.int64()), ("stats", pa.list_(pa.float64())), ("data", pa.binary()), ("kind", pa.string())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _by_key(source):
            yield pa.RecordBatch.from_pylist(_counted(key, rows, unigrams, hot), schema=schema)

    return run


def _counted(key: int, rows: list[dict], unigrams: Unigrams, hot: float) -> list[dict]:
    blocks = [unpack(row["data"]) for row in rows]
    wide = lambda i: np.concatenate([b[i].astype(np.int64) for b in blocks])
    heads, head_count, head_pairs, trained = (wide(i) for i in (0, 1, 2, 6))
    contexts, context = np.unique(heads, return_inverse=True)
    total = np.zeros(len(contexts), dtype=np.int64)
    total[context] = head_count
    context = np.repeat(context, head_pairs)
    tokens, number = np.unique(wide(3), return_inverse=True)
    token_count = np.zeros(len(tokens), dtype=np.int64)
    token_count[number] = np.concatenate([np.cumsum(b[4][::-1].astype(np.int64))[::-1] for b in blocks])
    starts = np.cumsum([0, *(len(b[3]) for b in blocks)])
    token_at = np.concatenate([number[n + b[5].astype(np.int64)] for n, b in zip(starts, blocks, strict=False)])
    pairs, pair = np.unique(context * len(tokens) + token_at, return_inverse=True)
    count = np.bincount(pair, weights=trained, minlength=len(pairs)).astype(np.int64)

    # per context: pairs seen 1 to DISCOUNTED times, the counts above, the unigram mass of seen words
    seen = count > 0
    of, c = pairs[seen] // len(tokens), count[seen]
    token = pairs[seen] % len(tokens)
    low = c <= DISCOUNTED
    stats = np.zeros((len(contexts), DISCOUNTED + 3))
    np.add.at(stats, (of[low], c[low] - 1), 1)
    stats[:, DISCOUNTED] = np.bincount(of, weights=np.where(low, 0, c), minlength=len(contexts))
    stats[:, DISCOUNTED + 1] = np.bincount(of, weights=unigrams.probability(token_count)[token], minlength=len(contexts))
    stats[:, DISCOUNTED + 2] = total

    out = [{"kind": "counts", "stats": [float(v) for v in _counts_of(c).values()]}]
    out.append({"kind": "model", "wid": key, "data": pack(contexts[of], tokens[token], small(c))})
    for i in np.nonzero(total > hot)[0]:
        out.append({"kind": "hot", "wid": int(contexts[i]), "stats": stats[i].tolist()})

    here = count[pair]
    at = 0
    for row, block in zip(rows, blocks, strict=True):
        mine = slice(at, at := at + len(block[5]))
        own = stats[np.searchsorted(contexts, block[0][_backed(here[mine], block[2]) & (block[1] <= hot)])]
        out.append({"kind": "parts", "chunk": row["chunk"], "wid": key, "data": pack(
            small(here[mine]), small(own[:, : DISCOUNTED + 1].astype(np.int64).T.reshape(-1)), own[:, DISCOUNTED + 1].copy(),
        )})
    return out


def _backed(count: np.ndarray, head_pairs: np.ndarray) -> np.ndarray:
    """Whether a context has pairs that were not seen."""
    first = np.cumsum(head_pairs, dtype=np.int64) - head_pairs
    return np.logical_or.reduceat(count == 0, first)


# Step 5: scores


def backoff(stats: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """a(v) from the statistics of contexts."""
    r = np.arange(1, DISCOUNTED + 1)
    given = (stats[:, :DISCOUNTED] * r * discount).sum(axis=1) + stats[:, DISCOUNTED]
    return (1.0 - given / (stats[:, -1] + 1.0)) / (1.0 - stats[:, DISCOUNTED + 1])


def _log_pairs(block: Pairs, data: bytes, unigrams: Unigrams, discount: np.ndarray, hot: float, hot_logs: dict[int, float]) -> np.ndarray:
    """The logarithm of each pair's probability."""
    count, numbers, mass = unpack(data)
    count = count.astype(np.int64)
    backed = _backed(count, block.head_pairs)
    frequent = block.head_count > hot
    own = backed & ~frequent
    stats = np.column_stack([numbers.reshape(DISCOUNTED + 1, -1).T, mass, block.head_count[own]]).astype(np.float64)
    left = np.zeros(len(backed))
    left[own] = np.log10(backoff(stats, discount))
    for i in np.nonzero(backed & frequent)[0]:
        left[i] = hot_logs[int(block.heads[i])]
    given = np.append(discount * np.arange(1, DISCOUNTED + 1), 1.0)[np.clip(count, 1, DISCOUNTED + 1) - 1]
    given = given * np.where(count > DISCOUNTED, count, 1) / (np.repeat(block.head_count, block.head_pairs) + 1.0)
    alone = np.log10(unigrams.probability(block.token_count)) + np.repeat(left, block.head_pairs)
    return np.where(count > 0, np.log10(given), alone)


def _finish(
    unigrams: Unigrams, n_buckets: int, hot: float, discount: np.ndarray, hot_logs: dict[int, float], names: list[str], id_kind: pa.DataType
) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(source):
            (row,) = (r for r in rows if r["kind"] == "chunk")
            parts = {r["wid"]: r["data"] for r in rows if r["kind"] == "parts"}
            (kept_out, places, known, base, score), blocks = _pairs_of(row, unigrams, n_buckets, hot)
            for block in blocks:
                logs = _log_pairs(block, parts[block.bucket], unigrams, discount, hot, hot_logs)
                score += np.bincount(block.document, weights=block.times * np.repeat(logs, block.entries), minlength=len(score))
            columns = [
                pa.array(row["ids"], id_kind), pa.array(kept_out.astype(bool)), pa.array(places), pa.array(known),
                pa.array(np.full(len(places), unigrams.tokens)), pa.array(base), pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def katz_scores(rows: DataFrame, key: str, text: str, held_out: str) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every whole text.

    Learns from rows whose ``held_out`` is false; null counts as false. Words are lower-cased
    in A-Z; null and empty texts are the end token alone. Rows with equal keys are scored one by
    one. Without training rows every probability is that of the unknown word, 1. Scores are
    base-10 logarithms. The order of floating-point sums follows the chunks, so the last
    digits may depend on how the input is split.
    """
    spark = rows.sparkSession
    with short_shuffles(spark), scratch(spark):
        return _staged_scores(rows, key, text, held_out)


def _staged_scores(rows: DataFrame, key: str, text: str, held_out: str) -> DataFrame:
    """Within ``scratch``: the model and the scores stay, the tables of chunks and words go as soon as they are used up."""
    spark, kind, id_kind = rows.sparkSession, dict(rows.dtypes)[key], _arrow_kind(rows, key)
    path = fresh_path(spark, "katz-filled")  # outlives what it is made of
    with scratch(spark):
        chunks = stage_small(
            rows.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
            .mapInArrow(
                _chunks,
                "chunk bigint, words binary, n_words bigint, n_tokens bigint, n_trained bigint, counts binary, "
                f"documents binary, tokens binary, ids array<{kind}>",
            ),
            "katz-chunks",
        )
        n_words, n_tokens, documents, n_chunks = (
            int(v or 0) for v in chunks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_trained"), F.count("*")).first()
        )

        n_buckets = 1 + n_words // BUCKET_WORDS
        blocks = chunks.select("chunk", "words", "counts").mapInArrow(
            _word_blocks(n_buckets), "key bigint, chunk bigint, words binary, data binary"
        )
        sums = ", ".join(f"{c} bigint" for c in ("n", "v", *COUNTS_OF))
        words = stage_small(
            blocks.repartition(n_buckets, "key").sortWithinPartitions("key", "chunk")
            .mapInArrow(_count_words, f"chunk bigint, data binary, {sums}"),
            "katz-words",
        )
        totals = words.agg(*[F.sum(c) for c in ("n", "v", *COUNTS_OF)]).first()
        of_chunk = words.where(F.col("chunk").isNotNull()).groupBy(F.col("chunk").alias("_chunk")).agg(F.collect_list("data").alias("blocks"))
        joined = chunks.select("chunk", "n_words", "documents", "tokens", "ids").join(
            of_chunk, F.col("chunk") == F.col("_chunk"), "left"
        ).drop("_chunk")
        joined.write.option("compression", PACKED).parquet(path)
    filled = spark.read.schema(joined.schema).parquet(path)
    tokens, types, *counts_of = (int(v or 0) for v in totals)
    if documents:  # the end token is a word like any other
        tokens, types = tokens + documents, types + 1
        if documents <= DISCOUNTED + 1:
            counts_of[documents - 1] += 1
    unigrams = Unigrams(tokens, types, counts_of, documents)

    n_buckets, hot = 1 + n_tokens // BUCKET_TOKENS, max(1000.0, HOT_SHARE * tokens)
    pairs = filled.mapInArrow(_pair_blocks(unigrams, n_buckets, hot), "key bigint, chunk bigint, data binary")
    counted = stage(
        pairs.repartition(n_buckets, "key").sortWithinPartitions("key", "chunk").mapInArrow(
            _count_pairs(unigrams, hot), "chunk bigint, wid bigint, stats array<double>, data binary, kind string"
        ),
        "katz-model",
        partition_by="kind",
        keep=True,
    )
    n_stats = DISCOUNTED + 3
    summed = lambda n: [F.sum(F.element_at("stats", i + 1)) for i in range(n)]
    discount = discounts([int(v or 0) for v in counted.where("kind = 'counts'").agg(*summed(DISCOUNTED + 1)).first()])
    merged = counted.where("kind = 'hot'").groupBy("wid").agg(*summed(n_stats - 1), F.max(F.element_at("stats", n_stats)))
    frequent = merged.collect()  # 1 / HOT_SHARE rows at most
    hot_logs = {r[0]: float(np.log10(backoff(np.array([r[1:]]), discount))[0]) for r in frequent}

    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    parts = counted.where("kind = 'parts'").select(F.col("chunk").alias("key"), "kind", "wid", "data")
    return stage(
        filled.withColumn("kind", F.lit("chunk")).withColumnRenamed("chunk", "key").unionByName(parts, allowMissingColumns=True)
        .repartition(max(1, n_chunks), "key").sortWithinPartitions("key", "kind")
        .mapInArrow(
            _finish(unigrams, n_buckets, hot, discount, hot_logs, names, id_kind),
            f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        ),
        "katz-scores",
        keep=True,
    )


def _arrow_kind(rows: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[key].dataType)
