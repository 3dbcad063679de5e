"""BPE encoding by speculation: propose, check all neighbours at once, merge only what fails.

Greedy longest match proposes tokens for a word. A sequence of tokens is what the merges
would give if and only if each token is what the merges make of its own bytes, and no
merge reaches across the border of two neighbours before the tokens are complete. The
second is a property of the pair: a merge of ``x``, on the right edge of the left token,
and ``y``, on the left edge of the right one, would come first if its rank is below that
of the merge that takes ``x`` up and not above that of the merge that takes ``y`` up. All
pairs of a batch are checked by array operations; words with a bad pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import batches
from muster.llm.pretokens import PieceCache, Vocabulary, vocabulary

NEVER = int(np.iinfo(np.int64).max)
ROWS = 4096  # documents whose digests are held at a time
IDS = 1 << 20  # ids that leave as one batch
SHORT = 64  # bytes up to which a scan for the lowest rank beats a heap


class SpeculativeEncoder:
    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.right_edge = self._edges(vocab.right)
        self.left_edge = self._edges(vocab.left)
        self.whole = self._whole()
        self.byte_ids = [vocab.ids[bytes([b])] for b in range(256)]
        self.ranks_of = dict(zip(vocab.merge_keys.tolist(), vocab.merge_ranks.tolist(), strict=True))
        self.made_by = [made for _, made in vocab.merges.values()]
        self.exact_words = 0

    def _edges(self, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token, what lies on its edge from outside in, and the rank that takes it up."""
        made = self.vocab.made
        level, up = np.arange(self.vocab.size), np.full(self.vocab.size, NEVER)
        tokens, ranks = [], []
        while (level >= 0).any():
            tokens.append(level)
            ranks.append(up)
            below = np.where(level >= 0, child[level], -1)
            up = np.where(below >= 0, made[level], -1)
            level = below
        tokens_of, ranks_of = np.stack(tokens, axis=1), np.stack(ranks, axis=1)
        return tokens_of, ranks_of, (tokens_of >= 0).sum(axis=1)

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of merging ``x`` and ``y``, NEVER if there is none."""
        key = x * self.vocab.size + y
        at = np.minimum(np.searchsorted(self.vocab.merge_keys, key), len(self.vocab.merge_keys) - 1)
        return np.where(self.vocab.merge_keys[at] == key, self.vocab.merge_ranks[at], NEVER)

    def _clash(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether a merge across the border of ``a`` and ``b`` comes before rank ``until``."""
        right, right_up, right_n = self.right_edge
        left, left_up, left_n = self.left_edge
        bad = np.zeros(len(a), dtype=bool)
        for i in range(int(right_n[a].max(initial=0))):
            for j in range(int(left_n[b].max(initial=0))):
                some = np.nonzero((right_n[a] > i) & (left_n[b] > j) & ~bad)[0]
                if not len(some):
                    continue
                one, two, end = a[some], b[some], until[some]
                rank = self._rank(right[one, i], left[two, j])
                bad[some] = (rank < np.minimum(right_up[one, i], end)) & (rank <= np.minimum(left_up[two, j], end))
        return bad

    def _whole(self) -> np.ndarray:
        """Tokens that the merges make of their own bytes."""
        vocab = self.vocab
        whole = np.zeros(vocab.size, dtype=bool)
        whole[[number for token, number in vocab.ids.items() if len(token) == 1]] = True
        merged = np.nonzero(vocab.made >= 0)[0]
        clash = np.zeros(vocab.size, dtype=bool)
        clash[merged] = self._clash(vocab.left[merged], vocab.right[merged], vocab.made[merged])
        for token in merged[np.argsort(vocab.made[merged])]:
            whole[token] = whole[vocab.left[token]] and whole[vocab.right[token]] and not clash[token]
        return whole

    def propose(self, word: bytes) -> list[int]:
        ids = self.vocab.ids
        if word in ids:
            return [ids[word]]
        longest = self.vocab.longest
        out, at, end = [], 0, len(word)
        while at < end:
            stop = min(end, at + longest.get(word[at : at + 4], 3))
            while (token := ids.get(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def merge(self, word: bytes) -> list[int]:
        """The merges themselves, lowest rank first and leftmost among equals."""
        if len(word) > SHORT:
            return self._merge_long(word)
        size, ranks_of, made = self.vocab.size, self.ranks_of, self.made_by
        token = [self.byte_ids[b] for b in word]
        ranks = [ranks_of.get(a * size + b, NEVER) for a, b in zip(token, token[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == NEVER:
                break
            i = ranks.index(rank)
            token[i] = made[rank]
            del token[i + 1], ranks[i]
            if i:
                ranks[i - 1] = ranks_of.get(token[i - 1] * size + token[i], NEVER)
            if i < len(ranks):
                ranks[i] = ranks_of.get(token[i] * size + token[i + 1], NEVER)
        return token

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, in time n log n."""
        merges, ids = self.vocab.merges, self.vocab.ids
        token = [ids[word[i : i + 1]] for i in range(len(word))]
        after = [*range(1, len(token)), -1]
        before = [-1, *range(len(token) - 1)]
        heap = [(*merges[pair], i, pair) for i, pair in enumerate(zip(token, token[1:], strict=False)) if pair in merges]
        heapq.heapify(heap)
        while heap:
            _, made, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (token[i], token[j]) != pair:
                continue
            token[i], token[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for one in (before[i], i):
                if one >= 0 and after[one] >= 0:
                    pair = token[one], token[after[one]]
                    if pair in merges:
                        heapq.heappush(heap, (*merges[pair], one, pair))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        data = [w.encode("utf-8") for w in words]
        proposed = [self.propose(w) for w in data]
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad_word = np.zeros(len(words), dtype=bool)
        bad_word[owner[~self.whole[flat]]] = True
        beside = np.nonzero(owner[1:] == owner[:-1])[0]
        pairs, back = np.unique(flat[beside] * self.vocab.size + flat[beside + 1], return_inverse=True)
        a, b = pairs // self.vocab.size, pairs % self.vocab.size
        bad_word[owner[beside[self._clash(a, b, np.full(len(a), NEVER))[back]]]] = True
        self.exact_words += int(bad_word.sum())
        packed = flat.astype("<u4")
        ends = np.cumsum(sizes)
        out = [packed[end - n : end].tobytes() for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        for i in np.nonzero(bad_word)[0]:
            out[i] = np.array(self.merge(data[i]), dtype="<u4").tobytes()
        return out


_CACHES: dict[str, PieceCache] = {}


def encoder(path: str) -> PieceCache:
    """The encoder of this Python worker for one vocabulary file."""
    if path not in _CACHES:
        vocab = vocabulary(path)
        _CACHES[path] = PieceCache(vocab.added_pattern, vocab.added, SpeculativeEncoder(vocab).encode_words)
    return _CACHES[path]


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of token ids; bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(vocab.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_documents(rows: DataFrame, key: str, text: str, path: str, *, batch_ids: int = IDS) -> DataFrame:
    """``(key, ids)``: each whole text's token ids, an array of ints; a null or empty text has none.

    Rows are independent: repeated keys and texts give a row each, and an empty table none. Ids
    leave in batches of some megabytes, or of one text, however long the texts of a partition are. The vocabulary file must be at ``path`` on every executor.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, start, held, n = batch.column(0), 0, [], 0
            for number, ids in enumerate(encoder(path).encode(batch.column(1))):
                held.append(ids)
                n += len(ids)
                if n >= batch_ids:
                    yield listed(keys.slice(start, len(held)), held)
                    start, held, n = number + 1, [], 0
            if held:
                yield listed(keys.slice(start, len(held)), held)

    def listed(keys: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, held)])
        flat = np.concatenate(held).view(np.int32)  # ids are far below 2**31
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[key, "ids"])

    return rows.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")


def round_trip(rows: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: encode, decode the ids, and hash both.

    Null and empty texts have no tokens and the hash of no bytes. Rows are independent, so
    copies and repeated keys give equal rows.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches(source, ROWS):
            counts, ids_hash, text_hash = [], [], []
            for ids in encoder(path).encode(batch.column(1)):
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back = decode(ids, vocab)
                text_hash.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key), F.col(text)).mapInArrow(
        run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
