"""BPE and token files against the tokenizers library, and language-model scores against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tempfile
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster import shared
from muster.llm import bpe, katz, pretokens, token_shards
from muster.llm.queries import vocabulary_path

DOCS = "doc_id bigint, text string, key string, ids string, held_out boolean"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def texts():
    random.seed(7)
    letters = "abcdeinorst  \n'AZ09.,!$#éßñ日本  ²½\x1c\tا́😀"
    tokens = [b.decode("utf-8", "ignore") for b in bpe.vocabulary(vocabulary_path()).bytes_of]
    found = ["".join(random.choices(letters, k=random.randint(0, 120))) for _ in range(600)]
    found += ["".join(random.choices(tokens, k=random.randint(1, 12))) for _ in range(3000)]
    found += ["a" * n for n in range(1, 90, 7)] + ["<|endoftext|>a <|endoftext|>  b", " lead", "trail ", "\n \n x", "they'll we've"]
    return [*found, " $$$ \n $x", "word$$$ x$$$", " 12a", "x" * 5000, "ab " * 3000, "", None]


def test_speculation_gives_what_the_merges_give(library):
    given = texts()
    found = list(bpe.encoder(vocabulary_path()).encode(pa.array(given)))
    vocab = bpe.vocabulary(vocabulary_path())
    for text, ids in zip(given, found, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert bpe.decode(ids, vocab) == library.decode(want, skip_special_tokens=False)


def test_only_failing_words_are_merged():
    encoder = bpe.SpeculativeEncoder(bpe.vocabulary(vocabulary_path()))
    encoder.encode_words([" the", " house", " running", "x"])
    assert encoder.exact_words == 0
    long = "abcde" * 40
    assert encoder.merge(long.encode()) == encoder._merge_long(long.encode())


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", "i", False) for i, t in rows], DOCS)


EDGES = [(3, ""), (1, None), (None, "null id"), (2, "same"), (2, "same"), (2, "other text"), (9, "w " * 30000), (5, "é 日本")]


def test_round_trip_table(spark, library):
    found = bpe.round_trip(docs(spark, EDGES), "doc_id", "text", vocabulary_path()).collect()
    want = Counter()
    for i, text in EDGES:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, found)) == want
    assert bpe.round_trip(docs(spark, []), "doc_id", "text", vocabulary_path()).count() == 0
    rows = bpe.encode_documents(docs(spark, EDGES), "doc_id", "text", vocabulary_path()).collect()
    assert sum(len(r.ids) for r in rows) == sum(n * k[1] for k, n in want.items())


def test_ids_of_long_texts_leave_in_slices(spark, library, monkeypatch):
    """Batches and caches are bounded by bytes: all long texts, and a cache that is emptied all the time."""
    texts = [f"word{i} and more of {i * 7} " * (3000 + i) for i in range(12)] + ["", None, "x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = bpe.encode_documents(docs(spark, rows).coalesce(1), "doc_id", "text", vocabulary_path(), batch_ids=5000).collect()
    assert {r.doc_id: r.ids for r in found} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    cache = bpe.encoder(vocabulary_path())
    monkeypatch.setattr(pretokens, "REMEMBERED_BYTES", 1)
    for text in texts * 2:
        ids = next(iter(cache.encode(pa.array([text], pa.string()))))
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


class Counting:
    """The tokenizers library, and how many characters it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode(self, words, **options):
        self.given += sum(map(len, words))
        return self.inner.encode(words, **options)

    def encode_batch_fast(self, some, **options):
        self.given += sum(map(len, some))
        return self.inner.encode_batch_fast(some, **options)


def counted(monkeypatch):
    """The encoder of op10_token_shards with a library that counts."""
    counting = Counting(Tokenizer.from_file(vocabulary_path()))
    monkeypatch.setattr("tokenizers.Tokenizer", type("Tokenizer", (), {"from_file": staticmethod(lambda path: counting)}))
    return token_shards.library_encoder.__wrapped__(vocabulary_path()), counting


def test_shard_encoder_asks_for_new_words_only(library, monkeypatch):
    """Frequent words are asked for once, with whatever marks and also when what is remembered is full again and again."""
    monkeypatch.setattr(pretokens, "REMEMBERED_BYTES", 400_000)
    monkeypatch.setattr(pretokens, "SLICE_BYTES", 1)  # each text by itself
    random.seed(3)
    word = lambda: "".join(random.choices("abcdeinorst", k=12))
    frequent = [word() for _ in range(500)]
    texts = []
    for _ in range(20):
        new = [word() for _ in range(200)]
        texts.append("x " + " ".join(w + random.choice(["", ",", ".", ");", ".\n" + random.choice(frequent)]) for w in frequent + new))
    encoder, counting = counted(monkeypatch)
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    once = 13 * (2 * len(frequent) + 200 * len(texts))  # after a space, and after a line end
    assert counting.given < 1.2 * once
    assert encoder.held <= 400_000


@pytest.mark.parametrize(("remembered", "text_bytes"), [(96 << 20, 8 << 20), (96 << 20, 2000), (1, 1), (20_000, 500)])
def test_shard_encoder_of_any_text(library, monkeypatch, remembered, text_bytes):
    monkeypatch.setattr(pretokens, "REMEMBERED_BYTES", remembered)
    monkeypatch.setattr(pretokens, "SLICE_BYTES", text_bytes)
    random.seed(8)
    parts = ["word", "Ünd", "été", "дом", "日本語", "ǅ", "ª", "µ", "x\u0301", "12", "it's", "'s", "<|", "<|endoftext|>", "…", "\u00a0", "\u2028", "\x85", "\x1f", "\r\n", "\t"]
    parts += [" ", " ", " ", " ", " ", "  ", "\n", "\n", "\n\n", ".", ",", "!?", "_", "$+=", "'", "z" * 70, "'" * 70, "𝒳", "א", "한글"]
    given = [*random.sample(texts(), 300), *texts()[-18:], *("".join(random.choices(parts, k=random.randint(1, 30))) for _ in range(500))]
    given += [" ".join(random.choices(["a", "b.", "c,\nd", "e;\nf\nG", "h\n.", "\ni", "j\n"], k=8)) for _ in range(500)]
    encoder = token_shards.library_encoder.__wrapped__(vocabulary_path())
    for _ in range(2):
        for text, ids in zip(given, encoder.encode(pa.array(given)), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert [list(ids) for ids in encoder.encode(pa.array(["", None, " "]))] == [[], [], [220]]
    assert not list(encoder.encode(pa.array([], pa.string())))


def test_shards(spark, library):
    table = docs(spark, EDGES + [(100 + i, f"text {i} of many") for i in range(300)]).repartition(5)
    files, folder, dictionary = token_shards.write_shards(table, "doc_id", "text", vocabulary_path())
    found = token_shards.read_shards(files, folder, dictionary).collect()
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in found), key=lambda k: (k is not None, k))
    assert [r.start for r in found] == list(np.cumsum([0, *(r.n_tokens for r in found)])[:-1])
    want = Counter()
    for row in table.collect():
        ids = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[row.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    first = files.orderBy("shard").first()
    shard = token_shards.ShardReader(folder, first["name"], dictionary)
    last = shard.count - 1
    assert len(shard.ids(last)) == shard.counts[last]
    with pytest.raises(ValueError, match="another dictionary"):
        token_shards.ShardReader(folder, first["name"], dictionary + b"x")


def test_shards_of_nothing(spark):
    found = token_shards.write_shards(docs(spark, []), "doc_id", "text", vocabulary_path())
    assert found[0].count() == 0 and token_shards.read_shards(*found).count() == 0


# Language model


def plain_katz(rows):
    tokens = [(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None], out) for _, t, out in rows]
    uni, pairs, after = Counter(), Counter(), Counter()
    for words, out in tokens:
        for v, w in zip(["<start>", *(("w", x) for x in words)], words, strict=False):
            if not out:
                uni[w] += 1
                pairs[v, w] += 1
                after[v] += 1
    n, types = sum(uni.values()), len(uni)
    levels = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.DISCOUNTED + 2)]
    cut = lambda d, c: (d[c - 1] if c <= katz.DISCOUNTED else 1) * c
    d1, d2 = katz.discounts(levels(uni)), katz.discounts(levels(pairs))
    single = {w: cut(d1, c) / (n + 1) for w, c in uni.items()}
    unknown = 1 - sum(single.values())
    seen = defaultdict(dict)
    for (v, w), c in pairs.items():
        seen[v][w] = cut(d2, c) / (after[v] + 1)
    left = {v: (1 - sum(p.values())) / (1 - sum(single[w] for w in p)) for v, p in seen.items()}
    for v in list(seen)[:40]:  # exactly normalised
        total = sum(seen[v].get(w, left[v] * single[w]) for w in single) + left[v] * unknown
        assert abs(total - 1) < 1e-9
    out = Counter()
    for (key, _, held), (words, _) in zip(rows, tokens, strict=True):
        score = base = known = 0
        for v, w in zip(["<start>", *(("w", x) for x in words)], words, strict=False):
            c = uni.get(w, 0)
            known += c > 0
            base += math.log10((c + 1) / (n + types + 1))
            p = seen[v].get(w) or left[v] * single.get(w, unknown) if v in seen else single.get(w, unknown)
            score += math.log10(p)
        out[key, bool(held), len(words), known, n, round(base, 6), round(score, 6)] += 1
    return out


@pytest.mark.parametrize("share", [1e-4, 0.05])
def test_katz_against_plain_python(spark, sf_dir, share, monkeypatch):
    monkeypatch.setattr(katz, "HOT_SHARE", share)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 5000)
    monkeypatch.setattr(katz, "BUCKET_WORDS", 3000)
    monkeypatch.setattr(katz, "CHUNK_BYTES", 50_000)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, r.doc_id % 7 == 2) for r in given]
    rows += [(None, None, None), (-1, "", False), (-2, "never seen words", True), (-2, "never seen words", True), (-3, "The THE the " * 3000, False)]
    table = spark.createDataFrame(rows, "id bigint, text string, held_out boolean")
    found = katz.katz_scores(table, "id", "text", "held_out").collect()
    assert Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in found) == plain_katz(rows)


def test_katz_first_word_may_be_hot(spark, monkeypatch):
    """The first word of the first text has id 0; its backoff does not depend on the partitions of pairs."""
    random.seed(9)
    word = lambda: f"w{random.randrange(800)}"
    rows = [(i, " ".join(f"first {word()} {word()}" for _ in range(2)), i % 9 == 8) for i in range(900)]
    table = spark.createDataFrame(rows, "id bigint, text string, held_out boolean").coalesce(1)
    found = []
    for size in (katz.BUCKET_TOKENS, 700):
        monkeypatch.setattr(katz, "BUCKET_TOKENS", size)
        found.append({r.id: round(r.score, 6) for r in katz.katz_scores(table, "id", "text", "held_out").collect()})
    assert found[0] == found[1]


def words_at_random(n_docs, n_words):
    random.seed(3)
    return [(i, " ".join(f"w{int(random.paretovariate(0.6)) % 3000}" for _ in range(n_words)), i % 7 == 2) for i in range(n_docs)]


def test_katz_counts_do_not_grow_with_partitions(spark, monkeypatch):
    """What comes back for the documents is in proportion to their pairs, and the scores stay the same."""
    root = Path(shared._own_dir(spark).removeprefix("file:"))
    table = spark.createDataFrame(words_at_random(3000, 60), "id bigint, text string, held_out boolean").coalesce(2)
    sizes, scores = [], []
    for size in (1 << 30, 5000):
        monkeypatch.setattr(katz, "BUCKET_TOKENS", size)
        before = set(root.glob("katz-model-*"))
        scores.append({r.id: round(r.score, 6) for r in katz.katz_scores(table, "id", "text", "held_out").collect()})
        (model,) = set(root.glob("katz-model-*")) - before
        sizes.append(spark.read.parquet(str(model)).where("kind in ('documents', 'parts')").agg(F.sum(F.length("data"))).first()[0])
    assert scores[0] == scores[1]
    assert sizes[1] < 2 * sizes[0], sizes


def test_katz_leaves_the_model_and_the_scores(spark):
    """The tables of chunks and words, and the shuffle files, go with the run."""
    root = Path(shared._own_dir(spark).removeprefix("file:"))
    local = Path(spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir()))
    shuffles = lambda: set(local.glob("blockmgr-*/*/shuffle_*.data")) | set(local.glob("spark-*/**/blockmgr-*/*/shuffle_*.data"))
    table = spark.createDataFrame(words_at_random(50, 40), "id bigint, text string, held_out boolean")
    before, moved, setting = set(root.glob("*")), shuffles(), spark.conf.get(shared.SHUFFLES_END, None)
    found = katz.katz_scores(table, "id", "text", "held_out")
    left = {p.name.rsplit("-", 1)[0] for p in set(root.glob("*")) - before}
    assert left == {"katz-model", "katz-scores"}
    assert spark.conf.get(shared.SHUFFLES_END, None) == setting
    until = time.time() + 20
    while shuffles() - moved and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - moved
    assert found.count() == 50


def test_katz_without_training(spark):
    schema = "id bigint, text string, held_out boolean"
    assert katz.katz_scores(spark.createDataFrame([], schema), "id", "text", "held_out").count() == 0
    (row,) = katz.katz_scores(spark.createDataFrame([(1, "a b", True)], schema), "id", "text", "held_out").collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_katz_beats_the_unigram(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = given.select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out"))
    total = katz.katz_scores(rows, "doc_id", "text", "held_out").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_blocks():
    arrays = [np.arange(5, dtype=np.int64), np.empty(0, np.uint8), np.array([1.5, -2.0]), np.empty(0), np.array([7], np.uint32)]
    found = katz.unpack(katz.pack(*arrays))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, found, strict=True))
