"""Near-copies of texts and vectors against all pairs, and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from muster.llm import cap_filters, components, line_dedup, mixing, simhash, toxicity
from muster.llm.queries import queries, vocabulary_path


def united(ids, pairs):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def near_pairs(fps):
    keys = list(fps)
    bits = np.array([fps[k] for k in keys], dtype=np.uint64)
    left, right = np.nonzero(np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3, 1))
    return [(keys[a], keys[b]) for a, b in zip(left, right, strict=True)]


def test_components(spark):
    random.seed(3)
    pairs = [(random.randrange(900), random.randrange(900)) for _ in range(500)] + [(1000 + i, 1001 + i) for i in range(60)]
    pairs += [(2000, 2000 + i) for i in range(200)]
    ids = {i for p in pairs for i in p}
    found = components.components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    got = {r.node: r.root for r in found.collect()}
    want = united(ids, pairs)
    assert all(got.get(i, i) == want[i] for i in ids)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_over_documents(spark, sf_dir):
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {k: plain_fingerprint(t) for k, t in given.items()}
    want = united(fps, near_pairs(fps))
    found = queries()["op8_simhash_pivots"](spark, sf_dir).collect()
    assert len(found) == len(given)
    assert all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id]) for r in found)


@pytest.mark.parametrize("part_rows", [8192, 5])
def test_pivots_lose_no_link(spark, part_rows):
    """Chains of fingerprints with 1 to 4 changed bits, and one crowded cell."""
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(60):
        value = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(4):
            fps.add(value)
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                value ^= 1 << int(bit)
    fps |= {(0xABCDEF << 40) | int(low) for low in rng.integers(0, 1 << 16, 60)}
    signed = {f: f - (1 << 64) if f >= 1 << 63 else f for f in fps}
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed.values()], "fp bigint"), part_rows=part_rows)
    back = {s: f for f, s in signed.items()}
    got = united(fps, [(back[r.a], back[r.b]) for r in links.collect()])
    assert got == united(fps, near_pairs({f: f for f in fps}))


def test_simhash_edges(spark):
    rows = [(None, None), (4, ""), (7, " \n"), (2, "one"), (2, "one"), (9, "ONE"), (5, "a b"), (6, "long " * 400000), (None, "one")]
    table = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id bigint, text string, fp int, id string")
    found = simhash.near_classes(table, "doc_id", "text").collect()
    assert Counter((r.id, r.component_id) for r in found) == Counter(
        {(None, 4): 1, (4, 4): 1, (7, 4): 1, (2, 2): 2, (9, 2): 1, (5, 5): 1, (6, 6): 1, (None, 2): 1}
    )
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 2, 4, 5, 6]
    empty = spark.createDataFrame([], table.schema)
    assert simhash.near_classes(empty, "doc_id", "text").count() == 0 and simhash.keep_one(empty).count() == 0


def test_each_row_is_kept_or_not_by_its_own_text(spark):
    """Two texts under one id: the one that nothing is near stays, the copy of another row goes."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, two, None), (5, one, "x"), (5, two, "x"), (9, one, "x"), (9, one, "x"), (8, "c d e f", None), (8, "c d e f", None), (8, "c d e f", "y")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = [tuple(r) for r in simhash.keep_one(table).collect()]
    assert sorted(r[:2] for r in found) == [(3, two), (5, one), (8, "c d e f")]


# Vectors


def near_vectors(dim=64):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((300, dim))
    rows = list(base)
    for scale in (0.05, 0.2, 0.4, 0.48, 0.5, 0.6):  # cosines on both sides of 0.9
        rows += list(base[:60] + scale * np.linalg.norm(base[:60], axis=1, keepdims=True) / dim**0.5 * rng.standard_normal((60, dim)))
    rows += list(base[0] + 0.02 * rng.standard_normal((120, dim)))  # one crowded place
    rows += [base[5]] * 30 + [base[6] * 7.0, -base[7]]
    return [r.astype(np.float32).tolist() for r in rows]


def plain_links(vectors):
    x = np.array(vectors, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    return linked


@pytest.mark.parametrize("part_rows", [cap_filters.PART_ROWS, 20])
def test_cap_filters_against_all_pairs(spark, part_rows, monkeypatch):
    monkeypatch.setattr(cap_filters, "PART_ROWS", part_rows)
    vectors = near_vectors()
    linked = plain_links(vectors)
    want = united(range(len(vectors)), zip(*np.nonzero(np.triu(linked)), strict=True))
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int")
    found = {r.id: r for r in cap_filters.near_classes(table, "vec_id", "embedding").collect()}
    assert {i: r.n_links for i, r in found.items()} == dict(enumerate(linked.sum(axis=1).tolist()))
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in found.items())


def test_cap_filters_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
        (8, [1.0, 0.1]), (8, [1.0, 0.1]), (9, [1.0, 0.1, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-30, 0.0]), (12, [3e38, -0.0]),
    ]
    table = spark.createDataFrame([(i, v, "k", 1) for i, v in rows], "vec_id bigint, embedding array<double>, key string, cid int")
    found = Counter((r.id, r.n_links, r.component_id, r.kept) for r in cap_filters.near_classes(table, "vec_id", "embedding").collect())
    alone = {(i, 0, i, True): 1 for i in (1, 2, 3, 4, 5, 6, 9, 10)}
    assert found == Counter(alone | {(7, 5, 7, True): 1, (8, 5, 7, False): 2, (None, 5, 7, False): 1, (11, 5, 7, False): 1, (12, 5, 7, False): 1})
    assert cap_filters.near_classes(spark.createDataFrame([], table.schema), "vec_id", "embedding").count() == 0


def test_every_vector_has_filters():
    x = np.random.default_rng(2).standard_normal((500, 64))
    owner, cell = cap_filters.decode(cap_filters.sketch(x), 256)
    assert np.bincount(owner, minlength=500).min() >= cap_filters.CODES * cap_filters.LEAST
    again = [cap_filters.decode(cap_filters.sketch(x[i : i + 1]), 256)[1] for i in range(20)]
    assert all((cell[owner == i] == a).all() for i, a in enumerate(again))


# The pipeline


def test_pipeline_against_plain_python(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.learn(given, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    docs = [r.asDict() for r in given.collect()]
    docs = [d for d in docs if scorer.score(d["text"]) < 0.5]

    pages, on = Counter(d["source"] for d in docs), Counter()
    for d in docs:
        on.update({(d["source"], x.strip(" ")) for x in d["text"].split("\n") if x.strip(" ")})
    for d in docs:
        boiler = lambda x, s=d["source"]: on[s, x] >= line_dedup.MIN_PAGES and on[s, x] > pages[s] * line_dedup.RATIO
        d["text"] = "\n".join(x for x in d["text"].split("\n") if not x.strip(" ") or not boiler(x.strip(" ")))

    fps = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    roots = united(fps, near_pairs(fps))
    docs = [d for d in docs if roots[d["doc_id"]] == d["doc_id"]]

    by_source = defaultdict(list)
    for d in docs:
        d["size"] = len(re.findall(r"[^\x20\x09-\x0D]+", d["text"]))
        by_source[d["source"]].append(d)
    sizes = {s: sum(d["size"] for d in ds) for s, ds in by_source.items()}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    capped = set()
    while True:
        share = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in sizes if weights[s] * share > 3 * sizes[s]}
        if more == capped:
            break
        capped = more
    want = Counter()
    tokenizer = Tokenizer.from_file(vocabulary_path())
    for s, ds in by_source.items():
        target = 3.0 * sizes[s] if s in capped else weights[s] * share
        step = int(target / sizes[s] * mixing.UNIT) if sizes[s] else 0
        place = int(hashlib.md5(f"0:s{s}".encode()).hexdigest()[:12], 16) % mixing.UNIT
        for d in sorted(ds, key=lambda d: (d["size"], d["doc_id"])):
            times = (place + step) // mixing.UNIT - place // mixing.UNIT
            place += step
            if times:
                want[d["doc_id"], tuple(tokenizer.encode(d["text"], add_special_tokens=False).ids)] += times
    found = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, tuple(r.ids)) for r in found.collect()) == want


def test_copied_documents_keep_their_lines(spark):
    words = lambda n: "\n".join(" ".join(f"{n}w{i}.{j}" for j in range(30)) for i in range(3))
    texts = [f"menu\n{words('a')}"] * 20 + [f"menu\n{words('b')}"] * 6 + [f"menu\n{words(f'own{i}')}" for i in range(9)]
    rows = [(i, t, "en", "site", len(t)) for i, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    cut = corpus_pipeline.drop_lines(spark, given, "")
    assert all(r.text == texts[r.doc_id].removeprefix("menu\n") for r in cut.collect())
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_near_copies(spark, cut, "").collect()}
    assert kept[0] == words("a") and kept[20] == words("b") and len(kept) == 11


def test_stages_take_nulls_and_extra_columns(spark, sf_dir):
    rows = [(1, None, None, None, None, 1), (None, "", "en", "a", 0, 1), (2, "x y", "en", "a", 3, 1), (2, "x y", "en", "a", 3, 1), (None, "z", None, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int")
    for docs in (docs, spark.createDataFrame([], docs.schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "bpe":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert docs.count() >= 0
