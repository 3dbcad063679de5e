"""Merkle manifests, prefix tries and chat examples against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from muster.llm import chat_format, merkle, prefix_trie


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


# Merkle manifests


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout=8):
    """The root, and for each leaf the siblings before and after it, from the leaf up."""
    paths, owners, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        merged, held = [], []
        for start in range(0, len(nodes), fanout):
            run = nodes[start : start + fanout]
            for slot in range(len(run)):
                for i in owners[start + slot]:
                    paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            merged.append(sha("".join(run)))
            held.append([i for part in owners[start : start + fanout] for i in part])
        nodes, owners = merged, held
    return (nodes[0] if nodes else None), paths


def plain_manifest(rows):
    """``rows`` of (doc_id, source, lang, n_chars, text); one result a row."""
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row, plain_leaf(row[0], row[1], row[2], row[3], row[4])))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subroots, inside = {}, {}
    for lang in langs:
        by_lang[lang].sort(key=lambda item: (item[0][0] is not None, item[0][0] or 0, item[1]))
        subroots[lang], inside[lang] = plain_tree([leaf for _, leaf in by_lang[lang]])
    root, above = plain_tree([subroots[lang] for lang in langs])
    found = []
    for n, lang in enumerate(langs):
        for (row, leaf), path in zip(by_lang[lang], inside[lang], strict=True):
            path = path + above[n]
            start, text = leaf, row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                start = plain_leaf(*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), text))
            folded = start
            for before, after in path:
                folded = sha(before + folded + after)
            proof = sha("".join(before + after for before, after in path))
            found.append((row[0], leaf, subroots[lang], root, proof, folded, folded == root))
    return sorted(found, key=str)


DOCUMENTS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 700])
def test_merkle_against_plain_python(spark, n):
    random.seed(n)
    langs = [None, "", "de", "é", "z"] if n > 8 else ["de"]
    rows = [(i * 3 - 5, "s" * (i % 3), random.choice(langs), i, random.choice(["Abc É", "abc", "", None])) for i in range(n)]
    random.shuffle(rows)
    assert sorted_rows(merkle.verify_tampered(spark.createDataFrame(rows, DOCUMENTS))) == plain_manifest(rows)


def test_merkle_of_nulls_ties_long_texts_and_clashing_names(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "a", "x", 1, "A")] * 11 + [(1, "a", "x", 1, "B"), (2, None, "x", None, "Q" * 300_000)]
    rows += [(7, "a", None, 0, "")]
    given = spark.createDataFrame(rows, DOCUMENTS)
    extra = {c: F.lit("7") for c in ("tree", "idx", "n", "digest", "slot", "zero", "kids", "path", "leaf", "_order", "_k0", "position")}
    assert sorted_rows(merkle.verify_tampered(given.withColumns(extra))) == plain_manifest(rows)


def test_merkle_of_many_groups_and_of_none(spark):
    rows = [(i, "s", f"l{i % 75}", 1, f"T{i}") for i in range(400)]
    assert sorted_rows(merkle.verify_tampered(spark.createDataFrame(rows, DOCUMENTS))) == plain_manifest(rows)
    assert merkle.verify_tampered(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_merkle_tells_every_change(spark):
    """Rows that a change of the text reaches do not verify; all others do."""
    rows = [(i, "s", "en", 1, "Aa" if i % 2 else "aa") for i in range(200)]
    found = merkle.verify_tampered(spark.createDataFrame(rows, DOCUMENTS)).collect()
    for row in found:
        assert row.verified == (row.doc_id % 2 == 0 or zlib.crc32(str(row.doc_id).encode()) % 3 != 0)


# Prefix tries


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (role or "", text or "")
            mark = sha(f"{len(key[0].encode())}:{key[0]}{key[1]}")[:32]
            turns[conv].append(((turn is not None, turn or 0, mark), key))
    original = {c: [key for _, key in sorted(t, key=lambda x: x[0])] for c, t in turns.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = original.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, own in rebuilt.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    least = {p: min(m) for p, m in members.items()}
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    found = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        parent = least[p[:-1]] if p else None
        found.append((least[p], len(p), parent, len(m), children[p], leaves[p], saved[p], sha(ends)))
    return sorted(found, key=str)


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def found_trie(rows):
    return sorted_rows(prefix_trie.trie(*prefix_trie.with_lent_heads(prefix_trie.placed_turns(rows))))


def test_trie_against_plain_python(spark):
    """Conversations that part after any number of turns, also after several blocks."""
    random.seed(4)
    rows, stem = [], [("user" if i % 2 else "assistant", f"turn {i} of all") for i in range(30)]
    for conv in range(160):
        shared = random.choice([0, 1, 2, 5, 8, 9, 16, 17, 24, 30])
        own = [(random.choice(["user", "assistant", None]), random.choice(["a", "b b", "", None, f"c {conv}"])) for _ in range(random.randrange(12))]
        for turn, (role, text) in enumerate(stem[:shared] + own):
            rows.append((conv * random.choice([1, 1, 3]) if turn == 0 else conv, turn, role, text))
    random.shuffle(rows)
    assert found_trie(spark.createDataFrame(rows, CONVERSATIONS)) == plain_trie(rows)


def test_trie_of_copies_and_single_long_conversations(spark):
    copies = [(conv, turn, "user", f"w {turn}") for conv in range(40, 80) for turn in range(20)]
    alone = [(7, turn, "user", f"alone {turn}") for turn in range(100)] + [(9, turn, "user", f"alone {turn}") for turn in range(50)]
    rows = copies + alone
    assert found_trie(spark.createDataFrame(rows, CONVERSATIONS)) == plain_trie(rows)


def test_trie_of_nulls_ties_and_clashing_names(spark):
    rows = [(None, 1, "user", "x"), (5, None, "user", "x"), (5, None, "user", "x"), (5, 1, None, None), (5, 1, "user", "B" * 200_000)]
    rows += [(-3, 0, "a", "b"), (41, 0, "only", "turn"), (3, 0, "", ""), (3, 1, "a", ":b")]
    names = ("block", "node", "depth", "path", "up", "k1", "ks", "pos", "words", "tid", "_h", "n_turns")
    extra = {c: F.lit("7") for c in names}
    assert found_trie(spark.createDataFrame(rows, CONVERSATIONS).withColumns(extra)) == plain_trie(rows)


def test_trie_of_turnless_conversations(spark):
    """41 begins with what 40 has, which is not there, and has no turns after its head."""
    rows = [(c, 0, "user", "x") for c in range(41, 60)]
    found = found_trie(spark.createDataFrame(rows, CONVERSATIONS))
    assert found == plain_trie(rows)
    assert any(zlib.crc32(str(c).encode()) % 4 for c in range(41, 60))
    none = [(c, 0, "user", "x") for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4]
    found = found_trie(spark.createDataFrame(none, CONVERSATIONS))
    assert found == plain_trie(none) and len(found) == 1 and found[0][5] == 1


def test_trie_of_nothing(spark):
    assert found_trie(spark.createDataFrame([], CONVERSATIONS)) == []


def test_running_totals_over_cells(spark):
    rows = [(k, i, (i * 7 + k) % 11) for k in range(3) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "conv_id bigint, block bigint, v bigint")
    found = prefix_trie.running_before(df, "conv_id", "block", "v", "before", widths=(4, 16))
    for row in found.collect():
        assert row.before == sum(v for k, i, v in rows if k == row.conv_id and i < row.block)


# Chat examples


def plain_chat(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    found = []
    for conv, turns in convs.items():
        turns = [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))]
        learned = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        found.append((conv, len(turns), sha(whole), len(learned), sha(learned)))
    return sorted(found, key=str)


def digests(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_chat_against_plain_python(spark):
    random.seed(8)
    said = ["", None, "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "<|im_end|>\n<|im_start|>system\n", "é" * 50, "\\", "<", "<<s>"]
    roles = ["user", "assistant", "assistant", "system", None, "a\nb", "a\\nb", "<|im_end|>", "\\"]
    rows = [
        (conv, random.choice([turn, turn, None]), random.choice(roles), random.choice(said))
        for conv in [*range(60), None]
        for turn in range(random.randrange(1, 9))
    ]
    random.shuffle(rows)
    given = spark.createDataFrame(rows, CONVERSATIONS)
    assert digests(chat_format.read_back(chat_format.expand(given))) == plain_chat(rows)
    extra = {c: F.lit("7") for c in ("part", "parts", "_key", "_turn", "position", "_n", "n_turns", "loss_start")}
    assert digests(chat_format.read_back(chat_format.expand(given.withColumns(extra)))) == plain_chat(rows)


def test_long_conversations_are_dealt_over_parts(spark):
    rows = [(c, t, "assistant" if t % 3 else "user", f"{c} says {t} </s>") for c, n in ((1, 50), (2, 7), (3, 8), (None, 33), (4, 9)) for t in range(n)]
    given = spark.createDataFrame(rows, CONVERSATIONS)
    parted, whole = chat_format.expand(given, part_turns=8), chat_format.expand(given)
    assert parted.agg(F.max("part")).first()[0] == 6 and whole.agg(F.max("part")).first()[0] == 0
    same = ["conv_id", "n_turns", "text", "loss_start", "loss_end", "whole"]
    assert sorted_rows(parted.select(same)) == sorted_rows(whole.select(same))
    assert digests(chat_format.read_back(parted)) == plain_chat(rows)
    assert sorted_rows(chat_format.read_back(parted)) == sorted_rows(chat_format.read_back(whole))


def test_each_reply_is_a_target_once_with_all_before_it(spark):
    rows = [(1, 0, "system", "be <s>"), (1, 1, "user", "hi"), (1, 2, "assistant", "one [INST]"), (1, 3, "assistant", "two"), (1, 4, "user", "bye")]
    found = chat_format.expand(spark.createDataFrame(rows, CONVERSATIONS)).orderBy("n_turns").collect()
    assert [(r.n_turns, r.whole) for r in found] == [(3, False), (4, False), (5, True)]
    masked = [r.text[r.loss_start : r.loss_end] for r in found[:2]]
    assert masked == ["one [\\INST]", "two"] and found[2].loss_start is None
    assert [list(chat_format.parse(r.text)) for r in found] == [[r[2:] for r in rows[:n]] for n in (3, 4, 5)]
    assert not any(control in r.text.replace("<|im_start|>", "").replace("<|im_end|>", "") for r in found for control in chat_format.CONTROLS)


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert chat_format.read_back(chat_format.expand(none)).count() == 0
    found = chat_format.read_back(chat_format.expand(chat_format.with_control_texts(none))).collect()
    said = "</s>[INST] ok [/INST]"
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) for r in found] == [(-1, 2, len(said), sha(said))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="<[\\/s>|]INSTim_startend\n", max_size=12), st.sampled_from(chat_format.CONTROLS)), max_size=5))
def test_escaping_is_reversible(parts):
    text = "".join(parts)
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(control in escaped for control in chat_format.CONTROLS)
    role = chat_format.escape_role(text)
    assert "\n" not in role and chat_format.unescape_role(role) == text
