"""Toxicity of texts that hide their words: noisy-channel restoring, then scoring.

A writer types a word through a channel that swaps letters for look-alikes, repeats them,
and puts spaces or marks between them. Each suspicious token is a lattice of what every
character may have been; Viterbi decoding under a character trigram model of the corpus
finds the likeliest word. Scores are of restored words.

The model is counted, not sampled: trigrams over the words of all documents, and for each
word and word beginning the labelled documents of either class that hold it, one of each
group of near copies.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import batches, stage
from muster.llm.near_copies import distinct_texts

FOLDS = 5
STEMS = (4, 5, 6)  # word beginnings that count as features
MIN_TOXIC = 4  # toxic documents a feature needs
CONFIDENCE = 3.0  # standard errors by which a feature's share is lowered
WEAKEST = 0.25  # how far a feature's share must lie from that of all documents towards 1
TELLING = 2  # words of a document that add up
MODEL_FEATURES = 20_000  # features kept, those with the most evidence: bounds what is broadcast
BROADCAST_LABELS = 1_000_000  # labels, of some 20 bytes, that are sent to every task
FLUSH = 300_000  # counters a task holds before it sends them on, and tokens it remembers
LONGEST = 40  # longer tokens are not remembered, and longer words are features by their hash

EDGE = 26
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# What a character may stand for, apart from itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "[": "c", "<": "c", "€": "e", "£": "l",
    "¡": "i", "×": "x", "¢": "c", "#": "h", "%": "x", "ß": "s",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k",
}
INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])  # zero-width characters, taken out
# Log-probabilities of the channel: another character, a mark put in, a letter repeated, words joined by a mark.
SWAP, DROP, REPEAT, BORDER = math.log(0.3), math.log(0.04), math.log(0.3), math.log(0.04)
# The same where there is a mark behind every letter, and where there is one more mark than between the others.
SPACED_DROP, SPACED_BORDER = math.log(0.8), math.log(0.04)
WIDE_DROP, WIDE_BORDER = math.log(0.1), math.log(0.9)

_SPACED = re.compile(r"(?<!\S)(?:\S[ ._*-]{1,2}){3,}\S(?!\S)")
_RUN = re.compile(r"(.)\1\1+")
_TAIL_RUN = re.compile(r"([^\w\s])\1\1+$")
_PUNCTUATION = ".,;:!?\"'()[]{}"


def fold(token: str) -> str:
    """Lower case without accents and zero-width characters."""
    if token.isascii():
        return token.lower()
    split = unicodedata.normalize("NFKD", token.lower().translate(INVISIBLE))
    return "".join([c for c in split if not unicodedata.combining(c)])


@dataclass
class CharacterModel:
    """Character trigrams with add-k smoothing through bigrams; the alphabet is a-z and EDGE."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros((27, 27, 27), dtype=np.int64))

    def __post_init__(self) -> None:
        one = self.counts.sum(axis=(0, 1)) + 1.0
        two = self.counts.sum(axis=0) + 5.0 * (one / one.sum())
        two /= two.sum(axis=1, keepdims=True)
        three = self.counts + 5.0 * two[None, :, :]
        self.log = np.log(three / three.sum(axis=2, keepdims=True)).tolist()

    def restore(self, token: str) -> list[str]:
        """The likeliest plain words behind ``token``, or ``[token]`` if it has none.

        States are the last two letters of the word so far. A character is itself, one of its look-alikes, or, in a run
        of three and more, a repetition of the letter before; a mark or space may also have been put in, or end a word. Time and
        memory grow with the length of the token.
        """
        log = self.log
        spaced = _SPACED.fullmatch(token) is not None
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        runs = {i for m in _RUN.finditer(token) for i in range(m.start() + 2, m.end() + 1)}
        for at, char in enumerate(token):
            options = [(char, 0.0)] if "a" <= char <= "z" else []
            options += [(letter, SWAP) for letter in LOOKALIKES.get(char, "")]
            droppable = not char.isalnum()
            wide = spaced and droppable and at > 0 and not token[at - 1].isalnum()
            drop, border = (WIDE_DROP, WIDE_BORDER) if wide else (SPACED_DROP, SPACED_BORDER) if spaced else (DROP, BORDER)
            repeated = at + 1 in runs
            if not options and not droppable:
                return [token]
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for letter, cost in options:
                    c = ord(letter) - 97
                    _better(following, (b, c), score + cost + log[a][b][c], (letter, path))
                    if b == c and repeated:
                        _better(following, (a, b), score + cost + REPEAT, path)
                if droppable:
                    _better(following, (a, b), score + drop, path)
                    if b != EDGE:
                        _better(following, (EDGE, EDGE), score + border + log[a][b][EDGE], (" ", path))
            states = following
        ends = [(score + (log[a][b][EDGE] if b != EDGE else 0.0), path) for (a, b), (score, path) in states.items()]
        _, path = max(ends, key=lambda end: end[0], default=(0.0, None))
        letters = []
        while path is not None:
            letter, path = path
            letters.append(letter)
        return "".join(reversed(letters)).split() or [token]


def _better(states: dict, key: tuple[int, int], score: float, path: tuple | None) -> None:
    held = states.get(key)
    if held is None or score > held[0]:
        states[key] = (score, path)


def words_of(text: str) -> set[str]:
    """The distinct tokens of a text, and its runs of single characters, with what is between them, as one token each."""
    lower = text.lower()
    found = set(lower.split())
    found.update(run for run in _SPACED.findall(lower) if len(set(run) - {" "}) > 2)
    return found


def _plain(token: str) -> str:
    """A folded token without punctuation around it and without a run of marks behind it."""
    bare = token.strip(_PUNCTUATION)
    if bare.isalpha():
        return bare
    return _TAIL_RUN.sub("", bare).rstrip(_PUNCTUATION)


def restored(token: str, model: CharacterModel) -> list[str]:
    """The words a token may be scored as: itself if it is plain, else what the channel hid."""
    token = fold(token)
    plain = _plain(token)
    if plain.isalpha():
        return [plain, *model.restore(plain)] if _RUN.search(plain) else [plain]
    hidden = token.rstrip(".,;:?\"')]}").lstrip("\"'")
    return model.restore(hidden) if any(c.isalnum() for c in hidden) else []


def features_of(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings of STEMS letters."""
    whole = word if len(word) <= LONGEST else hashlib.sha256(word.encode()).hexdigest()
    return [whole + "$", *[word[:n] for n in STEMS if len(word) >= n]]


def token_features(token: str, model: CharacterModel) -> set[str]:
    return {f for word in restored(token, model) for f in features_of(word)}


def held_out(doc_id: Column, fold_number: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold_number`` of FOLDS; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == fold_number, F.lit(False))


# Counting


def _trigrams(words: Counter) -> np.ndarray:
    """Trigram counts of the plain words of a counter, two edges before each and one after."""
    found: Counter = Counter()
    for token, n in words.items():
        word = _plain(fold(token))
        if word.isascii() and word.isalpha():
            found[word] += n
    if not found:
        return np.zeros(27**3, dtype=np.int64)
    edge = chr(ord("a") + EDGE)
    codes = np.frombuffer("".join([f"{edge}{edge}{w}{edge}" for w in found]).encode(), dtype=np.uint8).astype(np.int64) - ord("a")
    weights = np.repeat(list(found.values()), [len(w) + 3 for w in found])
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inside = (b != EDGE) | (c != EDGE)  # not the edges before a word
    return np.bincount(((a * 27 + b) * 27 + c)[inside], weights=weights[2:][inside], minlength=27**3).astype(np.int64)


def character_model(texts: DataFrame, text: str) -> CharacterModel:
    """Trigrams over the plain words of all texts. What reaches the driver is 27**3 counts at most."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(27**3, dtype=np.int64)
        words: Counter = Counter()
        for batch in batches(source):
            for value in batch.column(0).to_pylist():
                words.update(value.lower().split() if value else ())
                if len(words) > FLUSH:
                    counts += _trigrams(words)
                    words.clear()
        counts += _trigrams(words)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["at", "n"])

    found = texts.select(text).mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(27**3, dtype=np.int64)
    for at, n in found.collect():
        counts[at] = n
    return CharacterModel(counts.reshape(27, 27, 27))


@dataclass(frozen=True)
class ToxicityModel:
    characters: CharacterModel
    base: float  # of a document without any telling feature
    weights: dict[str, float]  # the share of toxic documents among those with a feature, from below



class Scorer:
    """Scores texts, remembering what tokens are worth."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.held: dict[str, float] = {}

    def token(self, token: str) -> float:
        weights = self.model.weights
        found = max([weights.get(f, 0.0) for f in token_features(token, self.model.characters)], default=0.0)
        if len(token) <= LONGEST:
            self.held[token] = found
        return found

    def score(self, text: str | None) -> float:
        """The probability of label 1: one minus the chance that every telling word misleads."""
        if len(self.held) > FLUSH:
            self.held.clear()
        tokens = words_of(text or "")
        known = list(map(self.held.get, tokens))
        if None in known:
            known = [self.token(t) if k is None else k for t, k in zip(tokens, known, strict=True)]
        clean = 1.0 - self.model.base
        for value in sorted([k for k in known if k], reverse=True)[:TELLING]:
            clean *= 1.0 - value
        return 1.0 - clean


def _feature_counts(labelled: DataFrame, characters: CharacterModel) -> DataFrame:
    """``(feature, toxic, clean)``: documents of each class with a feature, summed in each task first."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches(source):
            for value, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for token in words_of(value or ""):
                    features = known.get(token)
                    if features is None:
                        features = tuple(map(sys.intern, token_features(token, characters)))  # words share beginnings
                        if len(token) <= LONGEST:
                            known[token] = features
                    found.update(features)
                held[label].update(found)
                if len(known) > FLUSH:
                    known.clear()
                if len(held[0]) + len(held[1]) > FLUSH:
                    yield _counted(held)
                    held = (Counter(), Counter())
        yield _counted(held)

    rows = labelled.mapInArrow(run, "feature string, toxic bigint, clean bigint")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counted(held: tuple[Counter, Counter]) -> pa.RecordBatch:
    clean, toxic = held
    names = list(clean.keys() | toxic.keys())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.string()),
            pa.array([toxic[n] for n in names], pa.int64()),
            pa.array([clean[n] for n in names], pa.int64()),
        ],
        names=["feature", "toxic", "clean"],
    )


def _on_their_own(counted: DataFrame) -> DataFrame:
    """Take from each beginning the documents of its most frequent toxic continuation.

    So ``lose`` is not telling because ``loser`` is; a stem with many toxic endings stays.
    """
    counted = stage(counted.where(F.col("toxic") >= MIN_TOXIC), "features")
    word = F.col("feature").endswith("$")
    size = F.length("feature") - F.when(word, 1).otherwise(0)
    shorter = F.when(word & (size >= STEMS[0]), F.least(size, F.lit(STEMS[-1]))).when(~word & (size > STEMS[0]), size - 1)
    child = counted.select(F.substring("feature", F.lit(1), shorter).alias("feature"), "toxic", "clean").where("feature is not null")
    most = child.groupBy("feature").agg(F.max(F.struct("toxic", "clean")).alias("_most"))
    alone = [(F.col(c) - F.coalesce(F.col("_most")[c], F.lit(0))).alias(c) for c in ("toxic", "clean")]
    rest = counted.join(most, "feature", "left").select("feature", *alone)
    return rest.withColumn("clean", F.greatest("clean", F.lit(0)))


def _sent(labels: DataFrame) -> DataFrame:
    """Labels to be sent to all tasks if counted to be few; otherwise both sides of a join are dealt by id."""
    return F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels


def _unit(label: str, text: str) -> Column:
    return F.xxhash64(F.col(label), F.coalesce(text, F.lit("")))


def _without_copies(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, _unit, _toxic)``: the labelled texts, and one for all near copies with the same label.

    Counted one by one, copies would make any word of a copied toxic text look like an insult.
    Texts that only share words are no copies and all stay.
    """
    found = documents.select("doc_id", "text").join(_sent(known), "doc_id").select(
        "doc_id", _unit("_toxic", "text").alias("unit"), "_toxic", F.coalesce("text", F.lit("")).alias("text")
    )
    return stage(distinct_texts(found).withColumnRenamed("unit", "_unit"), "distinct-labels")


def _texts_of(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``(text, _toxic)`` of the texts in ``known``, each once."""
    rows = documents.select("doc_id", "text").join(_sent(known), "doc_id").where(_unit("_toxic", "text") == F.col("_unit"))
    ids = stage(known.select("doc_id").distinct(), "label-ids")
    if documents.select("doc_id").join(_sent(ids), "doc_id").count() > ids.count():  # ids are repeated
        rows = rows.dropDuplicates(["doc_id", "_unit"])
    return rows.select("text", "_toxic")


def learn(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of ``documents (doc_id, text)`` and ``labels (doc_id, toxic)``.

    Labels of held-out documents, and null labels, are not looked at; repeated labels of a
    document count once, as the larger. Without labels every text has the same low score.
    """
    characters = character_model(documents, "text")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where(
        F.col("_toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    known = known.groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
    known = _without_copies(documents, stage(known, "labels"))
    labelled = _texts_of(documents, known)
    totals = known.groupBy("_toxic").count().collect()
    n = {row["_toxic"]: row["count"] for row in totals}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    prior = (toxic + 1.0) / (toxic + clean + 2.0)
    # the lower end of Wilson's interval: few documents make a weak feature
    n_docs, z2 = F.col("toxic") + F.col("clean"), CONFIDENCE**2
    spread = CONFIDENCE * F.sqrt(F.col("toxic") * F.col("clean") / n_docs + z2 / 4)
    share = (F.col("toxic") + z2 / 2 - spread) / (n_docs + z2)
    telling = (
        _on_their_own(_feature_counts(labelled, characters))
        .where((F.col("toxic") >= MIN_TOXIC) & (share > prior + WEAKEST * (1 - prior)))
        .select("feature", share.alias("share"), (F.col("toxic") * F.log(share / prior)).alias("evidence"))
        .orderBy(F.col("evidence").desc(), "feature")
        .limit(MODEL_FEATURES)
    )
    weights = {row["feature"]: row["share"] for row in telling.collect()}
    return ToxicityModel(characters, min(0.4, prior * 0.1), weights)


def score(rows: DataFrame, key: str, text: str, model: ToxicityModel) -> DataFrame:
    """``(key, score)`` of every whole text; a null text scores as an empty one."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches(source):
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    return rows.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, score double")


def reject(rows: DataFrame, text: str, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``rows`` whose text scores below ``threshold``, with all their columns."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(text)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches(source):
            clean = pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(clean)

    return rows.mapInArrow(run, rows.schema)
