"""Byte-level BPE vocabularies, and cutting texts where no token can reach across."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The public pre-tokenizer pattern of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,;:!?|$%&*#()+=\"-_/"  # neither letters, digits nor white space, and no apostrophe
_HEADS = (" ", "\n")
TOGETHER = 2048  # new strings encoded as one text
LONG = 64  # longer strings are not remembered
REMEMBERED_BYTES = 96 << 20
_ENTRY = 200  # bytes of an entry beside its characters and ids: two objects and a place in the table
SLICE_BYTES = 8 << 20  # text encoded at a time
# Blocks that hold letters only and have done so since the first versions of Unicode, so all libraries agree on them
_LETTERS = "A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2AF}\\x{391}-\\x{3A1}\\x{3A3}-\\x{3CE}\\x{400}-\\x{481}\\x{5D0}-\\x{5EA}\\x{4E00}-\\x{9FA5}\\x{AC00}-\\x{D7A3}"
_LINE = f"^(?P<letters>[{_LETTERS}]+)(?P<marks>[{re.escape(_MARKS)}]*)$"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, and back.

    Printable bytes stand for themselves; the others take the code points from 256 on.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in printable}
    others = (b for b in range(256) if b not in set(printable))
    return letters | {chr(256 + n): b for n, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE file as arrays: token bytes, and for each token the merge that makes it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.ids: dict[bytes, int] = {as_bytes(token): number for token, number in model["vocab"].items()}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, number in self.ids.items():
            self.bytes_of[number] = token
        for token, number in self.added.items():
            self.bytes_of[number] = token.encode("utf-8")
        self.size = size
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.made = np.full(size, -1, dtype=np.int64)  # rank of the merge; bytes are there from the start
        keys = np.empty(len(model["merges"]), dtype=np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            one, two = (as_bytes(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, c = self.ids[one], self.ids[two], self.ids[one + two]
            keys[rank] = a * size + b
            self.merges[a, b] = (rank, c)
            if self.made[c] < 0:
                self.left[c], self.right[c], self.made[c] = a, b, rank
        order = np.argsort(keys, kind="stable")
        self.merge_keys, self.merge_ranks = keys[order], order

    @cached_property
    def added_pattern(self) -> re.Pattern | None:
        names = sorted(self.added, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    @cached_property
    def longest(self) -> dict[bytes, int]:
        """The longest token that begins with four given bytes."""
        found: dict[bytes, int] = {}
        for token in self.ids:
            if len(token) >= 4:
                found[token[:4]] = max(found.get(token[:4], 0), len(token))
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of some megabytes, or one text; null texts are empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES)))
        yield texts.slice(start, stop - start)
        start = stop


class PieceCache:
    """Encodes texts piece by piece, remembering the ids of short pieces.

    No pre-token has a space after its first character unless white space stands on both
    sides. So a text is cut at single spaces between two other characters, and a piece is
    encoded with the space before it, wherever it occurs. ``encode_words`` gives the packed
    ids of a list of pre-tokens: the distinct ones of a batch that are not remembered.
    """

    def __init__(self, added: re.Pattern | None, added_ids: dict[str, int], encode_words: Callable[[list[str]], list[bytes]]) -> None:
        self.added, self.encode_words = added, encode_words
        self.added_ids = {t: np.array([n], dtype="<u4").tobytes() for t, n in added_ids.items()}
        self.known: dict[str, bytes] = {}  # ids of a space and the key
        self.words: dict[str, bytes] = {}  # ids of pre-tokens that begin without a space
        self.held = 0  # bytes of both, about

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; a null text has none.

        Texts are split and their pieces made distinct by Arrow, some megabytes at a time;
        only distinct pieces become Python objects, and ids are gathered by array operations.
        """
        for part in slices(texts):
            yield from self._slice(part)

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.words.clear()
            self.held = 0
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        named = split.flatten().dictionary_encode()
        pieces, at = named.dictionary.to_numpy(zero_copy_only=False).tolist(), named.indices.to_numpy()
        bare = pc.utf8_trim_whitespace(named.dictionary)
        beside = pc.or_(pc.not_equal(bare, named.dictionary), pc.equal(bare, "")).to_numpy(zero_copy_only=False)
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            odd = np.nonzero(beside)[0].tolist()
            new = {p for p, ids in zip(pieces, found, strict=True) if ids is None}
            rare = self._learn(new.difference([pieces[i] for i in odd]))
            rare.update((pieces[i], b"") for i in odd)  # their texts are encoded whole
            found = [rare[p] if ids is None and p in rare else ids or known[p] for p, ids in zip(pieces, found, strict=True)]
        at = at.astype(np.int32)  # a slice has far fewer than 2**31 pieces and ids
        firsts = [pieces[i] for i in at[offsets[:-1]].tolist()]
        # the first piece has no space before it; a space at the end of it stands beside another
        odd_text = np.zeros(len(texts), dtype=bool)
        odd_text |= np.array([not p or p[-1].isspace() for p in firsts], dtype=bool) & (np.diff(offsets) > 1)
        inner = beside[at]
        inner[offsets[:-1]] = False
        odd_text |= np.add.reduceat(inner, offsets[:-1], dtype=np.int64) > 0
        for token in self.added_ids:
            odd_text |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        at[offsets[:-1]] = len(found) + np.arange(len(firsts), dtype=np.int32)
        found += self._firsts(firsts)

        flat = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        del found, named, split
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        n = sizes[at]
        ends = np.cumsum(n, dtype=np.int32)
        places = np.repeat(starts[at] - (ends - n), n)
        places += np.arange(ends[-1], dtype=np.int32)
        ids = flat[places]
        ends = np.append(0, ends)[offsets]
        for number in range(len(texts)):
            if odd_text[number]:
                yield np.frombuffer(self._whole(texts[number].as_py()), dtype="<u4")
            else:
                yield ids[ends[number] : ends[number + 1]]

    def _firsts(self, firsts: list[str]) -> list[bytes]:
        split = [PATTERN.findall(first) for first in firsts]
        words = list({w for ws in split for w in ws})
        fresh = dict(zip(words, self.encode_words(words), strict=True))
        return [b"".join([fresh[w] for w in ws]) for ws in split]

    def _whole(self, text: str) -> bytes:
        """The ids of a text with added tokens or runs of white space."""
        out = []
        for number, part in enumerate(self.added.split(text) if self.added else [text]):
            if number % 2:
                out.append(self.added_ids[part])
            elif part:
                first, *rest = _CUT.split(part)
                out += self._firsts([first])
                rare = self._learn({p for p in rest if p not in self.known})
                out += [self.known[p] if p in self.known else rare[p] for p in rest]
        return b"".join(out)

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Remember the ids of new pieces; those of long ones are returned instead.

        The garbage collector would look through the many new lists and find no cycles.
        """
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._learned(new)
        finally:
            if collecting:
                gc.enable()

    def _learned(self, new: set[str]) -> dict[str, bytes]:
        known, words = self.known, self.words
        plain, mixed = [], []
        for piece in new:
            if piece.isalpha():
                plain.append(piece)
            else:
                mixed.append((piece, pretokens(piece)))
        spaced = [" " + p for p in plain]
        bases = {ws[0] for _, ws in mixed if ws[0][1:] not in known}.difference(spaced)
        later = {w for _, ws in mixed for w in ws[1:] if w not in words}
        rest = [*bases, *later]
        ids = self.encode_words(spaced + rest)
        found = dict(zip(plain, ids, strict=False))
        fresh = dict(zip(rest, ids[len(plain) :], strict=True))
        found.update((w[1:], fresh[w]) for w in bases)
        short = {w: fresh[w] for w in later if len(w) <= LONG}
        words.update(short)
        self._count(short)
        for piece, ws in mixed:
            start = ws[0][1:]
            first = found[start] if start in found else known[start]
            if len(ws) == 2:
                found[piece] = first + (words[ws[1]] if ws[1] in words else fresh[ws[1]])
            else:
                found[piece] = b"".join([first, *[words[w] if w in words else fresh[w] for w in ws[1:]]])
        rare = {p: i for p, i in found.items() if len(p) > LONG}
        if rare:
            found = {p: i for p, i in found.items() if len(p) <= LONG}
        known.update(found)
        self._count(found)
        return rare

    def _count(self, more: dict[str, bytes]) -> None:
        self.held += _ENTRY * len(more) + sum(map(len, more)) + sum(map(len, more.values()))


class PieceTable:
    """Encodes texts with an encoder of whole texts, which is asked for new words only.

    Texts are cut into pieces as ``PieceCache`` does. Most pieces are lines of letters with
    marks behind them, and few of their words are new however many pieces are. So the ids are
    kept of atoms: letters with the space or line end before them, marks, and any other piece
    as a whole, with the space before it. New atoms are encoded as one text: a token that
    begins with a space or a line end is the first of an atom. Ids stay in arrays; only
    distinct atoms become Python objects.
    """

    def __init__(self, vocab: Vocabulary, encode_texts: Callable[[list[str]], list[list[int]]]) -> None:
        self.encode_texts = encode_texts
        self.added, self.added_pattern = vocab.added, vocab.added_pattern
        self.spaces = np.array([token[:1] == b" " for token in vocab.bytes_of])
        self.ends = np.array([token[:1] in (b" ", b"\n") for token in vocab.bytes_of])
        self.rows: dict[str, int] = {}  # of short atoms
        self.flat = np.empty(0, dtype="<u4")
        self.sizes = np.empty(0, dtype=np.int64)
        self.held = 0  # bytes of the three, about

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; a null text has none."""
        for part in slices(texts):
            yield from self._slice(part)

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        counts, offsets = np.diff(offsets), offsets[:-1]
        named = split.flatten().dictionary_encode()
        pieces, at = named.dictionary, named.indices.to_numpy().astype(np.int32)
        del named, split
        bare = pc.utf8_trim_whitespace(pieces)
        beside = pc.or_(pc.not_equal(bare, pieces), pc.equal(bare, "")).to_numpy(zero_copy_only=False)
        firsts = _strings(pieces.take(pa.array(at[offsets])))
        # the first piece has no space before it; a space at the end of it stands beside another
        odd = np.array([not p or p[-1].isspace() for p in firsts], dtype=bool) & (counts > 1)
        inner = beside[at]
        inner[offsets] = False
        odd |= np.add.reduceat(inner, offsets, dtype=np.int64) > 0
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cut = [self._cut(texts[i].as_py()) for i in np.nonzero(odd)[0].tolist()]

        more = list({p for parts in cut for part in parts for p in part[1:]})
        at[offsets] = -1
        clean = np.repeat(~odd, counts)
        needed = np.zeros(len(pieces), dtype=bool)
        needed[at[clean & (at >= 0)]] = True
        flat, sizes = self._pieces(pa.concat_arrays([pieces.filter(pa.array(needed)), pa.array(more, pieces.type)]))
        place = np.cumsum(needed, dtype=np.int32) - 1
        places = {p: i for i, p in enumerate(more, len(sizes) - len(more))}
        heads = {p: i for i, p in enumerate({*firsts, *(part[0] for parts in cut for part in parts)}, len(sizes))}
        found = self._texts([*heads])
        flat = np.concatenate([flat, *found])
        sizes = np.concatenate([sizes, np.fromiter(map(len, found), dtype=np.int64, count=len(found))])

        at = place[at]
        at[offsets] = [heads[p] for p in firsts]
        rows = [[places[p] if i else heads[p] for part in parts for i, p in enumerate(part)] for parts in cut]
        at = np.concatenate([at[clean], *(np.array(r, dtype=np.int32) for r in rows)])
        ids, ends = _gather(flat, sizes, at)
        # clean texts come first, then the odd ones
        ends = np.append(0, ends)[np.cumsum([0, *counts[~odd].tolist(), *map(len, rows)])].tolist()
        for number in np.argsort(np.argsort(odd, kind="stable")).tolist():
            yield ids[ends[number] : ends[number + 1]]

    def _cut(self, text: str) -> list[list[str]]:
        """A text with added tokens or runs of white space: the pieces of each part between added tokens, which are parts themselves."""
        parts = self.added_pattern.split(text) if self.added_pattern else [text]
        return [[part] if number % 2 else _CUT.split(part) for number, part in enumerate(parts) if part]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each piece with a space before it, one after the other, and how many they are."""
        if not len(pieces):
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        lines = pc.split_pattern(pieces, "\n")
        counts = pc.list_value_length(lines).to_numpy().astype(np.int64)
        firsts = np.cumsum(counts) - counts
        parts = pc.extract_regex(lines.flatten(), _LINE)
        plain = np.logical_and.reduceat(parts.is_valid().to_numpy(zero_copy_only=False), firsts)
        begins = np.zeros(len(parts), dtype=bool)
        begins[firsts] = True
        letters = pc.binary_join_element_wise(pc.if_else(pa.array(begins), *_HEADS), parts.field("letters"), "")
        keep = pa.array(np.repeat(plain, counts))
        n = pc.sum(keep).as_py() or 0
        others = pc.binary_join_element_wise(" ", pieces.filter(pa.array(~plain)), "")
        named = pa.concat_arrays([letters.filter(keep), parts.field("marks").filter(keep), others]).dictionary_encode()
        flat, sizes = self._atoms(_strings(named.dictionary))
        at = named.indices.to_numpy()
        each = np.where(plain, 2 * counts, 1)
        mine = np.repeat(plain, each)
        order = np.empty(len(at), dtype=np.int64)
        order[mine] = at[: 2 * n].reshape(2, n).T.ravel()  # letters and marks by turns
        order[~mine] = at[2 * n :]
        ids, _ = _gather(flat, sizes, order)
        return ids, np.add.reduceat(sizes[order], np.cumsum(each) - each)

    def _atoms(self, atoms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of atoms, which are distinct. Short ones are remembered."""
        rows = np.array(list(map(self.rows.get, atoms, repeat(-1))), dtype=np.int64)
        missing = np.nonzero(rows < 0)[0].tolist()
        places, fresh, n = self._encode([atoms[i] for i in missing])
        missing = [missing[i] for i in places]
        first = len(self.sizes)
        rows[missing] = np.arange(first, first + len(missing))
        sizes = np.concatenate([self.sizes, n])
        ids, _ = _gather(np.concatenate([self.flat, fresh]), sizes, rows)
        new = [atoms[i] for i in missing]
        if max(map(len, new), default=0) > LONG:
            short = np.array([len(a) <= LONG for a in new], dtype=bool)
            new, fresh, n = [a for a in new if len(a) <= LONG], fresh[np.repeat(short, n)], n[short]
        self.rows.update(zip(new, range(first, first + len(new)), strict=True))
        self.flat, self.sizes = np.concatenate([self.flat, fresh]), np.concatenate([self.sizes, n])
        self.held += _ENTRY * len(new) + sum(map(len, new)) + fresh.nbytes
        sizes = sizes[rows]
        if self.held > REMEMBERED_BYTES:
            self._forget(atoms, ids, sizes)
        return ids, sizes

    def _forget(self, atoms: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the short atoms of the last slice, which has the frequent ones; nothing if they take half of the bytes."""
        short = np.array([len(a) <= LONG for a in atoms], dtype=bool)
        kept = [a for a in atoms if len(a) <= LONG]
        held = _ENTRY * len(kept) + sum(map(len, kept)) + 4 * int(sizes[short].sum())
        if held > REMEMBERED_BYTES // 2:
            kept, short, held = [], np.zeros(len(atoms), dtype=bool), 0
        self.rows = {a: i for i, a in enumerate(kept)}
        self.flat, self.sizes, self.held = ids[np.repeat(short, sizes)], sizes[short], held

    def _encode(self, atoms: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the atoms, and in it their ids as they stand in a text and how many they are."""
        lined, spaced, alone = [], [], []
        for i, a in enumerate(atoms):
            if a[:1] not in _HEADS or " " in a[1:]:
                alone.append(i)
            else:
                (spaced if "\n" in a[1:] else lined).append(i)
        order, flat, sizes = [], [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)]
        for places, begins in ((lined, self.ends), (spaced, self.spaces)):
            for start in range(0, len(places), TOGETHER):
                part = places[start : start + TOGETHER]
                text = "".join([atoms[i] for i in part])
                ids = self._texts([] if any(t in text for t in self.added) else [text])
                starts = np.nonzero(begins[ids[0]])[0] if ids else ()
                if len(starts) != len(part) or starts[0]:
                    alone += part
                    continue
                order += part
                flat += ids
                sizes.append(np.diff(starts, append=len(ids[0])))
        ids = self._texts([atoms[i] for i in alone])
        sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        return order + alone, np.concatenate(flat + ids), np.concatenate(sizes)

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype="<u4") for ids in self.encode_texts(texts)]


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _gather(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``rows`` name, one after the other, and where each ends."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[rows]
    ends = np.cumsum(n)
    places = np.repeat((starts[rows] - (ends - n)).astype(np.int32), n)  # a slice has far fewer than 2**31 ids
    places += np.arange(len(places), dtype=np.int32)
    return flat[places], ends


def pretokens(piece: str) -> list[str]:
    """The pre-tokens of a space and ``piece``; many pieces are a word and marks, or two around a line end."""
    found = _plain(piece)
    if found is None and "\n" in piece:
        one, _, two = piece.partition("\n")
        found, rest = _plain(one), _plain(two)
        found = [*found, "\n", *rest] if found and rest else None
    if found is None:
        return PATTERN.findall(" " + piece)
    found[0] = " " + found[0]
    return found


def _plain(part: str) -> list[str] | None:
    """A word, and the marks behind it if there are any; None if ``part`` is anything else."""
    base = part.rstrip(_MARKS)
    if not base.isalpha():
        return None
    return [base] if len(base) == len(part) else [base, part[len(base) :]]
