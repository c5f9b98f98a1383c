"""Token ids of whole texts, with a cache of the words met before.

Both tokenizer kinds cut a text into pieces before merging, and no piece spans the gap in front
of a space: so a text's ids are those of its space-separated words, in order. Each distinct word
is encoded by the tokenizers library once for each cache and looked up afterwards. Texts in
which white space meets a space (a run that one piece may cover) are encoded whole.

Where the vocabulary file's own pattern says so, more is shared. A line end between other letters
is a piece of its own, so words are cut in front of it too. Letters and the points behind them
are two pieces, so a word ending in points has the ids of both; and where a file lower-cases,
so do words of ASCII letters. The cache holds what is shared, and a batch's words are cut, made
distinct and put together again in Arrow arrays: only distinct letters meet Python.

New words are encoded many at a time, as one text, whose ids are cut apart at the marks that
such vocabularies put at the start or end of a word. Words for which that would not be
safe (white space, control characters, special tokens) are encoded one by one.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and ids that a cache holds, in two halves: when the newer is full it becomes the
#: older, which is dropped, and words found there move over. So memory is bounded.
CACHE = 96 << 20
#: What an entry takes beside the characters and ids themselves, and words encoded as one text.
_ENTRY, _AT_ONCE = 200, 2000
#: Bytes of words that are kept in arrays, and what such an entry takes there beside its ids.
_SHORT, _SHORT_ENTRY = 23, 56
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_RUN = re.compile(r"\s \s|  |\s \Z")
_MEET = re.compile(r"\s\s")
#: White space but the space and the line end.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Latin letters, which every version of Unicode has (but one that becomes two in lower case), and points.
_LETTERS, _POINTS = r"\A\n?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+\z", ".,;:!?*#%&$"
_SPACED = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_UNSPACED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _meets(text: str) -> bool:
    """Whether two white space characters stand side by side."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in _OTHER_SPACE) and _MEET.search(text) is not None


def _keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of up to 23 bytes: the bytes and their number as [n, 3] integers; which words these are, and which are longer."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    size = np.diff(ends)
    short, longer = np.flatnonzero(size <= _SHORT), np.flatnonzero(size > _SHORT)
    start, size = ends[short], size[short]
    data = bytes(words.buffers()[2] or b"") + bytes(24)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # at every byte
    keys = np.stack([eight[start + k] & _MASKS[np.clip(size - k, 0, 8)] for k in (0, 8, 16)], axis=1)
    keys[:, 2] |= size.astype(np.uint64) << np.uint64(56)
    return keys, short, longer


class _Words:
    """ids of words: of short ones in arrays, found by open addressing; of others in a dictionary."""

    def __init__(self):
        self.n, self.size = 0, 0
        self.slots = np.full(1 << 10, -1, np.int32)
        self.keys = np.zeros((1 << 8, 3), np.uint64)
        self.first = np.zeros((1 << 8) + 1, np.int64)  # of a word's ids; the next word's are behind them
        self.all = np.zeros(1 << 10, "<u4")
        self.long: dict[str, bytes] = {}

    def __len__(self) -> int:
        return self.n + len(self.long)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for k in (1, 2):
            h ^= h >> np.uint64(29)
            h += keys[:, k]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)).astype(np.int64) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key's word is, or -1."""
        out, live, place = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._places(keys)
        while len(live):
            at = self.slots[place]
            here = (self.keys[at] == keys[live]).all(axis=1) & (at >= 0)
            out[live[here]] = at[here]
            more = ~here & (at >= 0)
            live, place = live[more], (place[more] + 1) & (len(self.slots) - 1)
        return out

    def found(self, keys: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """Which of the keys not found elsewhere are here, with their ids and numbers of ids."""
        if self.n and len(new := np.flatnonzero(at < 0)):
            own = self.find(keys[new])
            if len(here := np.flatnonzero(own >= 0)):
                yield new[here], self._gather(own[here])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[at]
        count = self.first[at + 1] - first
        return self.all[np.repeat(first - count.cumsum() + count, count) + np.arange(count.sum())], count

    def ids(self, at: np.ndarray) -> pa.Array:
        ids, count = self._gather(at)
        ends = 4 * np.concatenate([[0], count.cumsum()])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Take distinct new words; returns where they are."""
        n, new, filled = self.n, self.n + len(keys), int(self.first[self.n])
        if new > len(self.keys):
            self.keys = np.concatenate([self.keys[:n], np.empty((2 * new - n, 3), np.uint64)])
            self.first = np.concatenate([self.first[: n + 1], np.empty(2 * new - n, np.int64)])
        if filled + len(ids) > len(self.all):
            self.all = np.concatenate([self.all[:filled], np.empty(filled + 2 * len(ids), "<u4")])
        self.keys[n:new], self.first[n + 1 : new + 1] = keys, filled + count.cumsum()
        self.all[filled : filled + len(ids)] = ids
        self.n = new
        at = np.arange(n, new)
        if 2 * new > len(self.slots):
            self.slots = np.full(1 << (4 * new).bit_length(), -1, np.int32)
            self._put(np.arange(new))
        else:
            self._put(at)
        self.size += 4 * len(ids) + _SHORT_ENTRY * len(keys)
        return at

    def _put(self, at: np.ndarray) -> None:
        place = self._places(self.keys[at])
        while len(at):
            free = self.slots[place] < 0
            self.slots[place[free]] = at[free]  # of several for one place, one stays
            more = self.slots[place] != at
            at, place = at[more], (place[more] + 1) & (len(self.slots) - 1)

    def keep(self, words: dict[str, bytes]) -> None:
        """Take long words."""
        self.long.update(words)
        self.size += sum(map(len, words)) + sum(map(len, words.values())) + _ENTRY * len(words)


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    spaced: a byte-level tokenizer whose pieces carry the space before them; otherwise white
    space is dropped by the tokenizer.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.clear()
        vocabulary = self.tokenizer.get_vocab()
        made = json.loads(self.tokenizer.to_str())
        cutter, normal = made["pre_tokenizer"] or {}, json.dumps(made["normalizer"])
        mark = made["model"].get("end_of_word_suffix")
        if spaced:
            known = all(cutter.get(k) == v for k, v in _SPACED.items()) and made["normalizer"] is None
            self.ends = None
        else:
            first = (cutter.get("pretokenizers") or [{}])[0]
            known = first.get("pattern") == {"Regex": _UNSPACED} and bool(mark)
            self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool) if known else None  # ids that end a word
            if known:
                self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.pointed, self.lowers = known, known and not spaced and '"Lowercase"' in normal
        line = self._ids(["\n"])[0] if spaced and known else b""
        self.line = int(np.frombuffer(line, "<u4")[0]) if len(line) == 4 else None  # the id of a line end alone
        self.points: dict[str, bytes] = {}
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin a word
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True

    def clear(self) -> None:
        self.words, self.older = _Words(), _Words()
        self.size = 0
        self.used = False  # since a task ended

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _cut(self, words: list[str], text: str, kind: str) -> list[bytes]:
        """ids of words encoded as one text, cut where a word begins or behind its end."""
        ids = np.frombuffer(self._ids([text])[0], "<u4")
        if kind == "end":
            cut = np.flatnonzero(self.ends[ids[:-1]]) + 1
            cut = np.concatenate([[0], cut])
        else:
            cut = np.flatnonzero(ids == self.line if kind == "line" else self.opens[ids])
        if len(cut) != len(words):  # its marks are others
            return self._alone(words)
        data, at = ids.tobytes(), (4 * cut).tolist()
        return [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]

    def _alone(self, words: list[str]) -> list[bytes]:
        """ids of words encoded one by one, with the space in front that a word has unless a line end is there."""
        return self._ids([w if not self.spaced or self._in_line(w) else " " + w for w in words]) if words else []

    def _in_line(self, word: str) -> bool:
        return self.line is not None and word.startswith("\n")

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Each word's ids, by the tokenizers library."""
        kinds: dict[str, list[str]] = {"space": [], "line": [], "end": [], "": []}
        if self.spaced:  # letters and digits are printable
            kinds["space"] = [w for w in words if w.isalnum()]
            words = [w for w in words if not w.isalnum()]
        for w in words:
            if self.spaced:
                body = w[1:] if self._in_line(w) else w
                kind = ("line" if body is not w else "space") if body and body.isprintable() and "<|" not in body else ""
            else:
                kind = "end" if self.ends is not None and w.isalpha() else ""
            kinds[kind].append(w)
        out = dict(zip(kinds[""], self._alone(kinds[""]), strict=True))
        for kind, before, between in (("space", " ", " "), ("line", "", ""), ("end", "", " ")):
            for i in range(0, len(kinds[kind]), _AT_ONCE):
                some = kinds[kind][i : i + _AT_ONCE]
                out.update(zip(some, self._cut(some, before + between.join(some), kind), strict=True))
        return out

    def _known(self, words: pa.Array) -> pa.Array:
        """Distinct words' ids: from the cache, of which the older half's move over, or by the library."""
        keys, short, longer = _keys(words)
        at = self.words.find(keys)
        for i, got in self.older.found(keys, at):
            at[i] = self.words.add(keys[i], *got)
        new = np.flatnonzero(at < 0)
        names = words.take(pa.array(short[new])).to_numpy(zero_copy_only=False).tolist()
        long = words.take(pa.array(longer)).to_pylist()
        unknown = [w for w in long if w not in self.words.long]
        moved = {w: self.older.long[w] for w in unknown if w in self.older.long}
        asked = [*names, *(w for w in unknown if w not in moved)]
        made = self._fresh(asked) if asked else {}
        if names:
            ids = [made[w] for w in names]
            at[new] = self.words.add(keys[new], np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        out = self.words.ids(at)
        if long:
            moved.update((w, made[w]) for w in unknown if w in made)
            self.words.keep(moved)
            order = np.empty(len(words), np.int64)
            order[np.concatenate([short, longer])] = np.arange(len(words))
            out = pa.concat_arrays([out, pa.array([self.words.long[w] for w in long], pa.large_binary())]).take(pa.array(order))
        self.size = self.words.size
        return out

    def _behind(self, points: pa.Array) -> pa.Array:
        """ids of points that stand behind letters."""
        names = points.to_pylist()
        if unseen := [x for x in names if x and x not in self.points]:
            made = dict(zip(unseen, self._ids(unseen), strict=True))
            if len(self.points) < 10_000:
                self.points.update(made)
        else:
            made = {}
        return pa.array([(made[x] if x in made else self.points[x]) if x else b"" for x in names], pa.large_binary())

    def _distinct(self, words: pa.Array) -> pa.Array:
        """ids of distinct words: those of their letters, and those of the points behind these."""
        if not self.pointed or not len(words):
            return self._known(words)
        keys = pc.ascii_rtrim(words, _POINTS)
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        size = np.diff(ends)
        rest = size - pc.binary_length(keys).to_numpy()
        some = np.flatnonzero((rest > 0) & (rest < size))
        lettered = pc.match_substring_regex(keys.take(pa.array(some)), _LETTERS).to_numpy(zero_copy_only=False)
        pointed = some[lettered]
        at = np.empty(2 * len(words) + 1, np.int64)  # keys and points by turns, in the words' own bytes
        at[::2], at[1::2] = ends, ends[1:]
        at[2 * pointed + 1] -= rest[pointed]
        both = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(at), words.buffers()[2])
        keys = both.take(pa.array(np.arange(0, 2 * len(words), 2)))
        if self.lowers:
            keys = pc.if_else(pc.ascii_is_alpha(keys), pc.ascii_lower(keys), keys)
        keys, points = keys.dictionary_encode(), both.take(pa.array(2 * pointed + 1)).dictionary_encode()
        out = self._known(keys.dictionary).take(keys.indices)
        if not len(pointed):
            return out
        which = np.zeros(len(words), np.int64)
        which[pointed] = points.indices.to_numpy() + 1
        behind = pa.concat_arrays([pa.array([b""], pa.large_binary()), self._behind(points.dictionary)])
        return pc.binary_join_element_wise(out, behind.take(pa.array(which)), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Null and empty texts have no ids."""
        self.used = True
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string())
        out: list[bytes] = [b""] * len(texts)
        cut = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False).copy()  # texts cut at spaces and line ends
        whole: list[int] = []
        apart: list[list[str]] = []  # words of texts that are cut at spaces only
        heads: dict[int, str] = {}  # their first words, without a mark in front
        if self.spaced:
            for i, text in enumerate(texts.to_pylist()):
                if text and (self.line is None or _meets(text)):
                    cut[i] = False
                    if _RUN.search(text) or (self.line is not None and " \n" in text):
                        whole.append(i)
                    else:
                        apart.append(text.split(" "))
                        heads[i] = apart[-1].pop(0)
        if self.size > CACHE // 2:
            self.older, self.words, self.size = self.words, _Words(), 0
        lines = texts.filter(pa.array(cut))
        if self.spaced:  # the first word stands behind a line end of its own
            lines = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(lines, "\n", " \n"), pa.scalar("", pa.large_string()))
        else:
            lines = pc.replace_substring(lines, "\n", " ")
        lines = pc.split_pattern(lines, " ")
        words = pa.concat_arrays([lines.flatten().cast(pa.large_string()), pa.array(itertools.chain.from_iterable(apart), pa.large_string())])
        counts = np.concatenate([pc.list_value_length(lines).to_numpy(), [len(x) for x in apart]]).astype(np.int64)
        words = words.dictionary_encode()
        ids = self._distinct(words.dictionary).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][np.concatenate([[0], counts.cumsum()])].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        skip = 4 if self.spaced else 0  # the line end in front
        for i, a, b in zip([*np.flatnonzero(cut).tolist(), *heads], ends[:-1], ends[1:], strict=True):
            out[i] = bytes(data[a if i in heads else a + skip : b])
        if heads:
            for i, first in zip(heads, self._ids(list(heads.values())), strict=True):
                out[i] = first + out[i]
        if whole:
            for i, ids in zip(whole, self._ids([texts[i].as_py() for i in whole]), strict=True):
                out[i] = ids
        return out


_made: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder for a vocabulary file; its cache goes with the first task without it (see forget())."""
    if (path, spaced) not in _made:
        _made[path, spaced] = Encoder(path, spaced)
    return _made[path, spaced]


def keep() -> None:
    """For tasks that stand behind an encoder in its stage, as workers change places: its cache stays."""
    for e in _made.values():
        e.used = True


def forget() -> None:
    """At the end of a task: empty the caches that it didn't use. The next task of a stage finds its words."""
    for e in _made.values():
        if not e.used:
            e.clear()
        e.used = False
