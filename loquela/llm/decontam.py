"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of lower-cased words. A random walk over a window (the CGK embedding)
copies a word at each step and moves on by a random bit that depends on the step and the word,
so sequences at a small edit distance agree at most steps. A few sampled steps make a key;
repeated with other walks and samples, a window within the allowed distance of an item shares
one of its keys with the target recall. Windows have the size of the items (long items are cut
into even parts: one part at least is within the allowed rate). Pairs that share a key are
verified by exact edit distance between the item and the best-matching stretch of the text.

Before the walk, windows are passed over that can't be near any item. An edit spoils at most
two of a window's word pairs, so the others must be pairs of items of that size, which a table
of fixed size tells without loss.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquela.llm._shared import in_slices, task, written

#: Edits allowed for each word of an item; items with fewer words than this allow none.
RATE, LEAST = 0.2, 5
#: For windows of up to so many words: repetitions, and steps sampled in each. Longer windows agree
#: at fewer steps. Measured recall at the full rate is over 0.9 for every kind of edit (tests).
SCHEME = ((18, 24, 3), (32, 48, 3), (48, 24, 2))
#: Longest window in words, and windows embedded at once.
LONGEST, BLOCK = 48, 1 << 13
#: Windows times repetitions that walk side by side, which stay within a processor's cache.
CELLS = 1 << 14
#: Tasks receive two tables of fixed size: the item sizes that each of 2^20 cells of word pairs
#: occurs in, as bits (8 MB), and a bitmap of 2^22 cells of item keys (512 KB).
PAIR_BITS, BITS = 20, 22
_WORD = re.compile(r"\w+")
_GAP = LONGEST // 4  # more missing words than any window may have


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)) | np.uint64(1)  # zero is the pad


def _constants(size: int, repeat: int) -> tuple[list[int], np.ndarray]:
    """Sampled steps and the walk's odd multipliers; fixed by window size and repetition."""
    rng = np.random.default_rng([size, repeat, 20])
    samples = next(n for most, _, n in SCHEME if size <= most)
    steps = sorted(rng.choice(2 * size, samples, replace=False).tolist())
    return steps, rng.integers(0, 1 << 63, 2 * size + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys_of(windows: np.ndarray) -> np.ndarray:
    """[windows, keys] of [windows, size] word hashes: one of all words where no edit is allowed."""
    n, size = windows.shape
    if size >= LEAST:
        return cgk_keys(windows)
    key = np.full(n, size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(size):
        key = (key ^ windows[:, j]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key[:, None]


def cgk_keys(windows: np.ndarray) -> np.ndarray:
    """[windows, repetitions] keys of [windows, size] word hashes, by sampled CGK walks."""
    n, size = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    out = np.empty((n, next(n for most, n, _ in SCHEME if size <= most)), np.uint64)
    some = max(1, CELLS // out.shape[1])
    for i in range(0, n, some):
        out[i : i + some] = _walked(padded[i : i + some])
    return out


@functools.cache
def _walks(size: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The repetitions of a window size by their last step, longest first; for each step the number of walks that
    still go on, those that sample it, and their multipliers as a column."""
    repeats = next(n for most, n, _ in SCHEME if size <= most)
    made = [_constants(size, r) for r in range(repeats)]
    order = sorted(range(repeats), key=lambda r: -made[r][0][-1])
    steps = []
    for j in range(made[order[0]][0][-1] + 1):
        live = sum(made[r][0][-1] >= j for r in order)
        sampled = np.array([k for k, r in enumerate(order[:live]) if j in made[r][0]], np.int64)
        steps.append((live, sampled, np.array([made[r][1][j] for r in order[:live]], np.uint64)[:, None]))
    return np.array(order), steps


def _walked(padded: np.ndarray) -> np.ndarray:
    """cgk_keys() of windows with their pad, all repetitions side by side."""
    n, size = padded.shape[0], padded.shape[1] - 1
    order, steps = _walks(size)
    base, flat = np.arange(n) * (size + 1), padded.ravel()
    end = base + size
    at = np.repeat(base[None], len(order), axis=0)
    start = [(size * 64 + r) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for r in order.tolist()]
    key = np.repeat(np.array(start, np.uint64)[:, None], n, axis=1)
    for live, sampled, odd in steps:
        at = at[:live]
        word = flat[at]
        if len(sampled):
            mixed = (key[sampled] ^ word[sampled]) * np.uint64(0xD6E8FEB86659FD93)
            key[sampled] = mixed ^ mixed >> np.uint64(32)
        word *= odd
        word >>= np.uint64(63)
        at += word.view(np.int64)
        np.minimum(at, end, out=at)
    out = np.empty((n, len(order)), np.uint64)
    out[:, order] = key.T
    return out


def parts(n: int) -> list[tuple[int, int]]:
    """(offset, size) of an item's even parts, none over LONGEST words."""
    k = -(-n // LONGEST)
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def allowed(n: int) -> int:
    return int(n * RATE)


def edit_distance(item: list[str], text: list[str]) -> tuple[int, int]:
    """(distance, end) of the stretch of `text` nearest to `item`, in word edits."""
    index = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a, b = np.array([index[w] for w in item]), np.array([index.get(w, -1) for w in text])
    row, ramp = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for i, w in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[:-1] + (b != w), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << BITS, bool)
    bits[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.packbits(bits)


def _in_bitmap(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, in order."""
    x = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]
    return x * np.uint64(0xD6E8FEB86659FD93)


def needed(size: int) -> int:
    """Word pairs that a window within the allowed distance has in common with its item at least."""
    return max(1, size - 1 - 2 * allowed(size))


def dense(known: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Places of word pairs, in order, without those that are in no window with enough pairs of items, whatever their size."""
    several = [s for s in sizes if s > 1]
    if not several or not len(known):
        return np.arange(len(known))
    least, span = min(map(needed, several)), max(several) - 1
    total = np.concatenate([[0], np.cumsum(known != 0, dtype=np.int32)])
    ends = np.minimum(np.arange(len(known)) + span, len(known))
    begin = np.flatnonzero(total[ends] - total[:-1] >= least)
    cover = np.zeros(len(known) + 1, np.int32)
    np.add.at(cover, begin, 1)
    np.subtract.at(cover, ends[begin], 1)
    return np.flatnonzero(np.cumsum(cover[:-1]) > 0)


def _item_keys(items: DataFrame) -> DataFrame:
    """(item_id, size, at, n_words, key) rows: keys of every part of every item with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = _hashes(words(text))
                for at, size in parts(len(h)) if len(h) else ():
                    rows += [(item_id, size, at, len(h), int(k)) for k in keys_of(h[None, at : at + size])[0].view(np.int64)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "size", "at", "n_words", "key"])

    return items.mapInArrow(task(run), "item_id long, size int, at int, n_words int, key long")


def _pair_cells(items: DataFrame) -> DataFrame:
    """(cell, size): which cells of word pairs occur in parts of which size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                h = _hashes(words(text))
                for at, size in parts(len(h)) if len(h) else ():
                    cells = np.unique(_pairs(h[at : at + size]) >> np.uint64(64 - PAIR_BITS)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), size, np.int32))], ["cell", "size"])

    return items.select("text").mapInArrow(task(run), "cell int, size int").distinct()


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start_word, n_words): documents that hold a passage of an item.

    A passage is a stretch of the document within RATE word edits for each of the item's words;
    start_word is where it may begin and distance its least edit distance. One row for each
    document and item. Items of fewer than LEAST words match where their exact words stand,
    whatever their case. Items without a word, null texts and rows without an id match nothing;
    empty tables give an empty result. A passage that very many documents share meets its few
    item rows in a join that Spark can split.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    keys = written(_item_keys(items))
    # What is collected are cells of the two tables: their number has a fixed bound.
    key_cells = keys.select(F.shiftrightunsigned("key", 64 - BITS).cast("int")).distinct().toArrow().column(0).to_numpy()
    sizes = sorted(r[0] for r in keys.select("size").distinct().collect())  # LONGEST at most
    longest = keys.agg(F.max("n_words")).first()[0] or 0
    sizes_of_pair = np.zeros(1 << PAIR_BITS, np.uint64)
    pair_cells = _pair_cells(items).toArrow()
    np.bitwise_or.at(sizes_of_pair, pair_cells.column("cell").to_numpy(), np.uint64(1) << (pair_cells.column("size").to_numpy() - 1).astype(np.uint64))
    shared = spark.sparkContext.broadcast((sizes_of_pair, _bitmap(key_cells.astype(np.uint64) << np.uint64(64 - BITS))))

    def near(hashes: np.ndarray, known: np.ndarray, key_bits: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(starts, size, keys) of windows with a key among the items' cells; known: each word pair's item sizes."""
        zone = dense(known, sizes)
        known = known[zone]
        for size in sizes:
            if len(hashes) < size:
                continue
            pairs = size - 1
            if pairs:
                if len(zone) < pairs:
                    continue
                total = np.concatenate([[0], np.cumsum(known >> np.uint64(pairs) & np.uint64(1), dtype=np.int32)])
                starts = np.flatnonzero(total[pairs:] - total[:-pairs] >= needed(size))
                starts = zone[starts[zone[starts + pairs - 1] - zone[starts] == pairs - 1]]  # not over a gap between zones
            else:
                starts = np.arange(len(hashes))
            starts = starts[hashes[starts] != 0]
            for i in range(0, len(starts), BLOCK):
                some = starts[i : i + BLOCK]
                found = keys_of(hashes[some[:, None] + np.arange(size)])
                hit = _in_bitmap(key_bits, found)
                who = hit.any(axis=1)
                if who.any():
                    yield some[who], size, np.where(hit, found, 0)[who]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes_of_pair, key_bits = shared.value
        for batch in in_slices(batches, "text"):
            texts = [words(t) for t in batch.column("text").to_pylist()]
            sizes_of = np.array([len(t) for t in texts], np.int64)
            flat = _hashes([w for t in texts for w in t])
            first = np.cumsum(sizes_of + _GAP) - sizes_of - _GAP  # each text's place, a gap behind it
            hashes = np.zeros(int((sizes_of + _GAP).sum()), np.uint64)
            hashes[np.repeat(first - (np.cumsum(sizes_of) - sizes_of), sizes_of) + np.arange(len(flat))] = flat
            known = sizes_of_pair[(_pairs(hashes) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)]
            known[(hashes[:-1] == 0) | (hashes[1:] == 0)] = 0
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for starts, size, found in near(hashes, known, key_bits):
                owners = np.searchsorted(first, starts, side="right") - 1
                if size < LEAST:  # where such words stand first in a text is enough
                    once = np.unique(np.stack([owners.astype(np.uint64), found[:, 0]]), axis=1, return_index=True)[1]
                    starts, owners, found = starts[once], owners[once], found[once]
                for s, o, k in zip(starts.tolist(), owners.tolist(), found.view(np.int64), strict=True):
                    at = s - int(first[o])
                    low = max(0, at - longest - allowed(longest))
                    text = texts[o][low : at + size + 2 * longest + allowed(longest)]
                    rows.append((ids[o], at, low, k[k != 0].tolist(), " ".join(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "at", "low", "keys", "context"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    windows = written(texts.mapInArrow(task(run), "doc_id long, at long, low long, keys array<long>, context string"))
    # A passage shows in several windows: those within an item's length are verified as one stretch.
    hits = windows.select("doc_id", "at", F.explode("keys").alias("key")).join(keys.select("key", "item_id", F.col("at").alias("part"), "n_words"), "key")
    begin = F.col("at") - F.col("part")
    pairs = hits.groupBy("doc_id", "item_id", "n_words", F.floor(begin / F.col("n_words")).alias("place")).agg(F.min(begin).alias("first"), F.max(begin).alias("last"), F.min("at").alias("at"))
    pairs = pairs.join(windows.select("doc_id", "at", "low", "context").dropDuplicates(["doc_id", "at"]), ["doc_id", "at"]).join(items.dropDuplicates(["item_id"]), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, str], tuple[int, int]] = {}
        for batch in batches:
            rows = []
            if len(known) > 10_000:
                known.clear()
            for doc_id, low, first, last, n, item_id, context, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "low", "first", "last", "n_words", "item_id", "context", "text")], strict=True):
                begin = max(0, first - 2 * allowed(n) - low)
                stretch = context.split(" ")[begin : max(0, last - low) + n + 2 * allowed(n)]
                key = item_id, " ".join(stretch)
                if key not in known:
                    known[key] = edit_distance(words(text), stretch)
                distance, end = known[key]
                if distance <= allowed(n):
                    rows.append((doc_id, item_id, distance, max(0, low + begin + end - n), n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "start_word", "n_words"])

    verified = pairs.mapInArrow(task(verify), "doc_id long, item_id long, distance int, start_word long, n_words int")
    best = verified.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start_word", "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.distance", "b.start_word", "b.n_words")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item's passage was found; columns unchanged."""
    bad = contaminated(docs, items).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
