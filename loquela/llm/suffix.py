"""Exact removal of repeated byte strings with suffix arrays built by induced sorting.

A string of LENGTH bytes that starts earlier somewhere is found in three steps. Every window of
that length is dealt by the least hash of the grams inside it, so equal windows meet, and runs
of windows with one such gram travel as one segment. Copies of a whole segment are told by a
128-bit BLAKE2 digest and its gram: the first stays, the others are repeats. Of the rest only
segments whose gram occurs in another segment go on, as bytes, to shards. A shard builds the
suffix array of its segments by induced sorting, permuted common prefixes tell which neighbours
share a window, and in every group of equal windows all but the first are repeats. Tasks do this
in Java (SuffixRepeats.java); repeats() is the same over arrays, and tests hold them together.

A gram with more contexts than a shard holds is split by its neighbours' bytes: a window goes on
under the gram and half of its other bytes, those on the gram's longer side, which equal windows
have in common too; and so on, until every key fits or fixes the whole window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loquela.llm import compiled
from loquela.llm._shared import in_slices, task, written

LENGTH, GRAM = 100, 24
#: Segments a task settles among themselves at once, bytes hashed at once, bytes of a shard, and
#: bytes of one gram's segments that are split further.
HELD, CHUNK, SHARD, HOT = 2_000_000, 1 << 18, 1 << 20, 4 << 20
#: Letters of an alphabet at most: names over this are written as several letters.
LETTERS = 1024
#: Positions of a wave that are placed one by one.
FEW = 48


# Induced sorting


def _types(x: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S); the last one is larger than the end (L)."""
    n = len(x)
    smaller = np.zeros(n, bool)
    smaller[:-1] = x[:-1] < x[1:]
    differs = np.ones(n, bool)
    differs[:-1] = x[:-1] != x[1:]
    at = np.where(differs, np.arange(n), n)
    return smaller[np.minimum.accumulate(at[::-1])[::-1]]


def _induce(x: np.ndarray, s_type: np.ndarray, lms: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The array that sorted leftmost-smaller positions induce: larger types left to right, then smaller ones back.

    Each letter's bucket is taken in waves: what a wave puts into its own bucket is the next.
    """
    n, letters = len(x), len(heads)
    out = np.full(n, -1, np.int64)

    def place(j: np.ndarray, free: np.ndarray, way: int) -> None:
        if len(j) <= FEW:  # most waves of small inputs: steps cost more than letters
            for at in j.tolist():
                c = x[at]
                to = free[c]
                out[to] = at
                free[c] = to + way
            return
        c = x[j]
        order = c.argsort(kind="stable")
        j, c = j[order], c[order].astype(np.int64)
        count = np.bincount(c, minlength=letters)
        rank = np.arange(len(j)) - (count.cumsum() - count)[c]
        out[free[c] + way * rank] = j
        free += way * count

    first_lms = tails.copy()
    place(lms[::-1], first_lms, -1)
    free = heads.copy()
    place(np.array([n - 1]), free, 1)
    used = np.flatnonzero(heads <= tails).tolist()
    for c in used:
        at = heads[c]
        while at < free[c]:
            j = out[at : free[c]] - 1
            at = free[c]
            j = j[j >= 0]
            if len(j := j[~s_type[j]]):
                place(j, free, 1)
        if first_lms[c] < tails[c]:  # their predecessors are of the larger type and of later letters
            place(out[first_lms[c] + 1 : tails[c] + 1] - 1, free, 1)
    free_s = tails.copy()
    for c in reversed(used):
        at = tails[c]
        while at > free_s[c]:
            j = out[free_s[c] + 1 : at + 1][::-1] - 1
            at = free_s[c]
            j = j[j >= 0]
            if len(j := j[s_type[j]]):
                place(j, free_s, -1)
        if heads[c] < free[c]:
            j = out[heads[c] : free[c]][::-1] - 1
            j = j[j >= 0]
            if len(j := j[s_type[j]]):
                place(j, free_s, -1)
    return out


def suffix_array(x: np.ndarray, letters: int = 256) -> np.ndarray:
    """The suffix array of an array of letters below `letters`; a suffix's end is least.

    Induced sorting takes a step for each letter. A large alphabet, such as the names of a
    lower level, is therefore written in digits of one width: that keeps the order of suffixes,
    and those that begin at a name's first digit are the ones in question.
    """
    n = len(x)
    if n < 2:
        return np.arange(n)
    width = 1
    while letters > LETTERS**width:
        width += 1
    if width > 1:
        base = math.ceil(letters ** (1 / width))
        base += base**width < letters
        digits = np.stack([x // base**k % base for k in reversed(range(width))], axis=1).ravel()
        order = suffix_array(digits, base)
        return order[order % width == 0] // width
    s_type = _types(x)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    count = np.bincount(x, minlength=letters)
    tails = np.cumsum(count) - 1
    heads = tails - count + 1
    if len(lms) > 1:
        found = _induce(x, s_type, lms, heads, tails)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = found[is_lms[found]]
        # Name the substrings: equal neighbours in this order get one name.
        end = np.full(n, n)
        end[lms[:-1]] = lms[1:]
        size = end[ordered] - ordered + 1  # up to the next leftmost-smaller letter; the last ends with the text
        same = size[1:] == size[:-1]
        same &= (end[ordered[1:]] < n) & (end[ordered[:-1]] < n)
        live, k = np.flatnonzero(same), 0
        while len(live):
            live = live[size[live] > k]
            equal = x[ordered[live] + k] == x[ordered[live + 1] + k]
            same[live[~equal]] = False
            live, k = live[equal], k + 1
        names = np.cumsum(np.concatenate([[0], ~same]))
        if names[-1] + 1 < len(lms):
            place = np.full(n, -1, np.int64)
            place[ordered] = names
            lms = lms[suffix_array(place[lms], int(names[-1]) + 1)]
        else:
            lms = ordered
    return _induce(x, s_type, lms, heads, tails)


def common_prefixes(x: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: at each position, how many letters its suffix shares with the one before it in order.

    Where the letter before a position is also the one before its predecessor, the value is one
    less than at the position before; only the other positions are compared.
    """
    n = len(x)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (phi[1:] < 1) | (x[:-1] != x[np.maximum(phi[1:], 1) - 1])
    i = np.flatnonzero(fresh & (phi >= 0))
    j, size = phi[i], np.zeros(len(i), np.int64)
    padded = np.concatenate([x, np.zeros(8, x.dtype)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 1, 8), (1, 1)) if x.dtype == np.uint8 else None
    live = np.arange(len(i))
    while len(live) and words is not None:  # eight letters at a time
        a, b = i[live] + size[live], j[live] + size[live]
        inside = np.maximum(a, b) + 8 <= n
        live, a, b = live[inside], a[inside], b[inside]
        equal = (np.ascontiguousarray(words[a]).view(np.uint64) == np.ascontiguousarray(words[b]).view(np.uint64)).ravel()
        live = live[equal]
        size[live] += 8
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + size[live], j[live] + size[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        live = live[x[a] == x[b]]
        size[live] += 1
    value = np.zeros(n, np.int64)
    value[i] = size
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
    return np.maximum(value[start] - (np.arange(n) - start), 0)


def repeats(segments: list[bytes], windows: list[int], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(segment, first, last) runs of windows that an earlier segment (or place) of the shard has.

    Segments come in document order; each has its first `windows` starts in question. What
    SuffixRepeats.java does for Spark's tasks.
    """
    x = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    begin = np.cumsum(sizes) - sizes
    asked = np.zeros(len(x), bool)
    for b, w in zip(begin.tolist(), windows, strict=True):
        asked[b : b + w] = True
    sa = suffix_array(x)
    shared = common_prefixes(x, sa)[sa] >= length
    shared[0] = False
    group = np.cumsum(~shared) - 1
    heads = np.flatnonzero(~shared)
    place = np.where(asked[sa], sa, len(x))
    first = np.minimum.reduceat(place, heads)[group]
    again = np.zeros(len(x) + 1, bool)
    again[sa] = asked[sa] & (sa > first)
    owner = np.repeat(np.arange(len(segments)), sizes)
    at = np.flatnonzero(again)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
    starts, ends = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    who = owner[starts]
    return list(zip(who.tolist(), (starts - begin[who]).tolist(), (ends - begin[who]).tolist(), strict=True))


# Dealing windows


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position."""
    w = x.astype(np.uint64)
    w = w[:-1] | w[1:] << np.uint64(8)
    w = w[:-2] | w[2:] << np.uint64(16)
    w = w[:-4] | w[4:] << np.uint64(32)
    n = len(x) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += w[k : n + k]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first start, number of windows) of the runs of windows with one least gram."""
    hashes, starts, counts = [], [], []
    windows = len(text) - length + 1
    for a in range(0, windows, CHUNK):
        n = min(CHUNK, windows - a)
        value = _mixed(np.frombuffer(text, np.uint8, n + length - 1, a))
        place, width, span = np.arange(len(value), dtype=np.int32), 1, length - GRAM + 1
        best = value
        while width < span:  # least of `width` neighbours, the leftmost of equals
            step = min(width, span - width)
            left = best[:-step] <= best[step:]
            best, place = np.where(left, best[:-step], best[step:]), np.where(left, place[:-step], place[step:])
            width += step
        cut = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [n]])
        hashes.append(value[place[cut[:-1]]])
        starts.append(cut[:-1] + a)
        counts.append(np.diff(cut))
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(counts)


_KEYS = ["h", "s", "s2", "doc_id", "ord", "start"]
_ROW = "h long, s long, s2 long, doc_id long, ord int, start long, n int, again boolean"
_SEGMENT = "h long, s long, s2 long, doc_id long, ord int, start long, n int, again boolean, lo int, hi int, segment binary"
_SPAN = "doc_id long, ord int, start long, n int"
_SHARD = "doc_id array<long>, ord array<int>, start array<long>, sizes binary, windows binary, segments binary"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def _digests(parts: list) -> np.ndarray:
    """[parts, 2] halves of the parts' 128-bit digests."""
    make = hashlib.blake2b
    return np.frombuffer(b"".join([make(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)


def _spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys that deal rows which meet nothing any more anywhere."""
    return ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ start.astype(np.uint64)).view(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of every text, those that repeat within the task marked; a marked one no longer
    needs its gram and is dealt anywhere."""
    held: list[tuple[np.ndarray, ...]] = []

    def settle() -> pa.RecordBatch:
        h, s, s2, doc, ord_, start, n = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((start, ord_, doc, s2, s, h))
        h, s, s2, doc, ord_, start, n = (c[order] for c in (h, s, s2, doc, ord_, start, n))
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (s[1:] == s[:-1]) & (s2[1:] == s2[:-1])])
        h[again] = _spread(doc[again], start[again])
        return _batch(_ROW, [h, s, s2, doc, ord_, start, n, again])

    for batch in in_slices(batches, "text"):
        for doc, ord_, text in zip(batch.column("doc_id").to_pylist(), batch.column("ord").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if len(raw) < LENGTH:
                continue
            h, start, n = runs(raw)
            view = memoryview(raw)
            s = _digests([view[a:b] for a, b in zip(start.tolist(), (start + n + (LENGTH - 1)).tolist(), strict=True)])
            held.append((h.view(np.int64), s[:, 0], s[:, 1], np.full(len(h), doc, np.int64), np.full(len(h), ord_, np.int32), start, n))
        if sum(len(c[0]) for c in held) > HELD:
            yield settle()
    if held:
        yield settle()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their keys: mark repeats, keep what has another segment to meet.

    Of a gram that goes on in the next batch two rows are carried over, its first and its last:
    they tell whether another segment was met and whether the next row repeats one.
    """
    rest: pa.RecordBatch | None = None
    before = np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        sent = np.concatenate([before, np.zeros(batch.num_rows, bool)])
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        h, s, s2 = (batch.column(c).to_numpy() for c in _KEYS[:3])
        again = batch.column("again").to_numpy(zero_copy_only=False)
        same_h = (h[1:] == h[:-1]) & ~again[1:] & ~again[:-1]
        copy = np.concatenate([[False], same_h & (s[1:] == s[:-1]) & (s2[1:] == s2[:-1])])
        group = np.cumsum(np.concatenate([[True], ~same_h])) - 1
        kinds = np.bincount(group, weights=~again & ~copy)
        keep = again | copy | (kinds[group] > 1)
        out = keep & ~sent
        if out.any():
            columns = [pa.array(again | copy) if name == "again" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(out))
        ends = np.unique([np.searchsorted(group, group[-1]), len(h) - 1])
        rest, before = batch.take(pa.array(ends)), (keep | sent)[ends]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments under longer keys: their gram, then half of each window's other bytes on its longer side.

    All windows of a segment hold the bytes from lo to hi, which its key tells. Of the others a
    window has as many to the right as to the left, or more on one side; its windows so make
    one part or two, each with more bytes in common.
    """
    for batch in batches:
        rows: list[tuple] = []
        for h, doc, ord_, start, n, lo, hi, segment in zip(*[batch.column(c).to_pylist() for c in ("h", "doc_id", "ord", "start", "n", "lo", "hi", "segment")], strict=True):
            rest = LENGTH - (hi - lo)
            right = (rest + 1) // 2
            cut = min(max(hi + right - LENGTH, 0), n)  # windows from here on have that many bytes to the right
            for first, end, a, b in ((cut, n, lo, hi + right), (0, cut, lo - rest // 2 - 1, hi)):
                if first < end:
                    part = segment[first : end + LENGTH - 1]
                    key = xxhash.xxh3_64_intdigest(segment[a:b], seed=(h ^ (a < lo)) & 0xFFFFFFFFFFFFFFFF)
                    rows.append((key - (1 << 63), doc, ord_, start + first, end - first, a - first, b - first, part))
        if rows:
            h, doc, ord_, start, n, lo, hi, part = zip(*rows, strict=True)
            s = _digests(list(part))
            h, doc_, ord__, start_ = np.array(h, np.int64), np.array(doc, np.int64), np.array(ord_), np.array(start, np.int64)
            order = np.lexsort((start_, ord__, doc_, s[:, 1], s[:, 0], h))
            same = (h[order[1:]] == h[order[:-1]]) & (s[order[1:]] == s[order[:-1]]).all(axis=1)
            again = np.zeros(len(h), bool)
            again[order[1:][same]] = True
            h[again] = _spread(doc_[again], start_[again])
            yield _batch(_SEGMENT, [h, s[:, 0], s[:, 1], doc, ord_, start, n, again, lo, hi, [b"" if x else y for x, y in zip(again.tolist(), part, strict=True)]])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (h, doc_id, ord, start): shards of whole gram groups, some together, each a row."""
    held: list[tuple] = []
    size = 0

    def settle() -> pa.RecordBatch:
        nonlocal size
        _, doc, ord_, start, n, segments = zip(*held, strict=True)
        held.clear()
        size = 0
        return _batch(_SHARD, [[doc], [ord_], [start], [np.array([len(x) for x in segments], "<i4").tobytes()], [np.array(n, "<i4").tobytes()], [b"".join(segments)]])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("h", "doc_id", "ord", "start", "n", "segment")], strict=True):
            if size >= SHARD and row[0] != held[-1][0]:
                yield settle()
            held.append(row)
            size += len(row[5])
    if held:
        yield settle()


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' runs of windows that shards found in their segments."""
    for batch in batches:
        for doc, ord_, start, found in zip(*[batch.column(c) for c in ("doc_id", "ord", "start", "found")], strict=True):
            who, first, last = np.frombuffer(found.as_py(), "<i4").reshape(-1, 3).T.astype(np.int64)
            yield _batch(_SPAN, [doc.values.to_numpy()[who], ord_.values.to_numpy()[who], start.values.to_numpy()[who] + first, last - first + 1])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted segments' bytes, and where their gram lies in them."""
    for batch in in_slices(batches, "text"):
        rows: list[tuple] = []
        for doc, ord_, text, wanted in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "ord", "text", "wanted")], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                segment = raw[w["start"] : w["start"] + w["n"] + LENGTH - 1]
                rows.append((w["h"], 0, 0, doc, ord_, w["start"], w["n"], False, 0, 0, segment))
        if not rows:
            continue
        whole = np.frombuffer(b"".join([r[10] for r in rows]), np.uint8)
        at = np.cumsum([0] + [len(r[10]) for r in rows])
        match = np.flatnonzero(_mixed(whole).view(np.int64) == np.repeat([r[0] for r in rows], np.diff(at))[: len(whole) - GRAM + 1])
        lo = match[np.searchsorted(match, at[:-1])] - at[:-1]  # the leftmost one, which the first window holds
        columns = list(zip(*rows, strict=True))
        yield _batch(_SEGMENT, [*columns[:8], lo, lo + GRAM, columns[10]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by (start, end) spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text"):
        rows = []
        for doc, text, found in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "found")], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans = merged([(f["start"], f["start"] + f["n"] + LENGTH - 1) for f in found or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of (doc_id, text).

    A byte is removed if a LENGTH-byte string over it starts earlier too: in a document of
    smaller id, or earlier in the same one. Strings don't cross documents and are judged on the
    input. Null is the empty text. Several rows of one id (a null id comes before all) count as
    documents in the order of their texts. Copies within a task are settled there, so a passage
    that a third of all documents hold sends one row for each task and not one for each
    document; a gram in very many contexts is split until its parts fit a shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    several = rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count() > 0
    if several:
        order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
        rows = rows.withColumn("ord", F.row_number().over(order).cast("int"))
    else:
        rows = rows.withColumn("ord", F.lit(0))
    least = -(1 << 63)
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(least)))
    met = written(rows.mapInArrow(task(_segments), _ROW).repartition("h").sortWithinPartitions(*_KEYS).mapInArrow(task(_meet), _ROW))
    wanted = met.filter("NOT again").groupBy("doc_id", "ord").agg(F.collect_list(F.struct("h", "start", "n")).alias("wanted"))
    live = written(rows.join(wanted, ["doc_id", "ord"]).mapInArrow(task(_cut_out), _SEGMENT))
    again, shards = [met.filter("again")], []
    while True:
        hot = written(live.groupBy("h").agg(F.sum(F.length("segment")).alias("size")).filter(F.col("size") > HOT).select("h"))
        if hot.first() is None:
            shards.append(live)
            break
        shards.append(live.join(hot, "h", "left_anti"))
        parts = live.join(hot, "h", "left_semi").mapInArrow(task(_split), _SEGMENT).repartition("h").sortWithinPartitions(*_KEYS).mapInArrow(task(_meet), _SEGMENT)
        parts = written(parts)
        again.append(parts.filter("again"))
        live = parts.filter("NOT again")
    found = [x.select("doc_id", "ord", "start", "n") for x in again]
    code = compiled.function(docs.sparkSession, "SuffixRepeats.java", "SuffixRepeats", "binary")
    for x in shards:
        dealt = x.select("h", "doc_id", "ord", "start", "n", "segment").repartition("h").sortWithinPartitions("h", "doc_id", "ord", "start")
        shard = dealt.mapInArrow(task(_shards), _SHARD)
        shard = shard.select("doc_id", "ord", "start", F.call_function(code, "sizes", "windows", "segments", F.lit(LENGTH)).alias("found"))
        found.append(shard.mapInArrow(task(_found), _SPAN))
    again = found[0]
    for x in found[1:]:
        again = again.unionByName(x)
    by_doc = written(again.groupBy("doc_id", "ord").agg(F.collect_list(F.struct("start", "n")).alias("found")))
    out = rows.join(by_doc, ["doc_id", "ord"], "left").select("doc_id", "text", "found")
    done = out.mapInArrow(task(_finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
