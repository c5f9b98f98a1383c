"""SimHash near-duplicate classes through a byte-position inverted index.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most r
bits differ in at most r bytes, so they share at least 8 - r positional bytes: the guaranteed
minimum. A plain posting list (position, byte) holds 1/256 of all fingerprints, and pairs from
it would grow with the square of the table. The lists are therefore intersected before pairs
are looked at: for r = 3 five shared bytes of eight leave at least three within one half of the
fingerprint, so the eight three-byte subsets of the two halves index every qualifying pair.
Inside such an intersected list the shared positional bytes of a pair are tallied, pairs that
reach the minimum are kept, and their Hamming distance is verified. A list yields a spanning
forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquela.llm._shared import in_slices, task, written
from loquela.llm.components import components

#: Shingles hashed at once; bounds the memory for one very long text.
BLOCK = 1 << 16
#: Lists over this many fingerprints are split by one more positional byte.
LIST_LIMIT = 20_000
SEED = 42


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the (n, 8) big-endian hash rows have each of the 64 bits, high bit first."""
    bits = np.unpackbits(hashes, axis=1)
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of 255 ones still fit in a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included.

    A-Z are lower-cased, words are runs of anything but U+0020 and U+0009-U+000D. Fewer words
    than a shingle has: the whole sequence is the one shingle; no word (or null): zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[len(parts) - n :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        rows = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)])
        total += bit_counts(np.frombuffer(rows, np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; fp holds the unsigned value's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            fps = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task(run), "doc_id long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * i).bitwiseAND(F.lit(255))


def _key(fp: Column, positions: tuple[int, ...]) -> Column:
    """The posting key of some positional bytes: which positions, then their bytes."""
    key = F.lit(sum(1 << i for i in positions)).cast("long")
    for i in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, i))
    return key


def _posted(rows: DataFrame, subsets: list[tuple[int, ...]]) -> DataFrame:
    """A row for each posting of each fingerprint."""
    return rows.select("fp", "rep", F.explode(F.array(*[_key(F.col("fp"), s) for s in subsets])).alias("key"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


_LOW7, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _linked(x: np.ndarray, radius: int) -> np.ndarray:
    """Of xors: which pairs share 8 - radius positional bytes, then which differ in few enough bits."""
    zero = ~(((x & _LOW7) + _LOW7) | x | _LOW7)  # the high bit of each byte that is zero
    found = _popcount(zero & _HIGH) >= 8 - radius
    found[found] = _popcount(x[found]) <= radius
    return found


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the links among distinct fingerprints of one list."""
    rest, edges = np.arange(len(fps)), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            near = _linked(fps[rest] ^ fps[i], radius)
            if near.any():
                new = rest[near]
                edges += [(i, j) for j in new]
                front += new.tolist()
                rest = rest[~near]
    return edges


def _forest_by_probes(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same for a long list whose fingerprints differ in three bytes only: look each of the
    values within the radius up in a table of these bits, instead of meeting each other fingerprint."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    code = np.zeros(len(fps), np.int64)
    width = 0
    for b in range(64):
        if varying >> b & 1:
            code |= (fps >> np.uint64(b) & np.uint64(1)).astype(np.int64) << width
            width += 1
    table = np.full(1 << width, -1, np.int32)
    table[code] = np.arange(len(fps), dtype=np.int32)
    root = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    for k in range(1, radius + 1):
        for some in combinations(range(width), k):
            other = code ^ sum(1 << b for b in some)
            j = table[other]
            i = np.flatnonzero((j >= 0) & (code < other))
            j = j[i]
            while True:  # every root hangs below one smaller root at most, by one link
                a, b = root[i], root[j]
                apart = a != b
                if not apart.any():
                    break
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                high, at = np.unique(np.maximum(a, b), return_index=True)
                root[high] = np.minimum(a, b)[at]
                edges += zip(i[at].tolist(), j[at].tolist(), strict=True)
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
            if not root.any():
                return edges
    return edges


def _links(radius: int):
    """mapInArrow function over (key, fp, rep) sorted by key: (a, b) links between reps."""

    def out(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    def lists(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch | None:
        a, b = [], []
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(cut)
        short = np.repeat(size <= 64, size)
        d, at = 1, np.flatnonzero(short)
        while len(at):  # pairs at distance d within short lists, for all lists at once
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            near = at[_linked(fp[at] ^ fp[at + d], radius)]
            a.append(rep[near])
            b.append(rep[near + d])
            d += 1
        for s, n in zip(cut[:-1][size > 64], size[size > 64], strict=True):
            part = fp[s : s + n]
            pairs = _forest(part, radius) if n <= LIST_LIMIT else _forest_by_probes(part, radius)
            if pairs:
                i, j = np.array(pairs).T + s
                a.append(rep[i])
                b.append(rep[j])
        return out(a, b) if sum(map(len, a)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep"))
            if not len(now[0]):
                continue
            kept.append(now)
            if now[0][0] == now[0][-1] and kept[0][0][0] == now[0][0]:
                continue  # the list goes on
            key, fp, rep = (np.concatenate(x) for x in zip(*kept, strict=True))
            end = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
            kept = [(key[end:], fp[end:], rep[end:])]
            if end and (found := lists(key[:end], fp[:end].view(np.uint64), rep[:end])):
                yield found
        if kept:
            key, fp, rep = (np.concatenate(x) for x in zip(*kept, strict=True))
            if found := lists(key, fp.view(np.uint64), rep):
                yield found

    return run


def _subsets(width: int, radius: int) -> list[tuple[int, ...]]:
    """Position subsets of which any 8 - radius positions hold one whole."""
    if radius == 3 and width == 3:
        return [s for half in (range(4), range(4, 8)) for s in combinations(half, 3)]
    return list(combinations(range(8), width))


def links(reps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) between the `rep` ids of (fp, rep) rows with distinct fp: enough links for every class.

    Lists longer than LIST_LIMIT are split: their fingerprints are posted again under every
    four, then every five shared positional bytes. Five bytes leave 2^24 distinct
    fingerprints at most in a list, which bounds a task's memory whatever the table holds.
    """
    width, most = 3, 8 - radius
    if radius > 3:
        raise ValueError("a radius over 3 leaves too few guaranteed positional bytes")
    posted, found = _posted(reps, _subsets(width, radius)), []
    while True:
        long = written(posted.groupBy("key").count().filter(F.col("count") > LIST_LIMIT).select("key")) if width < most else None
        split = long is not None and long.first() is not None
        short = (posted.join(long, "key", "left_anti") if split else posted).select("key", "fp", "rep")
        found.append(short.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(task(_links(radius)), "a long, b long"))
        if not split:
            break
        width += 1
        posted = _posted(written(posted.join(long, "key", "left_semi").select("fp", "rep").distinct()), _subsets(width, radius))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs`: the operator itself.

    component_id is the smallest id reachable over links of at most `radius` differing bits.
    Null and empty texts have fingerprint zero and link like others. Rows without an id get
    a fingerprint but no component and link nothing. Repeated rows stay. An empty table gives
    an empty result. Other columns of `docs`, whatever their names, are not looked at.
    """
    fps = written(fingerprints(docs, id_col, text_col, words))
    reps = written(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(written(links(reps, radius)))
    of_fp = reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    joined = fps.join(of_fp, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def fingerprint_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(text_hash, class) of the texts of rows with an id: the classes of near_duplicates(), told by
    text, so that several texts under one id are not joined by it."""
    texts = docs.filter(F.col(id_col).cast("long").isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    rows = texts.withColumn("text_hash", F.xxhash64("text"))
    fps = written(fingerprints(rows, "text_hash", "text", words).withColumnRenamed("doc_id", "text_hash").distinct())
    roots = components(written(links(fps.select("fp", F.col("fp").alias("rep")).distinct(), radius)))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("text_hash", F.coalesce("root", "fp").alias("class"))


# Similarity at five words: a prefix index over the shingle sets themselves

#: Rows (in expectation) whose shingles are counted for the index's order, and how many are ranked.
SAMPLED, RANKED = 10_000, 1 << 18
#: Lists up to this many sets give all their pairs, longer ones a forest first.
SHORT = 64
#: Parity bits of a set at most: fewer rule out less and lose nothing. Words compared at once.
WIDEST, AT_ONCE = 4096, 1 << 18
#: Shingles of a long list's part (8 bytes each): a task compares two parts at a time.
PART = 1 << 20
#: Bits of the bitmap that tells which sets the pairs need.
NEEDED_BITS = 24
_EPS = 1e-9


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, in order; none without a word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    m = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:m].tolist()
    ends = ends[len(parts) - m :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, m))


def parity_bits(h: np.ndarray, finer: int = 1) -> bytes:
    """For each residue of the hashes, whether an odd number has it; a power of two of residues.

    Two sets differ in at least as many hashes as their bits differ. Halves of the bits fold
    by xor into those of half as many residues. Finer bits rule out more.
    """
    width = finer * min(WIDEST, max(64, 1 << max(0, len(h) - 1).bit_length()))
    counts = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").tobytes()


def prefix(h: np.ndarray, ranked: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's hashes, rare ones first, that two similar sets share one of them.

    Any fixed order of all hashes is without loss; `ranked` (sorted) are frequent ones, which
    `rank` puts behind the others.
    """
    p = len(h) - int(np.ceil(similarity * len(h) - _EPS)) + 1
    if not len(ranked):
        return h[:p]
    at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
    known = ranked[at] == h
    rare, often = h[~known], h[known]
    return rare[:p] if len(rare) >= p else np.concatenate([rare, often[np.argsort(rank[at[known]])]])[:p]


class _Bounds:
    """Which pairs of some sets can be similar enough, by their sizes and parity bits: without loss."""

    def __init__(self, n: np.ndarray, bits: list[bytes], similarity: float) -> None:
        self.n, self.similarity = n, similarity
        self.width = np.array([len(b) for b in bits], np.int64)
        self.place, self.rows = {}, {}
        for w in np.unique(self.width).tolist():
            own, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            place = np.zeros(len(bits), np.int64)
            place[own], place[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            rows = np.frombuffer(b"".join([bits[i] for i in own]), np.uint64).reshape(len(own), -1)
            if len(twice):
                both = np.frombuffer(b"".join([bits[i] for i in twice]), np.uint64).reshape(len(twice), 2, -1)
                rows = np.concatenate([rows, both[:, 0] ^ both[:, 1]])
            self.place[w], self.rows[w] = place, rows

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, s = self.n, self.similarity
        found = (n[i] >= s * n[j] - _EPS) & (n[j] >= s * n[i] - _EPS)  # so widths differ by a factor of 2 at most
        width = np.minimum(self.width[i], self.width[j])
        for w in np.unique(width[found]).tolist():
            some = np.flatnonzero(found & (width == w))
            place, rows = self.place[w], self.rows[w]
            step = AT_ONCE // rows.shape[1]
            for k in range(0, len(some), step):
                part = some[k : k + step]
                a, b = i[part], j[part]
                apart = np.bitwise_count(rows[place[a]] ^ rows[place[b]]).sum(axis=1, dtype=np.int64)
                total = n[a] + n[b]
                found[part] = (total - apart) // 2 >= s / (1 + s) * total - _EPS
        return found


def _list_pairs(key: np.ndarray, bounds: _Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that may be similar within lists of equal key: all of a short list, a spanning
    forest of a long one."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(cut)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    d, at = 1, np.flatnonzero(np.repeat(size <= SHORT, size))
    while len(at):  # pairs at distance d within short lists, for all lists at once
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        near = at[bounds.near(at, at + d)]
        a.append(near)
        b.append(near + d)
        d += 1
    for s, e in zip(cut[:-1][size > SHORT].tolist(), cut[1:][size > SHORT].tolist(), strict=True):
        rest = np.arange(s, e)
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                i = front.pop()
                near = bounds.near(np.full(len(rest), i), rest)
                a.append(np.full(int(near.sum()), i))
                b.append(rest[near])
                front += rest[near].tolist()
                rest = rest[~near]
    return np.concatenate(a), np.concatenate(b)


def _candidates(dealt: DataFrame, similarity: float) -> DataFrame:
    """(a, b) pairs of nodes, a < b, out of (key, node, n, bits) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def lists(rows: pa.Table) -> pa.RecordBatch:
            key, node, n = (rows.column(c).to_numpy() for c in ("key", "node", "n"))
            i, j = _list_pairs(key, _Bounds(n, rows.column("bits").to_pylist(), similarity))
            pairs = np.unique(np.sort(np.array([node[i], node[j]], np.int64), axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))
            if end or (held and held[0].column("key")[0].as_py() != keys[0]):
                yield lists(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held = []
            held.append(batch.slice(end))
        if held:
            yield lists(pa.Table.from_batches(held))

    rows = dealt.repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(task(run), "a long, b long").distinct()


def _node(grams: bytes) -> int:
    """The name of a shingle set, as a signed 64-bit number."""
    return (xxhash.xxh3_64_intdigest(grams) + (1 << 63)) % (1 << 64) - (1 << 63) if grams else 0


def _grams(texts: DataFrame, words: int) -> DataFrame:
    """(node, grams) of each (text): sets are long, so they are made again where needed and not stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            grams = [shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, grams)), pa.int64()), pa.array(grams, pa.binary())], ["node", "grams"])

    return texts.select("text").mapInArrow(task(run), "node long, grams binary")


def _grams_of(nodes: DataFrame, named: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(node, grams) of some nodes, once each: from (node, text_hash) of one text of each and (text_hash, text) rows."""
    one = nodes.select("node").distinct().join(named, "node").select("text_hash")
    cell = F.shiftrightunsigned("text_hash", 64 - NEEDED_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(text_hash, {64 - NEEDED_BITS}) & 63 AS int))")
    bits = one.groupBy(F.shiftright(cell, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("v")).toArrow()
    bitmap = np.zeros(1 << NEEDED_BITS - 6, np.int64)  # of fixed size: other texts don't travel
    bitmap[bits.column("w").to_numpy()] = bits.column("v").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a copy in the same task
        for batch in batches:
            c = batch.column("cell").to_numpy()
            wanted = (shared.value[c >> 6] >> (c & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            for slice_ in in_slices([batch.filter(pa.array(wanted))], "text"):
                found = {}
                for text_hash, text in zip(slice_.column("text_hash").to_pylist(), slice_.column("text").to_pylist(), strict=True):
                    if text_hash not in seen:
                        seen.add(text_hash)
                        grams = shingle_set(text, words).tobytes()
                        found[_node(grams)] = grams
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "grams"])

    texts = rows.filter("doc_id IS NOT NULL").select("text_hash", "text", cell.alias("cell"))
    return texts.mapInArrow(task(needed), "node long, grams binary").join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, some: DataFrame, similarity: float) -> DataFrame:
    """Those (a, b) pairs whose sets, from (node, grams), have this Jaccard similarity."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= similarity * (len(both) - common) - _EPS)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(some.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(task(same), "a long, b long")


def list_links(key: int | None, own: np.ndarray, node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], order: tuple[np.ndarray, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(a, b) nodes of one list whose sets are this similar, enough to join what is one class.

    Only pairs of different roots are looked at, and of those that met none of the same part
    (own), where there are two. Where a set has the key in its order bounds what it can share
    with another, if the key is the first they share (no key: no such bound); then sizes and
    parity bits, then the sets.
    """
    n = np.array([len(h) for h in sets], np.int64)
    at = np.array([0 if key is None else int(np.flatnonzero(prefix(h, *order, similarity) == np.uint64(key))[0]) for h in sets])
    bounds = _Bounds(n, [parity_bits(h, 8) for h in sets], similarity)
    value, letter = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(n) - n
    label = np.unique(root, return_inverse=True)[1]
    two, mark, found = len(np.unique(own)) > 1, np.zeros(len(value), bool), []
    for i in range(len(sets)):
        j = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & ((own[i + 1 :] != own[i]) | (not two)))
        least = similarity / (1 + similarity) * (n[i] + n[j]) - _EPS
        j = j[np.minimum(n[i] - at[i], n[j] - at[j]) >= least]
        if len(j):
            j = j[bounds.near(np.full(len(j), i), j)]
        if not len(j):
            continue
        mark[letter[begin[i] : begin[i] + n[i]]] = True
        first = np.cumsum(n[j]) - n[j]
        common = np.add.reduceat(mark[letter[np.repeat(begin[j] - first, n[j]) + np.arange(int(n[j].sum()))]].astype(np.int64), first)
        mark[letter[begin[i] : begin[i] + n[i]]] = False
        for k in j[common >= similarity * (n[i] + n[j] - common) - _EPS].tolist():
            if label[k] != label[i]:
                found.append((int(node[i]), int(node[k])))
                label[label == label[k]] = label[i]
    return found


def _in_groups(rows: DataFrame, ranks, similarity: float) -> DataFrame:
    """(a, b) links of list_links() for (grp, own, low, high, node, root, grams) rows: a task holds one pair of parts of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> pa.RecordBatch:
            _, own, node, root, grams = zip(*held, strict=True)
            links = list_links(None, np.array(own), np.array(node), np.array(root), [np.frombuffer(g, np.uint64) for g in grams], ranks.value, similarity)
            held.clear()
            pairs = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=1 << 62)), pa.array(pairs.max(axis=1, initial=-1 << 62))], ["a", "b"])

        for batch in batches:
            for grp, low, high, own, node, root, grams in zip(*[batch.column(c).to_pylist() for c in ("grp", "low", "high", "own", "node", "root", "grams")], strict=True):
                if held and held[0][0] != (grp, low, high):
                    yield settle()
                held.append(((grp, low, high), own, node, root, grams))
        if held:
            yield settle()

    dealt = rows.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "n", "node")
    return dealt.mapInArrow(task(run), "a long, b long").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, root, component_id): classes of texts whose word-shingle sets have this Jaccard similarity.

    A radius of three bits in 64 finds only almost equal texts, so this works on the sets.
    Classes known before, as (text_hash, class) rows such as those of fingerprint_classes(),
    stay whole: their links join in, and pairs within one need no look. In one order of all
    shingles, sets this similar share one of their first: these are posted,
    rare shingles first by a sample's counts, which changes the lists' lengths and not what is
    found. In a list, sizes and parity bits rule out pairs without loss, and what is left is
    verified on the sets. A long list gives a spanning forest of possible pairs first; where
    these, verified, leave a group of sets joined by possible pairs in several classes, these are
    compared across the classes in tasks of their own, two bounded parts of a group at a time,
    and only links come out. A set goes there once, however many lists it is in.
    Equal sets are one node, named by a 64-bit hash. root names the class, text_hash the row's
    text, for ids that several texts share. component_id is the smallest id reachable; nulls and
    repeats are as in near_duplicates().
    """
    spark = docs.sparkSession

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            found = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            node = [_node(h.tobytes()) for h in found]
            arrays = [pa.array(node, pa.int64()), pa.array([len(h) for h in found], pa.int64()), pa.array([parity_bits(h) for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *arrays], ["doc_id", "text_hash", "node", "n", "bits"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("grams"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(g.as_buffer(), np.int64))], ["gram"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    fps = written(rows.mapInArrow(task(sets_of), "doc_id long, text_hash long, node long, n long, bits binary"))
    sets = fps.filter("doc_id IS NOT NULL AND n > 0")
    texts = rows.filter("doc_id IS NOT NULL AND text <> ''")
    drawn = F.pmod(F.xxhash64("text_hash"), F.lit(1 << 30)) < min(1.0, SAMPLED / max(1, fps.count())) * (1 << 30)
    often = _grams(texts.filter(drawn), words).dropDuplicates(["node"]).mapInArrow(task(each), "gram long").groupBy("gram").count().filter("count > 1")
    often = often.orderBy(F.col("count").desc(), "gram").limit(RANKED).select("gram").toArrow().column(0).to_numpy().view(np.uint64)
    order = np.argsort(often)
    ranks = spark.sparkContext.broadcast((often[order], -order))  # the most frequent last

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, rank = ranks.value
        seen: set[int] = set()
        for batch in in_slices(batches, "text"):
            keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in batch.column("text").to_pylist():
                h = shingle_set(text, words)
                node = _node(h.tobytes())
                if len(h) and node not in seen:  # a copy in the same task
                    seen.add(node)
                    keys.append(prefix(h, ranked, rank, similarity).view(np.int64))
                    owners.append(np.full(len(keys[-1]), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "node"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key and node, without repeats those whose key has another node."""
        key = node = np.zeros(0, np.int64)
        out = np.zeros(0, bool)  # whether a row is out already: the last one is carried over
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            out = np.concatenate([out, np.zeros(len(key) - len(out), bool)])
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])[: len(key)]
            key, node, out = key[first], node[first], out[first]
            same = key[1:] == key[:-1]
            keep = (np.concatenate([[False], same]) | np.concatenate([same, [False]]))[: len(key)]
            new = keep & ~out
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(node[new])], ["key", "node"])
            key, node, out = key[-1:], node[-1:], (out | keep)[-1:]

    posted = texts.select("text").mapInArrow(task(post), "key long, node long")
    met = written(posted.repartition("key").sortWithinPartitions("key", "node").mapInArrow(task(together), "key long, node long"))
    bits = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    named = sets.groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    pairs = possible = written(_candidates(met.join(bits, "node"), similarity))
    if known is not None:
        of_class = sets.select("node", "text_hash").distinct().join(known.select("text_hash", "class").distinct(), "text_hash")
        stars = of_class.groupBy("class").agg(F.min("node").alias("b")).join(of_class, "class").select(F.col("node").alias("a"), "b").filter("a <> b")
        stars = components(written(stars))
        one = lambda c: stars.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        apart = pairs.join(one("a"), "a", "left").join(one("b"), "b", "left").filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
        pairs = written(apart.select("a", "b"))
    some = _grams_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), named, rows, words)
    links = _verified(pairs, some, similarity)
    if known is not None:
        links = links.unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = written(links)
    long = written(met.groupBy("key").count().filter(F.col("count") > SHORT).select("key"))
    roots = components(links)
    if long.first():
        # similar sets of a list are joined by its possible pairs: what these leave apart needs no look
        groups = components(possible).withColumnRenamed("root", "grp")
        rooted = met.join(long, "key", "left_semi").join(groups, "node").join(roots, "node", "left").select("key", "grp", "node", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("key", "grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "grp")
        held = rooted.join(mixed, ["key", "grp"], "left_semi").select("grp", "node", "root").distinct()  # once, however many lists
        held = written(held.join(bits.select("node", "n"), "node"))
        parts = held.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(PART)).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        dealt = held.join(parts, "grp").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).join(_grams_of(held, named, rows, words), "node")
        more = _in_groups(dealt, ranks, similarity)
        roots = components(written(links.unionByName(more)))
    named = fps.filter("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"))
    named = named.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = named.join(least, "root").select("node", "root", "component_id")
    joined = fps.select("doc_id", "text_hash", "node").join(of_node, "node", "left")
    has_id = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "text_hash", F.when(has_id, F.col("root")).alias("root"), F.when(has_id, F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class of similar_documents(): that with the smallest id, then text hash.

    Another text under the same id is judged by its own class. Of repeated rows one stays; rows
    without an id all stay. Columns unchanged.
    """
    one = classes.filter("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    one = one.select(F.col("one.doc_id").alias("__one_id"), F.col("one.text_hash").alias("__one_text")).distinct()
    id_, text_hash = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    kept = docs.join(one, (id_ == one["__one_id"]) & (text_hash == one["__one_text"]), "left_semi")
    kept = kept.withColumns({"__one_id": F.col("doc_id").cast("long"), "__one_text": F.xxhash64(F.col("text").cast("string"))}).dropDuplicates(["__one_id", "__one_text"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id IS NULL"))
