"""Adaptive context-mixing range coder for token ids, in independent checksummed blocks.

Each id is predicted by three orders: an order-2 and an order-1 table name the id that last
followed this context, and an order-0 model counts ids as a path of 4-bit digits. The
three are mixed by adaptive weights, chosen by how often either table has lately been right,
and the mixture drives an arithmetic coder with a 48-bit interval and 16-bit output words.
Every block starts from an empty model, so blocks decode alone; the coder steps through many
blocks at once, one id of each block a step, with array operations. The order-0 model counts
groups of sixteen neighbouring ids, so the state of all lanes stays within a processor's cache.

A file is a row of sections. A section is the magic, a JSON header (length-prefixed, with a
checksum), then the blocks, each preceded by its id count, payload bytes and the CRC-32 of its
ids. The header lists the section's documents with their lengths, so a reader can map ids to
documents; neither writer nor reader holds more than a section (a document is never divided).

RangeCoder.java codes single blocks with the same model to the same bytes, for Spark's tasks.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"LQTOKEN1"
#: Ids in a block, and blocks coded side by side.
BLOCK, LANES = 4096, 1024
#: Ids after which a section ends.
SECTION = BLOCK * LANES
TOP, LOW = np.uint64(1 << 48), np.uint64(1 << 32)
_ONE1, _ONE2 = 1 << 10, 1 << 12  # slots of the order-1 and order-2 tables
STEP0, STEPW = 8, 12  # what one observation adds to a count
_U4, _U16, _W16 = np.uint64(4), np.uint64(16), np.uint64(0xFFFF)
#: How sure a table's slot is (0 to 3) after a miss, then after a hit.
_NEXT = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.uint8)


class _Model:
    """The adaptive state of `n` lanes."""

    def __init__(self, n: int):
        self.n = n
        self.c1, self.s1 = np.zeros(n * _ONE1, np.uint16), np.zeros(n * _ONE1, np.uint8)
        self.c2, self.s2 = np.zeros(n * _ONE2, np.uint16), np.zeros(n * _ONE2, np.uint8)
        self.weights = np.ones((n * 16, 3), np.uint32)
        self.weights[:, 2] = 2
        self.digits = [np.ones((n * 16**k, 16), np.uint16) for k in range(3)]
        self.lane = np.arange(n)
        self.base1, self.base2 = self.lane * _ONE1, self.lane * _ONE2
        self.p1, self.p2 = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self, m: int):
        """Of the first m lanes: slots, candidates and the row of mixing weights."""
        p1, p2 = self.p1[:m], self.p2[:m]
        i1 = self.base1[:m] + ((p1 * 40503 >> 4) & (_ONE1 - 1))
        i2 = self.base2[:m] + (((p1 * 40503 + p2 * 60493) >> 5) & (_ONE2 - 1))
        row = self.lane[:m] * 16 + self.s2[i2] * 4 + self.s1[i1]
        return i1, i2, self.c1[i1], self.c2[i2], row

    def learn(self, m: int, x: np.ndarray, i1, i2, c1, c2, row, branch) -> None:
        self.weights[row, branch] += STEPW
        for c, s, i, seen in ((self.c1, self.s1, i1, c1), (self.c2, self.s2, i2, c2)):
            state, hit = s[i], seen == x
            s[i] = _NEXT[hit * 4 + state]
            c[i] = np.where(hit | (state > 1), seen, x)
        self.p2[:m] = self.p1[:m]
        self.p1[:m] = x


def _columns(weights: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative weights of (order 2, order 1, order 0); a table that knows nothing has none."""
    w = weights.astype(np.uint64)
    w[:, 0] *= s2 > 0
    w[:, 1] *= s1 > 0
    return w, np.cumsum(w, axis=1)


class _Encoder:
    def __init__(self, n: int, longest: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, TOP, np.uint64)
        self.out, self.at = np.zeros((n, 3 * longest + 8), np.uint32), np.zeros(n, np.int64)
        self.every = np.arange(n)

    def put(self, lanes, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        r = self.range[lanes] // total
        low, size = self.low[lanes] + r * start, r * size
        over = np.flatnonzero(low >= TOP)
        if len(over):
            who = self.every[lanes][over]
            self.out[who, self.at[who] - 1] += 1
            low[over] -= TOP
        few = np.flatnonzero(size < LOW)
        while len(few):
            who = self.every[lanes][few]
            at = self.at[who]
            self.out[who, at] = low[few] >> np.uint64(32)
            self.at[who] = at + 1
            low[few] = (low[few] & np.uint64(0xFFFFFFFF)) << _U16
            size[few] <<= _U16
            few = few[size[few] < LOW]
        self.low[lanes], self.range[lanes] = low, size

    def done(self) -> list[bytes]:
        every = self.every
        for shift in (32, 16, 0):
            self.out[every, self.at] = (self.low >> np.uint64(shift) & _W16).astype(np.uint32)
            self.at += 1
        for j in range(int(self.at.max()) - 1, 0, -1):  # carries run towards the front
            self.out[:, j - 1] += self.out[:, j] >> 16
        words = (self.out & 0xFFFF).astype(">u2")
        return [words[i, :n].tobytes() for i, n in enumerate(self.at.tolist())]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        words = [np.frombuffer(p, ">u2") for p in payloads]
        self.words = np.zeros((len(words), max(map(len, words)) + 4), np.uint64)
        for row, w in zip(self.words, words, strict=True):
            row[: len(w)] = w
        self.range, self.at = np.full(len(words), TOP, np.uint64), np.full(len(words), 3)
        self.every = np.arange(len(words))
        self.code = self.words[:, 0] << np.uint64(32) | self.words[:, 1] << _U16 | self.words[:, 2]

    def look(self, lanes, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.range[lanes] // total
        return r, np.minimum(self.code[lanes] // r, total - np.uint64(1))

    def take(self, lanes, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        code, size = self.code[lanes] - r * start, r * size
        few = np.flatnonzero(size < LOW)
        while len(few):
            who = self.every[lanes][few]
            at = self.at[who]
            code[few] = code[few] << _U16 | self.words[who, np.minimum(at, self.words.shape[1] - 1)]  # damaged data may ask for more
            self.at[who] = at + 1
            size[few] <<= _U16
            few = few[size[few] < LOW]
        self.code[lanes], self.range[lanes] = code, size


def encode_blocks(ids: np.ndarray, sizes: list[int]) -> list[bytes]:
    """Payloads of consecutive blocks of ids (below 65,536), the longest blocks first."""
    n, longest = len(sizes), sizes[0]
    grid, at = np.zeros((n, longest), np.int64), 0
    for row, size in zip(grid, sizes, strict=True):
        row[:size] = ids[at : at + size]
        at += size
    live = np.searchsorted(-np.array(sizes), -np.arange(longest))  # blocks longer than t
    model, coder, every = _Model(n), _Encoder(n, longest), np.arange(n)
    for t in range(longest):
        m = int(live[t])
        x, lanes = grid[:m, t], every[:m]
        i1, i2, c1, c2, row = model.predict(m)
        s1, s2 = model.s1[i1], model.s2[i2]
        branch = np.where((c2 == x) & (s2 > 0), 0, np.where((c1 == x) & (s1 > 0), 1, 2))
        w, c = _columns(model.weights[row], s1, s2)
        size = w[lanes, branch]
        coder.put(slice(0, m), c[lanes, branch] - size, size, c[:, 2])
        out = np.flatnonzero(branch == 2)
        if len(out):
            path, value, each = out, x[out], every[: len(out)]
            for k, table in enumerate(model.digits):
                digit = value >> (12 - 4 * k) & 15
                counts = table[path]
                c = np.cumsum(counts, axis=1, dtype=np.uint64)
                size = counts[each, digit].astype(np.uint64)
                start, total = c[each, digit] - size, c[:, 15]
                if k == 2:  # sixteen neighbours share their group's interval evenly
                    start, total = (start << _U4) + (value & 15).astype(np.uint64) * size, total << _U4
                coder.put(out, start, size, total)
                table[path, digit] += STEP0
                path = path * 16 + digit
        model.learn(m, x, i1, i2, c1, c2, row, branch)
    return coder.done()


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> np.ndarray:
    """The ids of encode_blocks(), concatenated."""
    n, longest = len(sizes), sizes[0]
    grid = np.zeros((n, longest), np.uint32)
    live = np.searchsorted(-np.array(sizes), -np.arange(longest))
    model, coder, every = _Model(n), _Decoder(payloads), np.arange(n)
    for t in range(longest):
        m = int(live[t])
        lanes, part = every[:m], slice(0, m)
        i1, i2, c1, c2, row = model.predict(m)
        w, c = _columns(model.weights[row], model.s1[i1], model.s2[i2])
        r, v = coder.look(part, c[:, 2])
        branch = (v >= c[:, 0]).astype(np.int64) + (v >= c[:, 1])
        size = w[lanes, branch]
        coder.take(part, r, c[lanes, branch] - size, size)
        x = np.where(branch == 0, c2, c1).astype(np.int64)
        out = np.flatnonzero(branch == 2)
        if len(out):
            path, value, each = out, np.zeros(len(out), np.int64), every[: len(out)]
            for k, table in enumerate(model.digits):
                counts = table[path]
                c = np.cumsum(counts, axis=1, dtype=np.uint64)
                total = c[:, 15] << _U4 if k == 2 else c[:, 15]
                r, v = coder.look(out, total)
                digit = ((v >> _U4 if k == 2 else v)[:, None] >= c).sum(axis=1)
                size = counts[each, digit].astype(np.uint64)
                start = c[each, digit] - size
                value = value << 4 | digit
                if k == 2:
                    start <<= _U4
                    within = (v - start) // size
                    start += within * size
                    value = value << 4 | within.astype(np.int64)
                coder.take(out, r, start, size)
                table[path, digit] += STEP0
                path = path * 16 + digit
            x[out] = value
        grid[:m, t] = x
        model.learn(m, x, i1, i2, c1, c2, row, branch)
    return np.concatenate([grid[i, :s] for i, s in enumerate(sizes)])


def _block_sizes(n: int) -> list[int]:
    return [BLOCK] * (n // BLOCK) + ([n % BLOCK] if n % BLOCK else [])


def checked(ids: np.ndarray) -> np.ndarray:
    """The ids in 16 bits, of which the format's ids are."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids over 65,535 are not supported by this format")
    return ids.astype(np.uint16)


def section_head(n: int, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """What stands in front of the blocks of a section with n ids."""
    head = zlib.compress(json.dumps({"docs": doc_ids, "lengths": lengths}).encode())
    return MAGIC + struct.pack("<QII", n, len(head), zlib.crc32(head)) + head


def block_head(n: int, payload_bytes: int, crc: int) -> bytes:
    """What stands in front of a block's payload."""
    return struct.pack("<III", n, payload_bytes, crc)


def encode_section(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> Iterator[bytes]:
    """The pieces of a section that holds the ids of some documents."""
    ids = checked(ids)
    yield section_head(len(ids), doc_ids, lengths)
    sizes = _block_sizes(len(ids))
    for k in range(0, len(sizes), LANES):
        part = sizes[k : k + LANES]
        now = ids[k * BLOCK : k * BLOCK + sum(part)].astype("<u4")
        for j, payload in enumerate(encode_blocks(now, part)):
            crc = zlib.crc32(now[j * BLOCK : j * BLOCK + part[j]].tobytes())
            yield block_head(part[j], len(payload), crc) + payload


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("token file is cut short")
    return data


def stored(f) -> Iterator[tuple[list[int | None], list[int], Iterator[tuple[int, bytes, int]]]]:
    """(doc_ids, lengths, blocks as they are stored: id count, payload and CRC-32) of each section of a file
    object; a section's blocks are read before the next one. Raises ValueError where the file is damaged or empty."""
    magic = f.read(8)
    while True:
        if magic != MAGIC:
            raise ValueError("not a token file")
        total, size, crc = struct.unpack("<QII", _exactly(f, 16))
        head = _exactly(f, size)
        if zlib.crc32(head) != crc:
            raise ValueError("the header's checksum is wrong")
        docs = json.loads(zlib.decompress(head))
        yield docs["docs"], docs["lengths"], _blocks(f, total)
        magic = f.read(8)
        if not magic:
            return


def _blocks(f, left: int) -> Iterator[tuple[int, bytes, int]]:
    while left:
        n, size, crc = struct.unpack("<III", _exactly(f, 12))
        if not 0 < n <= min(left, BLOCK):
            raise ValueError("a block's id count is wrong")
        yield n, _exactly(f, size), crc
        left -= n


def verified(ids: np.ndarray, crc: int) -> np.ndarray:
    """A block's ids, in 32 bits."""
    ids = ids.astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's checksum is wrong")
    return ids


def sections(f) -> Iterator[tuple[list[int | None], list[int], Iterator[np.ndarray]]]:
    """(doc_ids, lengths, chunks of ids) of each section of a file object; a section's chunks are
    read before the next one. Raises ValueError where the file is damaged or empty."""

    def chunks(blocks: Iterator[tuple[int, bytes, int]]) -> Iterator[np.ndarray]:
        while part := list(itertools.islice(blocks, LANES)):
            sizes, payloads, crcs = zip(*part, strict=True)
            ids, at = decode_blocks(payloads, sizes), 0
            for n, crc in zip(sizes, crcs, strict=True):
                verified(ids[at : at + n], crc)
                at += n
            yield ids.astype("<u4")

    for doc_ids, lengths, blocks in stored(f):
        yield doc_ids, lengths, chunks(blocks)
