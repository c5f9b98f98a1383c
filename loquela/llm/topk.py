"""Exact top-k inner-product search with block-at-a-time pruning.

Documents are dealt into ranges of similar vectors. Of every range, and of every block inside
one, the greatest and least value of each term (dimension) are known; for a query the sum of
the best term products bounds every score in it. A query first searches the range with the
highest bound, which yields a score that its k-th best can't fall below; then it visits only the
ranges whose bound reaches that score. Inside a range, blocks are visited from the highest bound
down and scored through their forward indexes (their vectors) until the next bound falls below
the query's k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loquela.llm._shared import task, written

#: Vectors in a block, and in the part of a range that one task holds.
BLOCK, RANGE = 128, 8192
#: Numbers in the table of range bounds that every task receives (16 MB): the number of ranges
#: is this over the dimensions at most; a larger range is split into more parts.
CELLS = 1 << 20
#: Doubles hold integers exactly below this.
EXACT = float(1 << 53)
#: Placeholders of an unfilled place: a score whose negation fits, and an id behind all others.
NONE, LAST = -np.iinfo(np.int64).max, np.iinfo(np.int64).max


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products, through floating point where that is exact."""
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1] < EXACT:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    return q @ d.T


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[queries, boxes]: no vector between a box's low and high scores more."""
    bounds = np.maximum(q, 0).astype(np.float64) @ high.T.astype(np.float64) + np.minimum(q, 0).astype(np.float64) @ low.T.astype(np.float64)
    if bounds.size and np.abs(bounds).max() >= EXACT:  # rounded: keep them safe
        bounds += np.abs(bounds) * 1e-9 + 1
    return bounds


def _similar(d: np.ndarray, block: int) -> np.ndarray:
    """An order that puts similar vectors into the same runs of `block`: halved along the widest term."""
    done, todo = [], [np.arange(len(d))]
    while todo:
        at = todo.pop()
        if len(at) <= block or d.shape[1] == 0:
            done.append(at)
            continue
        part = d[at].astype(np.float64)
        at = at[np.argsort(part[:, np.argmax(part.var(axis=0))], kind="stable")]
        half = (len(at) // block + 1) // 2 * block or block
        todo += [at[half:], at[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Tile:
    """A part of a range: its blocks' forward indexes and their term maxima and minima."""

    def __init__(self, ids: np.ndarray, ords: np.ndarray, d: np.ndarray, block: int = BLOCK):
        order = np.argsort(ids, kind="stable")
        order = order[_similar(d[order], block)]
        self.ids, self.ords, self.d, self.block = ids[order], ords[order], d[order], block
        self.cuts = np.arange(0, len(ids), block)
        self.low, self.high = np.minimum.reduceat(self.d, self.cuts, axis=0), np.maximum.reduceat(self.d, self.cuts, axis=0)

    def search(self, ids: np.ndarray, ords: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query's row, document id, score): each query's k best here, none below its floor."""
        bounds = _bounds(q, self.low, self.high)
        visits = np.argsort(-bounds, axis=1, kind="stable")
        n = len(q)
        top_ids, top = np.full((n, k), LAST, np.int64), np.full((n, k), NONE, np.int64)
        least = floors.copy()  # the k-th score so far, or what is known from elsewhere
        live = np.arange(n)
        for step in range(len(self.cuts)):
            at = visits[live, step]
            live = live[bounds[live, at] >= least[live]]  # an equal bound may still win a tie
            if not len(live):
                break
            at = visits[live, step]
            for b in np.unique(at):  # queries that visit the same block are scored together
                who, part = live[at == b], slice(self.cuts[b], self.cuts[b] + self.block)
                found = self.ids[part]
                s = _scores(q[who], self.d[part])
                own = (found[None, :] == ids[who][:, None]) & (self.ords[part][None, :] == ords[who][:, None])
                s = np.concatenate([top[who], np.where(own, NONE, s)], axis=1)
                i = np.concatenate([top_ids[who], np.where(own, LAST, np.broadcast_to(found, own.shape))], axis=1)
                best = np.lexsort((i, -s), axis=1)[:, :k]
                top[who], top_ids[who] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            full = live[top_ids[live, k - 1] != LAST]
            least[full] = np.maximum(least[full], top[full, k - 1])
        r, c = np.nonzero((top_ids != LAST) & (top >= floors[:, None]))
        return r, top_ids[r, c], top[r, c]


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The packed vectors of a batch."""
    data = b"".join(batch.column("x").to_pylist())
    return np.frombuffer(data, np.int64 if len(data) == 8 * dims * batch.num_rows else np.int32).reshape(batch.num_rows, dims).astype(np.int64)


_FIELDS = ["vec_id", "ord", "r", "part", "is_query", "floor", "x"]
_ROW = "vec_id long, ord int, r int, part int, is_query boolean, floor long, x binary"


def _search(dealt: DataFrame, k: int, dims: int, block: int) -> DataFrame:
    """(query_id, ord, vec_id, score) of the queries in each part of a range with its documents.

    A part's documents come first in its task and are held; queries stream past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tile, held = None, None, []
        for whole in batches:
            r, part = (whole.column(c).to_numpy() for c in ("r", "part"))
            cuts = np.concatenate([[0], np.flatnonzero((r[1:] != r[:-1]) | (part[1:] != part[:-1])) + 1, [len(r)]]) if len(r) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                batch = whole.slice(a, b - a)
                if place != (r[a], part[a]):
                    place, tile, held = (r[a], part[a]), None, []
                is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
                n = int(np.searchsorted(is_query, True))
                if n:
                    docs = batch.slice(0, n)
                    held.append((docs.column("vec_id").to_numpy(), docs.column("ord").to_numpy(), _matrix(docs, dims)))
                if n == batch.num_rows or not held and tile is None:
                    continue
                if held:
                    tile, held = Tile(*(np.concatenate(c) for c in zip(*held, strict=True)), block), []
                asked = batch.slice(n)
                ids, ords = asked.column("vec_id").to_numpy(), asked.column("ord").to_numpy()
                row, found, score = tile.search(ids, ords, _matrix(asked, dims), asked.column("floor").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ords[row]), pa.array(found), pa.array(score)], ["query_id", "ord", "vec_id", "score"])

    rows = dealt.repartition("r", "part").sortWithinPartitions("r", "part", "is_query")
    return rows.mapInArrow(task(run), "query_id long, ord int, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "ord").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, docs: DataFrame, k: int = 5, block: int = BLOCK, range_size: int = RANGE) -> DataFrame:
    """(query_id, ord, rank, vec_id, score): the k best documents of each query, ties to the smaller id.

    Both inputs are (vec_id long, v array<long>). Every row of `docs` is a candidate of every
    query but the query's own row; several rows of one id are candidates each, and as queries
    they are told apart by ord, their place among the id's vectors. Vectors may differ in
    length: a missing component counts as zero. Rows with a null id or vector take no part.
    Empty inputs give an empty result; a query without enough candidates has fewer rows.

    Ranges follow pivots that are drawn from the table, as many as ranges; they decide what is
    pruned and not what is found. A document is in one part of one range; queries go to the
    ranges that their bound lets them, and a group-limited window merges their results.
    """
    spark = docs.sparkSession

    def told_apart(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "v").filter("vec_id IS NOT NULL AND v IS NOT NULL")
        several = rows.groupBy("vec_id").count().filter("count > 1").limit(1).count() > 0
        return rows.withColumn("ord", (F.row_number().over(Window.partitionBy("vec_id").orderBy("v")) if several else F.lit(1)).cast("int"))

    docs, queries = told_apart(docs), told_apart(queries)
    size = lambda df: df.agg(F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    (n, dims, most), (m, dims_q, most_q) = size(docs), size(queries)
    if not n or not m:
        return spark.createDataFrame([], "query_id long, ord int, rank int, vec_id long, score long")
    dims, most = max(dims, dims_q, 1), max(most or 0, most_q or 0)
    kind = np.int32 if most < 1 << 31 else np.int64
    ranges = max(1, min(-(-n // range_size), CELLS // dims))
    drawn = docs.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < min(1.0, 2 * ranges / n) * (1 << 30)).select("v").limit(ranges)
    pivots = np.zeros((ranges, dims))
    for row, v in zip(pivots, [r["v"] for r in drawn.collect()], strict=False):  # CELLS numbers at most
        row[: len(v)] = v
    shared = spark.sparkContext.broadcast((pivots, (pivots**2).sum(axis=1)))

    def dense(column: pa.Array) -> np.ndarray:
        sizes = np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy()
        if (sizes == dims).all():
            return values.reshape(-1, dims)
        out = np.zeros((len(sizes), dims), np.int64)
        at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(sizes)), sizes), at] = values
        return out

    def packed(x: np.ndarray) -> pa.Array:
        data = np.ascontiguousarray(x.astype(kind))
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * dims * data.itemsize).astype(np.int32)), pa.py_buffer(data)])

    def deal(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, lengths = shared.value
            for batch in batches:
                x = dense(batch.column("v"))
                nearest = (lengths - 2 * x.astype(np.float64) @ centres.T).argmin(axis=1).astype(np.int32)
                arrays = [pa.array(nearest), pa.array(np.zeros(len(x), np.int32)), pa.array(np.full(len(x), is_query)), pa.array(np.full(len(x), NONE)), packed(x)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("ord"), *arrays], _FIELDS)

        return run

    d = written(docs.select("vec_id", "ord", "v").mapInArrow(task(deal(False)), _ROW))
    q = written(queries.select("vec_id", "ord", "v").mapInArrow(task(deal(True)), _ROW))
    counts = {r["r"]: r["count"] for r in d.groupBy("r").count().collect()}  # a row for each range
    parts = np.array([-(-counts.get(r, 0) // range_size) for r in range(ranges)])

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            x, r = _matrix(batch, dims), batch.column("r").to_numpy()
            for at in np.unique(r).tolist():
                a, b = x[r == at].min(axis=0), x[r == at].max(axis=0)
                low[at], high[at] = np.minimum(low.get(at, a), a), np.maximum(high.get(at, b), b)
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), *(pa.array([v.tolist() for v in side.values()], pa.list_(pa.int64())) for side in (low, high))], ["r", "low", "high"])

    per_task = d.select("r", "x").mapInArrow(task(boxes), "r int, low array<long>, high array<long>")
    low, high = np.full((ranges, dims), 0.0), np.full((ranges, dims), 0.0)
    per_range = per_task.select("r", F.posexplode(F.arrays_zip("low", "high"))).groupBy("r", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high")).toArrow()
    at = per_range.column("r").to_numpy(), per_range.column("pos").to_numpy()  # CELLS rows at most
    low[at], high[at] = per_range.column("low").to_numpy(), per_range.column("high").to_numpy()
    table = spark.sparkContext.broadcast((low, high, parts))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part to look at first: the range with the highest bound, a part of it by id."""
        low, high, parts = table.value
        for batch in batches:
            bounds = _bounds(_matrix(batch, dims), low, high)
            bounds[:, parts == 0] = -np.inf
            r = bounds.argmax(axis=1)
            part = batch.column("vec_id").to_numpy() % parts[r]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("ord"), pa.array(r, pa.int32()), pa.array(part, pa.int32()), *(batch.column(c) for c in _FIELDS[4:])], _FIELDS)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part of each range whose bound reaches the query's floor."""
        low, high, parts = table.value
        for batch in batches:
            near = _bounds(_matrix(batch, dims), low, high) >= batch.column("floor").to_numpy()[:, None]
            for r in np.flatnonzero(near.any(axis=0) & (parts > 0)).tolist():
                some = batch.take(pa.array(np.flatnonzero(near[:, r])))
                for part in range(int(parts[r])):
                    place = [pa.array(np.full(some.num_rows, v), pa.int32()) for v in (r, part)]
                    yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("ord"), *place, *(some.column(c) for c in _FIELDS[4:])], _FIELDS)

    part_of = F.element_at(F.lit(np.maximum(parts, 1).tolist()), F.col("r") + 1)
    d = d.withColumn("part", F.pmod(F.xxhash64("vec_id", "ord"), part_of).cast("int")) if parts.max() > 1 else d
    first = _search(d.unionByName(q.mapInArrow(task(home), _ROW)), k, dims, block)
    floors = _ranked(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "ord", F.col("score").alias("known"))
    routed = q.join(written(floors), ["vec_id", "ord"], "left").withColumn("floor", F.coalesce("known", F.lit(NONE))).select(*_FIELDS)
    found = _search(d.unionByName(routed.mapInArrow(task(route), _ROW)), k, dims, block)
    return _ranked(found, k).select("query_id", "ord", "rank", "vec_id", "score")
