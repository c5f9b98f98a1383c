"""Best-fit packing of token pieces into sequences, hierarchically.

Groups of bounded size pack their pieces best-fit, longest first. Full bins are final. The others
become single items of the next round, in which a fan of groups is packed together, and so on up
a tree to one group. Only (bin, fill) pairs travel after the first round; where a piece lies
follows from joining the rounds' small maps.

Two bins over half full never fit together, and best fit leaves one other a group at most. So
above the first round nothing is ever put into a bin but one of these others, of which there are
no more than groups. A group hands on as many of its emptiest bins as there were groups: whatever
fits a bin that stays behind fits all of these, and one of them is left for it. Nothing is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loquela.llm._shared import in_slices, task, written
from loquela.llm.tokens import encoder

CAPACITY = 2048
#: Pieces in a group of the first round; groups that meet in a group of the next.
GROUP, FAN = 50_000, 8


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full length but perhaps the first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = [*([0] if head else []), *range(head, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]) of every document.

    Null and empty texts are the end id alone. Every row of a repeated document has its own
    pieces. Texts are tokenised whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, spaced=True).encode, np.array([end_id], "<u4").tobytes()
        for batch in in_slices(batches, "text"):
            owner, rows = [], []
            for i, ids in enumerate(encode(batch.column("text"))):
                ids += end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    owner.append(i)
                    rows.append((k, start, n, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), *arrays], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task(run), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, taken in the order given: the fullest bin with room, else a new one."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, made = 0, 0  # bit r: some bin has room r
    for i, n in enumerate(sizes.tolist()):
        fits = rooms >> n
        if fits:
            room = (fits & -fits).bit_length() - 1 + n
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            free[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets


def _round(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Pack (g, ..., length) rows within each g: adds bin, offset and fill."""
    tie = [c for c in items.columns if c not in ("g", "length")]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *tie], ascending=[False, *[True] * len(tie)], kind="stable")
        bins, rows["offset"] = best_fit(rows["length"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=rows["length"].to_numpy()).astype(np.int64)
        rows["fill"] = fill[bins]
        rows["bin"] = (level << 56) + (rows["g"].to_numpy().astype(np.int64) << 28) + bins
        return rows

    kinds = ", ".join(f"{n} {k}" for n, k in items.dtypes)
    return items.groupBy("g").applyInPandas(pack, f"{kinds}, offset long, fill long, bin long")


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """The rows of `items` (with doc_id, piece, length), each with sequence_id and offset.

    Sequences are gapless from offset 0 and hold at most `capacity`; no piece is split or
    dropped. Lengths are 1 to capacity. Ties are taken by doc_id and piece, so a task that
    runs again packs alike; repeated rows are separate pieces. No rows: no sequences.
    """
    n = items.count()
    groups = max(1, -(-n // group))
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without an id are many alike
    dealt = items.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "length", place), F.lit(groups)).cast("long"))
    packed = written(_round(dealt, 0, capacity))
    most = groups  # bins of up to half the capacity in all groups together
    emptiest = F.row_number().over(Window.partitionBy("g").orderBy("length", "bin"))

    def unfilled(rows: DataFrame) -> DataFrame:
        """The bins of each group that may take something or be put into another: its emptiest, as many as there
        are small bins anywhere, and one more, as its own small bin is the first of them."""
        bins = rows.filter(F.col("fill") < capacity).groupBy("g", "bin").agg(F.first("fill").alias("length"))
        return bins.withColumn("_n", emptiest).filter(F.col("_n") <= most + 1).drop("_n")

    open_bins = unfilled(packed)
    roots = open_bins.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"))
    level = 0
    while groups > 1:
        level, groups = level + 1, -(-groups // fan)
        up = open_bins.select(F.floor(F.col("g") / fan).cast("long").alias("g"), F.col("bin").alias("child"), "length")
        made = written(_round(up, level, capacity))
        step = made.select(F.col("child").alias("root"), F.col("bin").alias("up"), F.col("offset").alias("by"))
        roots = written(roots.join(step, "root", "left").select("bin", F.coalesce("up", "root").alias("root"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")))
        open_bins = unfilled(made)
    if level == 0:
        return packed.withColumnRenamed("bin", "sequence_id").drop("g", "fill")
    joined = packed.join(roots, "bin", "left")
    place = F.col("offset") + F.coalesce("shift", F.lit(0))
    return joined.withColumns({"sequence_id": F.coalesce("root", "bin"), "offset": place}).drop("g", "fill", "bin", "root", "shift")
