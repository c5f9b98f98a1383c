"""Ordered folds that only need the row before: islands by a running sum, greedy packs by a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: list[str], order: list[str], joins: Column, name: str = "island") -> DataFrame:
    """Number runs of rows that each join the one before; `joins` is false on a first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_j", F.coalesce(joins, F.lit(False))).withColumn(name, F.sum(F.when(F.col("_j"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_j")


def numbered(df: DataFrame, order: list[str], name: str = "place", buckets: int = 64) -> DataFrame:
    """Number all rows from 1 by `order` (no nulls, no ties) without one task that sorts them all.

    Bounds from a sample of keys deal rows into ordered buckets; a bucket's rows are numbered on
    their own, behind the counts of the buckets before it. The bounds decide the balance only.
    """
    dealt = in_ranges(df, order, buckets)
    counts = {r["_b"]: r["count"] for r in dealt.groupBy("_b").count().collect()}  # as many rows as buckets
    before = F.array(*[F.lit(sum(n for b, n in counts.items() if b < i)).cast("long") for i in range(max(counts, default=0) + 1)])
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) + F.element_at(before, F.col("_b") + 1)
    return dealt.withColumn(name, place).drop("_b")


def in_ranges(df: DataFrame, order: list[str], buckets: int = 64) -> DataFrame:
    """The rows with _b, the number of their range of `order` (no nulls); bounds come from a sample of keys."""
    key = F.struct(*[F.col(c) for c in order])
    every = max(1, df.count() // (20 * buckets))
    drawn = df.filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(key.alias("k")).limit(100 * buckets).collect()
    keys = sorted(tuple(r["k"]) for r in drawn)
    bounds = [keys[i * len(keys) // buckets] for i in range(1, buckets)] if len(keys) >= buckets else []
    kinds = dict(df.dtypes)
    literal = [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, b, strict=True)]) for b in bounds]
    return df.withColumn("_b", F.size(F.filter(F.array(*literal), lambda b: b <= key)) if bounds else F.lit(0))


def long_islands(df: DataFrame, keys: list[str], order: list[str], look: list[str], joins: Callable[[Column], Column], name: str = "island", buckets: int = 64) -> DataFrame:
    """islands() where one key may hold most rows (keys and order without nulls, no ties in order).

    `joins` gets a struct of the row before (`look`, null on a first row). A key is cut into
    ranges of the order: a range's first row sees the last row of the range before, and its
    islands count on from there, so no task holds a whole key.
    """
    cut = [*keys, "_b"]

    def beside(rows: DataFrame, few: DataFrame) -> DataFrame:  # null-safe: an equality makes Spark infer filters with columns of the other side
        few = few.withColumnsRenamed({c: f"_r{i}" for i, c in enumerate(cut)})
        same = [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(cut)]
        return rows.join(few, same).drop(*[f"_r{i}" for i in range(len(cut))])

    dealt = in_ranges(df, order, buckets)
    ranges = Window.partitionBy(*keys).orderBy("_b")
    last = dealt.groupBy(*cut).agg(F.max_by(F.struct(*look), F.struct(*order)).alias("_p")).select(*cut, F.lag("_p").over(ranges).alias("_p"))
    w = Window.partitionBy(*cut).orderBy(*order)
    found = beside(dealt, last).withColumn("_p", F.coalesce(F.lag(F.struct(*look)).over(w), F.col("_p")))
    found = found.withColumn("_s", F.when(F.coalesce(joins(F.col("_p")), F.lit(False)), 0).otherwise(1)).drop("_p")
    sums = found.groupBy(*cut).agg(F.sum("_s").alias("_n"))
    sums = sums.select(*cut, F.coalesce(F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    here = F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return beside(found, sums).withColumn(name, (here + F.col("_n")).cast("long")).select(*df.columns, name)


def greedy_packs(df: DataFrame, keys: list[str], order: list[str], cost: str, limit: float, joins: str | None = None, mode: str = "sum", name: str = "pack") -> DataFrame:
    """Pack consecutive rows: a row joins the open pack while the pack stays within `limit`.

    mode "sum": the pack's summed cost; an oversized row is a pack of its own. mode "span":
    cost is an end position, compared with the first row's `order[0]`. mode "text": cost is a
    struct (full, left-stripped, stripped) of text lengths, added as texts joined by a space.
    A false `joins` column starts a new pack in any case. Each key is folded in a stream over
    its sorted rows, so a task holds one batch and not a group.
    """
    columns = [*df.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pack, size, first, bare = None, -1, 0, 0.0, 0
        for rows in batches:
            own = list(rows[keys].itertuples(index=False, name=None)) if keys else [()] * len(rows)
            costs, starts = rows[cost].tolist(), rows[order[0]].tolist()
            joined = rows[joins].tolist() if joins else [True] * len(rows)
            out = []
            for k, c, s, j in zip(own, costs, starts, joined, strict=True):
                if k != key:
                    key, pack, fresh = k, -1, True
                elif mode == "span":
                    fresh = not j or c - first > limit
                elif mode == "text":
                    fresh = not j or size + c["full"] > limit
                else:
                    fresh = not j or size + c > limit
                if fresh:
                    pack, first = pack + 1, s
                    size = c["full"] if mode == "text" else c
                    bare = c["bare"] if mode == "text" else 0
                elif mode == "text":
                    size = bare + 1 + c["left"]
                    bare = bare + 1 + c["bare"] if c["bare"] else bare
                elif mode == "sum":
                    size += c
                out.append(pack)
            yield rows.assign(**{name: out})

    dealt = df.repartition(*keys) if keys else df.repartition(1)  # an exchange: what comes before it stays parallel
    kinds = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {name} long").select(*columns, name)


def vad_regions(frames: DataFrame, keys: list[str], gap: float = 0.3) -> DataFrame:
    """Merge speech intervals (start, end) that follow within `gap`: keys, start, end of each region."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    numbered = islands(frames, keys, ["start", "end"], F.col("start") - F.lag("end").over(w) <= gap)
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end")).drop("island")


def vad_buckets(regions: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Number greedy buckets of regions no longer than `seconds`; a region stays whole."""
    return greedy_packs(regions, keys, ["start", "end"], "end", seconds, mode="span", name="bucket")


def speech_share(regions: DataFrame, keys: list[str], duration: str) -> DataFrame:
    """Summed speech and its share of the track's duration."""
    total = F.sum(F.col("end") - F.col("start"))
    return regions.groupBy(*keys).agg(total.alias("speech"), (total / F.max(duration)).alias("share"))
