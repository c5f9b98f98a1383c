"""Adjacent utterances of one character, merged across short gaps up to a length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loquela.functions.text import truthy_or
from loquela.operators.folds import greedy_packs


def merge_adjacent(rows: DataFrame, max_gap: float = 1.1, max_chars: int = 420, key: str = "session", enabled: bool = True) -> DataFrame:
    """Merge a row into the one before (in pos order, all speakers interleaved) when both are of
    one character (else speaker), the gap is within 0 and `max_gap`, the texts fit `max_chars`
    and the row absorbed no duplicate. The head keeps its fields; end comes from the last row.

    All conditions but the length look one row back, so they are one window; the length is a
    streamed fold.
    """
    if not enabled:
        return rows
    w = Window.partitionBy(key).orderBy("pos")
    name = truthy_or("", "character", "speaker")
    gap = F.col("start") - F.lag("end").over(w)
    absorbed = F.coalesce(F.size("deduped_from") > 0, F.lit(False)) if "deduped_from" in rows.columns else F.lit(False)
    joins = F.coalesce((name == F.lag(name).over(w)) & (gap >= 0) & (gap <= max_gap) & ~absorbed, F.lit(False))
    bare = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    sizes = F.struct(F.length("text").alias("full"), F.length(F.regexp_replace("text", r"(?U)^\s+", "")).alias("left"), bare.alias("bare"))
    slim = rows.select(key, "pos", joins.alias("joins"), sizes.alias("size"))
    packs = greedy_packs(slim, [key], ["pos"], "size", max_chars, "joins", "text").select(key, "pos", "pack")
    both = rows.join(packs, [key, "pos"])
    part = F.struct("start", "end", "text", "source_file", "speaker")
    head = [c for c in rows.columns if c != key]
    ends = ["end"] + (["end_hms"] if "end_hms" in rows.columns else [])
    grouped = both.groupBy(key, "pack").agg(
        F.min_by(F.struct(*head), "pos").alias("h"),
        F.max_by(F.struct(*ends), "pos").alias("t"),
        F.array_sort(F.collect_list(F.struct("pos", part.alias("x"), F.col("rms_db") if "rms_db" in rows.columns else F.lit(None).cast("double").alias("rms_db")))).alias("all"),
    )
    text = F.aggregate(F.expr("slice(all, 2, size(all))"), F.col("h.text"), lambda acc, x: F.concat(F.regexp_replace(acc, r"(?U)\s+$", ""), F.lit(" "), F.regexp_replace(x["x"]["text"], r"(?U)^\s+", "")))
    added = F.transform(F.expr("slice(all, 2, size(all))"), lambda x: x["x"])
    out = {c: F.col(f"h.{c}") for c in head}
    out["text"] = text
    out |= {c: F.col(f"t.{c}") for c in ends}
    if "rms_db" in rows.columns:
        out["rms_db"] = F.when(F.col("h.rms_db").isNotNull(), F.array_max(F.transform("all", lambda x: x["rms_db"])))
    if "merged_from" in rows.columns:
        old = F.coalesce(F.col("h.merged_from"), F.filter(added, lambda x: F.lit(False)))
        out["merged_from"] = F.when(F.size(added) > 0, F.concat(old, added)).otherwise(F.col("h.merged_from"))
    else:
        out["merged_from"] = F.when(F.size(added) > 0, added)
    return grouped.select(key, *[c.alias(n) for n, c in out.items()])
