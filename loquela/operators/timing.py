"""Timing repair: caps on segment ends by the next start, by text length, and by order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loquela.functions.text import collapsed, hms_ms, let, truthy_or


@dataclass(frozen=True)
class TimingRules:
    """Seconds and characters; a segment's text allows it a longest duration."""

    enabled: bool = True
    shortest: float = 0.8
    slack: float = 0.05
    short_chars: int = 40
    short_cap: float = 4.0
    medium_chars: int = 90
    medium_cap: float = 7.0
    long_cap: float = 18.0
    chars_per_second: float = 13.0
    padding: float = 1.2


def longest_duration(text: Column, rules: TimingRules = TimingRules()) -> Column:
    return let(F.length(collapsed(text)), lambda n: _cap(n, rules))


def _cap(n: Column, rules: TimingRules) -> Column:
    long = F.greatest(F.lit(rules.shortest), F.least(F.lit(rules.long_cap), n / max(1.0, rules.chars_per_second) + rules.padding))
    return F.when(n <= rules.short_chars, F.lit(rules.short_cap)).when(n <= rules.medium_chars, F.lit(rules.medium_cap)).otherwise(long)


def _noted(df: DataFrame, changed: Column, end: Column, why: str) -> DataFrame:
    changed = F.coalesce(changed, F.lit(False))
    notes = F.coalesce("timing_repair", F.array().cast("array<string>"))
    return df.withColumns({"timing_repair": F.when(changed, F.array_append(notes, F.lit(why))).otherwise(F.col("timing_repair")), "end": F.when(changed, end).otherwise(F.col("end"))})


def cap_to_next(rows: DataFrame, rules: TimingRules = TimingRules(), keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """End a segment where the next one of its source starts. Only starts are read ahead, and
    they never change, so one window does it."""
    w = Window.partitionBy(*keys, truthy_or("?", "source_file", "speaker")).orderBy("start", "end", "pos")
    after = rows.withColumn("_next", F.lead("start").over(w))
    late = (F.col("_next") > F.col("start") + rules.shortest) & (F.col("end") > F.col("_next") + rules.slack)
    return _noted(after, late, F.col("_next"), "cap_to_next_same_source").drop("_next")


def cap_by_text(rows: DataFrame, rules: TimingRules = TimingRules()) -> DataFrame:
    cap = longest_duration(F.col("text"), rules)
    return _noted(rows, F.col("end") - F.col("start") > cap, F.col("start") + F.greatest(F.lit(rules.shortest), cap), "cap_by_text_length")


def positive(rows: DataFrame, rules: TimingRules = TimingRules()) -> DataFrame:
    return _noted(rows, F.col("end") <= F.col("start"), F.col("start") + rules.shortest, "ensure_positive_duration")


def repair(rows: DataFrame, rules: TimingRules = TimingRules(), keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """All three passes in order; row order stays, end_hms follows end. Disabled: unchanged."""
    if not rules.enabled:
        return rows
    if "timing_repair" not in rows.columns:
        rows = rows.withColumn("timing_repair", F.lit(None).cast("array<string>"))
    done = positive(cap_by_text(cap_to_next(rows, rules, keys), rules), rules)
    return done.withColumn("end_hms", hms_ms(F.col("end"))) if "end_hms" in rows.columns else done
