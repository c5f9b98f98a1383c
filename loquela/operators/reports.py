"""Aggregates over extraction results: timelines, dice statistics, scoreboards, synthesis input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquela.functions.text import truthy_or, with_defaults

# What a report record holds where a field is missing or null.
ACTION_DEFAULTS = {"time": "", "character": "", "action": "", "outcome": "", "importance": ""}
ROLL_DEFAULTS = {"time": "", "character": "", "roll_type": "", "die": "", "context": "", "confidence": ""}
SIGNAL_DEFAULTS = {"time": "", "character": "", "category": "", "reason": ""}
SCENE_DEFAULTS = {"title": "", "chunk_index": 0, "time": "", "image_prompt": ""}


def flatten(results: DataFrame, column: str) -> DataFrame:
    """The elements of an array column of all results: file (order key), at (place), then the fields."""
    return results.select("file", F.posexplode(column).alias("at", "x")).filter("x IS NOT NULL").select("file", "at", "x.*")


def weight(variant: Column) -> Column:
    """A signal's weight as a whole number: numbers truncate, strings of a whole number parse,
    anything else (missing, text, fractions in quotes, infinities) counts 1."""
    shown = F.trim(F.to_json(variant))
    quoted = shown.startswith('"')
    inside = F.regexp_extract(shown, r'^"\s*([+-]?\d+)\s*"$', 1)
    number = F.when(F.upper(shown) == "TRUE", 1).when(F.upper(shown) == "FALSE", 0).otherwise(shown.try_cast("decimal(38,9)").try_cast("long"))
    return F.coalesce(F.when(quoted, F.nullif(inside, F.lit("")).try_cast("long")).otherwise(number), F.lit(1)).cast("long")


def signals(results: DataFrame) -> DataFrame:
    """Scoring signals in file order, weights coerced."""
    return flatten(results, "mvp_signals").withColumn("weight", weight(F.col("weight")))


def dice_stats(rolls: DataFrame, die: str | None = None) -> DataFrame:
    """Mean, count, twenties and ones of the natural rolls of each character.

    Rows without a natural value take no part. All die types are mixed unless `die` names one.
    One partial and one final hash aggregate: the shuffle carries a row for each character and task.
    """
    n = F.col("natural")
    if die:
        rolls = rolls.filter(F.col("die") == die)
    return (
        rolls.filter(n.isNotNull())
        .groupBy(truthy_or("?", "character").alias("character"))
        .agg(
            F.avg(n).alias("avg_natural"),
            F.count("*").alias("n"),
            F.count_if(n == 20).alias("nat20"),
            F.count_if(n == 1).alias("nat1"),
        )
    )


def scores(found: DataFrame, *order: str) -> DataFrame:
    """(character, score, first): summed weights, and the first place of each for ties."""
    return found.groupBy(truthy_or("?", "character").alias("character")).agg(F.sum("weight").alias("score"), F.min(F.struct(*order)).alias("first"))


def scoreboard(found: DataFrame, *order: str) -> DataFrame:
    """Scores, best first; ties by first appearance."""
    return scores(found, *order).orderBy(F.col("score").desc(), "first").select("character", "score")


def category_scores(found: DataFrame) -> DataFrame:
    """(character, category, score)."""
    return found.groupBy(truthy_or("?", "character").alias("character"), truthy_or("?", "category").alias("category")).agg(F.sum("weight").alias("score"))


def category_maps(found: DataFrame) -> DataFrame:
    """(character, categories map): the nested form of category_scores()."""
    return category_scores(found).groupBy("character").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "score")))).alias("categories"))


def top_signals(found: DataFrame, *order: str, n: int = 30) -> DataFrame:
    """The n heaviest signals, earlier ones first among equals: a top-k without a full sort."""
    return found.orderBy(F.col("weight").desc(), *order).limit(n)


def timeline(actions: DataFrame) -> DataFrame:
    """Actions by time as text, those without one first, then in file order."""
    return actions.orderBy(F.coalesce("time", F.lit("")), "file", "at")


def key_actions(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("importance") == "high")


def summaries(results: DataFrame) -> DataFrame:
    """(chunk_index, summary) of results that have a summary, in file order."""
    return results.filter(F.coalesce("summary", F.lit("")) != "").orderBy("file").select("chunk_index", "summary")


def filled(rows: DataFrame, defaults: dict[str, object], *also: str) -> DataFrame:
    """Rows with missing and null fields at their defaults; `also` columns stay as they are."""
    record = with_defaults(F.struct(*[F.col(c) for c in defaults]), defaults)
    return rows.select(record.alias("r"), *also).select("r.*", *also)


def synthesis_input(results: DataFrame) -> dict[str, DataFrame]:
    """What a session's synthesis starts from: summaries, the top signals, the key actions."""
    return {"summaries": summaries(results), "mvp_top": top_signals(signals(results), "file", "at"), "key_actions": key_actions(timeline(flatten(results, "actions")))}


def as_text(value: Column) -> Column:
    """A variant as text: null is empty, lists join by a blank line (two levels), else the value."""
    one = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    items = lambda v: F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: x.isNotNull() & ~F.is_variant_null(x))
    inner = lambda v: F.when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.array_join(F.transform(items(v), one), "\n\n")).otherwise(one(v))
    outer = F.array_join(F.transform(items(value), inner), "\n\n")
    return F.when(value.isNull() | F.is_variant_null(value), F.lit("")).when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), outer).otherwise(one(value))


def scenes_with_images(scenes: DataFrame, images: DataFrame) -> DataFrame:
    """Scenes (n from 1) with the file of their number, null where there is none."""
    return scenes.join(images.select("n", "file"), "n", "left").orderBy("n")


def party_with_files(party: DataFrame, files: DataFrame) -> DataFrame:
    """Members with ref_file set where the file that `ref` names exists."""
    return party.join(files.select(F.col("name").alias("ref"), F.col("name").alias("ref_file")).distinct(), "ref", "left")
