"""Tables from JSONL, JSON documents, result folders and file listings."""

from __future__ import annotations

import json
import logging
import re
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loquela import schema
from loquela.functions.text import strict_object

log = logging.getLogger(__name__)
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg")


def exists(spark: SparkSession, uri: str) -> bool:
    """Through the URI's own file system, so cluster stores work too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_jsonl(spark: SparkSession, path: str, row: str = schema.SEGMENT) -> DataFrame:
    """Rows of a JSONL file with pos by line; a missing file is empty, blank lines are skipped,
    a line that is not JSON of the schema raises.

    Line order is the reader's split and row order, which monotonically_increasing_id follows.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"{row}, pos long")
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("pos", F.monotonically_increasing_id())
    parsed = lines.select(F.from_json("value", row, {"mode": "FAILFAST"}).alias("r"), "pos")
    return parsed.select("r.*", "pos")


def read_json(path: str | Path) -> dict:
    """One small driver-side document."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(results with their file name, file names of rejected ones) of a folder's *.json.

    Files are repaired (typographic quotes, fences, marks) and must then be one JSON object;
    others are rejected and the rest survives. Numbers in quotes don't count as numbers.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], f"file string, {schema.RESULT}"), spark.createDataFrame([], "file string")
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    checked = raw.select(F.col("_metadata.file_name").alias("file"), strict_object("value").alias("json"))
    good = checked.filter("json IS NOT NULL").select("file", F.from_json("json", schema.RESULT).alias("r")).select("file", "r.*")
    return good, checked.filter("json IS NULL").select("file")


def missing_fields(json_text: Column, required: tuple[str, ...] = schema.RESULT_FIELDS) -> Column:
    """Required keys that an object lacks; a key with null is there. Null for what is no object."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.json_object_keys(json_text))


def discover_tracks(listing: list[str], cfg: dict) -> list[dict]:
    """Tracks of a session from its file names.

    Configured tracks win. Otherwise audio files by name, without excluded ones and the master
    mix; the session's prefix goes, the first ". " parts speaker and character, and the game
    master's speaker has priority 100, others 50.
    """
    if cfg.get("tracks"):
        return list(cfg["tracks"])
    suffixes = {s.lower() for s in cfg.get("audio_extensions") or [".wav"]}
    left_out = {*(cfg.get("exclude") or []), cfg.get("master_mix")}
    prefix, found = f"{cfg.get('session_name', '')}-", []
    for name in sorted(listing):
        if Path(name).suffix.lower() not in suffixes or name in left_out:
            continue
        stem = Path(name).stem.removeprefix(prefix)
        speaker, mark, character = stem.partition(". ")
        priority = 100 if cfg.get("dm_speaker") and speaker == cfg["dm_speaker"] else 50
        found.append({"file": name, "speaker": speaker, "character": character if mark else speaker, "priority": priority})
    if not found:
        log.warning("no audio tracks found")
    return found


def track_table(spark: SparkSession, tracks: list[dict]) -> DataFrame:
    """Tracks as a dimension table, index from 1."""
    rows = [(t["file"], t.get("speaker"), t.get("character"), int(t.get("priority", 50)), i) for i, t in enumerate(tracks, 1)]
    return spark.createDataFrame(rows, "file string, speaker string, character string, priority int, index int")


def with_track_defaults(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows with speaker, character and priority of their track where they lack their own."""
    t = tracks.select(F.col("file").alias("source_file"), *[F.col(c).alias(f"_{c}") for c in ("speaker", "character", "priority", "index")])
    joined = rows.join(t, "source_file", "left")
    fill = {"speaker": "_speaker", "character": "_character", "speaker_priority": "_priority", "track_index": "_index"}
    return joined.withColumns({k: F.coalesce(F.col(k), F.col(v)) if k in rows.columns else F.col(v) for k, v in fill.items()}).drop(*fill.values())


def read_party(spark: SparkSession, folder: str | Path) -> DataFrame:
    """Members with a name from party.json; a missing, invalid or other file is an empty party."""
    empty = spark.createDataFrame([], schema.PARTY)
    file = Path(folder) / "party.json"
    if not file.is_file():
        return empty
    try:
        found = json.loads(file.read_text(encoding="utf-8"))
    except ValueError:
        found = None
    if not isinstance(found, list):
        log.warning("party.json is not a list")
        return empty
    text = [(json.dumps(m, ensure_ascii=False),) for m in found if isinstance(m, dict) and m.get("name")]
    return spark.createDataFrame(text, "j string").select(F.from_json("j", schema.PARTY).alias("r")).select("r.*") if text else empty


def scene_images(spark: SparkSession, folder: str) -> DataFrame:
    """(n, file): the first image by name for each scene number; contents are never read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "n int, file string")
    names = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    number = F.regexp_extract("file", r"(?i)^scene(\d+).*\.(?:png|jpe?g)$", 1)
    return names.select(number.alias("n"), "file").filter("n <> ''").groupBy(F.col("n").cast("int").alias("n")).agg(F.min("file").alias("file"))


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, modified) of a folder's files."""
    return spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The extraction ledger; missing is empty."""
    return spark.read.schema(schema.LEDGER).json(path) if exists(spark, path) else spark.createDataFrame([], schema.LEDGER)


class SegmentSource(Protocol):
    """Where raw segments come from: speech recognition behind one method, or stored rows."""

    def segments(self, spark: SparkSession, track: dict) -> DataFrame: ...


class StoredSegments:
    """Segments of a JSONL or Parquet file, one table for all tracks."""

    def __init__(self, path: str):
        self.path = path

    def segments(self, spark: SparkSession, track: dict) -> DataFrame:
        rows = spark.read.parquet(self.path) if self.path.rstrip("/").endswith(".parquet") else read_jsonl(spark, self.path)
        return rows.filter(F.col("source_file") == track["file"])




def safe_name(name: str) -> str:
    return re.sub(r"[^\w.\-]+", "_", name).strip("_")
