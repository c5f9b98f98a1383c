"""Text, time and hash expressions. All but the two marked ones are plain Columns."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def truthy_or(default: str, *names: str) -> Column:
    """The first of the named string columns that is neither null nor empty, else the default."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(default))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(text: Column) -> Column:
    """Without white space (Unicode's) at either end; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Stripped, inner white space runs as one space."""
    return F.regexp_replace(stripped(text), r"(?U)\s+", " ")


def filter_form(text: Column) -> Column:
    """The form that phrase filters compare: collapsed, lower case, yo as ye; punctuation stays."""
    return F.translate(F.lower(collapsed(text)), "ё", "е")


def words_of(norm: Column) -> Column:
    """Words of a filter form."""
    return F.regexp_extract_all(norm, F.lit("[a-zа-я0-9]+"), F.lit(0))


def _clock(seconds: Column) -> tuple[Column, Column, Column, Column]:
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.floor(s).cast("long")
    return F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), (whole % 60).cast("long"), F.bround((s - F.floor(s)) * 1000).cast("long")


def hms(seconds: Column) -> Column:
    """H:MM:SS, seconds floored and not below zero."""
    h, m, s, _ = _clock(seconds)
    return F.format_string("%d:%02d:%02d", h, m, s)


def hms_ms(seconds: Column, mark: str = ".") -> Column:
    """HH:MM:SS.mmm; milliseconds round half to even and don't carry, so .9996 s prints .1000."""
    h, m, s, ms = _clock(seconds)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h, m, s, ms)


def srt_time(seconds: Column) -> Column:
    """The same with the comma of subtitle files."""
    return hms_ms(seconds, ",")


def fingerprint16(text: Column) -> Column:
    """First 16 hex digits of a text's SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def file_fingerprint(name: Column, size: Column, modified: Column) -> Column:
    """Of a file's name, size and modification time in whole seconds."""
    return fingerprint16(F.concat_ws(":", name, size.cast("string"), F.floor(modified.cast("double")).cast("long").cast("string")))


def struct_hash(**fields: Column) -> Column:
    """Stable hash of named values: fields in name order, nulls kept."""
    named = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return fingerprint16(F.to_json(named, {"ignoreNullFields": "false"}))


def with_defaults(record: Column, defaults: dict[str, object]) -> Column:
    """A struct whose missing or null fields take the defaults."""
    return F.struct(*[F.coalesce(record[k], F.lit(v)).alias(k) for k, v in defaults.items()])


def duration_seconds(text: Column) -> Column:
    """Sum of the amounts in texts like 6m0s, 1.5s, 20ms or 1h2m3s; null where there is none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)(ms|h|m|s)"), F.lit(0))
    unit = lambda x: F.regexp_extract(x, r"(ms|h|m|s)$", 1)
    amount = lambda x: F.regexp_extract(x, r"^([0-9.]+)", 1).cast("double")
    scale = lambda x: F.when(unit(x) == "ms", 0.001).when(unit(x) == "h", 3600.0).when(unit(x) == "m", 60.0).otherwise(1.0)
    total = F.aggregate(found, F.lit(0.0), lambda acc, x: acc + amount(x) * scale(x))
    return F.when(F.size(found) > 0, total)


def token_estimate(prompt: Column, max_output_tokens: int) -> Column:
    """Input tokens at three characters each, plus the output allowance."""
    return F.floor(F.length(prompt) / 3).cast("long") + F.lit(max_output_tokens)


def repair_json_text(raw: str | None) -> str:
    """NFC, code fence off, typographic quotes plain, byte order marks out."""
    text = unicodedata.normalize("NFC", raw or "").strip()
    if fence := re.match(r"```(?:json)?\s*", text, re.IGNORECASE):
        text = re.sub(r"\s*```\Z", "", text[fence.end() :])
    for typographic, plain in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("﻿", "")):
        text = text.replace(typographic, plain)
    return text.strip()


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; no builtin does it (Arrow)."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def strict_object(text: pd.Series) -> pd.Series:
    """Repaired JSON text if it is one object and nothing else, otherwise null (Arrow)."""

    def one(raw: str | None) -> str | None:
        try:
            repaired = repair_json_text(raw)
            return repaired if isinstance(json.loads(repaired), dict) else None
        except ValueError:
            return None

    return text.map(one)


def filter_graph(
    *, highpass_hz: int | None = 80, lowpass_hz: int | None = None, noise_floor_db: int | None = -25,
    gate: tuple[float, float, float, float] | None = (-45, 6, 10, 250), loudnorm: tuple[float, float, float] | None = None, sample_rate: int = 16000,
) -> str:
    """An audio filter chain that keeps the time axis: stages that are set, in a fixed order."""
    stages = [
        f"highpass=f={int(highpass_hz)}" if highpass_hz is not None else None,
        f"lowpass=f={int(lowpass_hz)}" if lowpass_hz is not None else None,
        f"afftdn=nf={int(noise_floor_db)}" if noise_floor_db is not None else None,
        "agate=threshold={}dB:ratio={}:attack={}:release={}".format(*gate) if gate else None,
        "loudnorm=I={}:TP={}:LRA={}".format(*loudnorm) if loudnorm else None,
        f"aresample={int(sample_rate)}",
    ]
    return ",".join(s for s in stages if s)
