"""Levels of PCM audio, and the gate that mutes bleed between synchronous tracks."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType
from pyspark.sql.window import Window

SILENCE = -120.0


def decode_pcm(raw: bytes, width: int) -> tuple[np.ndarray, float]:
    """(samples, full scale) of little-endian PCM of 1 to 4 bytes; a partial last sample is dropped."""
    raw = raw[: len(raw) // width * width]
    if width == 1:  # unsigned
        return np.frombuffer(raw, np.uint8).astype(np.float64) - 128, 128.0
    if width == 3:
        padded = np.zeros((len(raw) // 3, 4), np.uint8)
        padded[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (padded.view("<i4").ravel() >> 8).astype(np.float64), float(1 << 23)
    return np.frombuffer(raw, f"<i{width}").astype(np.float64), float(1 << (8 * width - 1))


@F.pandas_udf(StructType([StructField("rate", LongType()), StructField("frames", LongType())]))
def wav_info(content: pd.Series) -> pd.DataFrame:
    """Rate and frames of 16-bit mono WAV bytes; null for anything else."""
    rows = []
    for data in content:
        try:
            with wave.open(io.BytesIO(data)) as w:
                rows.append((w.getframerate(), w.getnframes()) if (w.getsampwidth(), w.getnchannels()) == (2, 1) else (None, None))
        except (wave.Error, EOFError, TypeError):
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["rate", "frames"], dtype="Int64")


def pcm_level(raw: bytes, width: int) -> float | None:
    """RMS in dB of full scale of PCM samples; none without a sample."""
    samples, scale = decode_pcm(raw, width)
    if not len(samples):
        return None
    rms = float(np.sqrt(np.mean(samples**2))) / scale
    return 20 * float(np.log10(rms)) if rms > 0 else SILENCE


def level(data: bytes | None, start: float, end: float) -> float | None:
    """RMS in dB of full scale of a slice of WAV bytes; channels count as interleaved samples."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            rate, n = w.getframerate(), w.getnframes()
            a, b = max(0, min(n, int(start * rate))), max(0, min(n, int(end * rate)))
            if b <= a:
                return None
            w.setpos(a)
            return pcm_level(w.readframes(b - a), w.getsampwidth())
    except (wave.Error, EOFError, TypeError):
        return None


@F.pandas_udf(DoubleType())
def slice_rms_db(content: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([level(d, s, e) for d, s, e in zip(content, start, end, strict=True)], dtype="float64")


@F.pandas_udf(ArrayType(DoubleType()))
def wav_envelope(content: pd.Series, window_ms: pd.Series) -> pd.Series:
    """Levels of the whole windows of 16-bit mono WAV bytes."""
    out = []
    for data, ms in zip(content, window_ms, strict=True):
        try:
            with wave.open(io.BytesIO(data)) as w:
                size = int(w.getframerate() * ms / 1000)
                x = decode_pcm(w.readframes(w.getnframes()), 2)[0] / 32768
        except (wave.Error, EOFError, TypeError):
            out.append(None)
            continue
        x = x[: len(x) // size * size].reshape(-1, size)
        out.append((20 * np.log10(np.sqrt((x**2).mean(axis=1)) + 1e-10)).tolist())
    return pd.Series(out)


def array_rms_db(samples: Column) -> Column:
    """Level of a sample array, in the JVM; null if empty, the floor if silent."""
    energy = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")) / F.size(samples)
    return F.when(F.size(samples) > 0, F.when(energy > 0, 20 * F.log10(F.sqrt(energy))).otherwise(F.lit(SILENCE)))


def envelope(samples: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(keys, win, db) of (keys, i, x) samples: whole windows only."""
    found = samples.groupBy(*keys, F.floor(F.col("i") / window).cast("long").alias("win")).agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("x")).alias("e"))
    return found.filter(F.col("n") == window).select(*keys, "win", (20 * F.log10(F.sqrt("e") + 1e-10)).alias("db"))


def aligned(windows: DataFrame, session: str = "session", track: str = "track") -> DataFrame:
    """Windows that every track of the session reaches."""
    ends = windows.groupBy(session, track).agg(F.max("win").alias("m")).groupBy(session).agg(F.min("m").alias("_last"))
    return windows.join(ends, session).filter(F.col("win") <= F.col("_last")).drop("_last")


def leader_gate(windows: DataFrame, margin_db: float = 6.0, floor_db: float = -55.0, dilate: int = 2, session: str = "session", track: str = "track") -> DataFrame:
    """(session, track, win, db, leader, keep): a window is kept within the margin of the loudest
    track, or where all are quiet, and next to kept windows of its track."""
    leader = F.max("db").over(Window.partitionBy(session, "win"))
    near = Window.partitionBy(session, track).orderBy("win").rowsBetween(-dilate, dilate)
    judged = windows.withColumn("leader", leader).withColumn("_k", ((F.col("db") >= F.col("leader") - margin_db) | (F.col("leader") <= floor_db)).cast("int"))
    return judged.withColumn("keep", F.max("_k").over(near) == 1).drop("_k")


def muted_share(gated: DataFrame, session: str = "session", track: str = "track") -> DataFrame:
    return gated.groupBy(session, track).agg((1 - F.avg(F.col("keep").cast("int"))).alias("muted"))


@F.pandas_udf(ArrayType(FloatType()))
def apply_gain(samples: pd.Series, keep: pd.Series, window: pd.Series) -> pd.Series:
    """Samples times a gain that runs linearly between the centres of kept (1) and muted (0) windows."""
    out = []
    for x, k, size in zip(samples, keep, window, strict=True):
        centres = (np.arange(len(k)) + 0.5) * size
        out.append((np.asarray(x, np.float32) * np.interp(np.arange(len(x)), centres, np.asarray(k, float))).astype(np.float32) if len(k) else np.asarray(x, np.float32))
    return pd.Series(out)
