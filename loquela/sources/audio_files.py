"""Audio files of a session: cleaning, limiting and gating, each cached by what it depends on."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import shutil
import subprocess
import wave
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np

from loquela.functions.text import filter_graph

log = logging.getLogger(__name__)
BLOCK = 4096  # windows read at once
Runner = Callable[[list[str]], None]


def signature(**parts: Any) -> str:
    """16 hex digits that change with any of the named parts."""
    return hashlib.sha1(json.dumps(parts, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:16]


def file_mark(path: Path) -> str:
    s = path.stat()
    return hashlib.sha1(f"{path.name}:{s.st_size}:{int(s.st_mtime)}".encode()).hexdigest()[:16]


def transcription_signature(track: dict[str, Any], cfg: dict[str, Any], path: Path, heard: Path | None = None) -> str:
    """Of all that a track's recognised rows depend on: the file, the one made from it, settings."""
    keys = (
        "transcription_backend", "model_size", "mlx_model", "language", "beam_size", "word_timestamps", "condition_on_previous_text", "use_vad", "vad_min_silence_ms",
        "vad_speech_pad_ms", "vad_min_speech_ms", "vad_merge_gap_sec", "vad_bucket_minutes", "decode", "limit_minutes", "preprocess",
    )
    return signature(file=file_mark(path), heard=file_mark(heard or path), own=track.get("preprocess"), **{k: cfg.get(k) for k in keys})


def _ffmpeg(args: list[str]) -> None:
    if not shutil.which("ffmpeg"):
        raise RuntimeError("audio preprocessing needs ffmpeg")
    subprocess.run(["ffmpeg", "-y", "-loglevel", "error", *args], check=True)


def graph_of(pre: dict[str, Any]) -> str:
    """The filter chain that a preprocess block asks for."""
    on = lambda name, default: pre.get(f"{name}_enabled", default)
    gate = tuple(pre.get(f"noise_gate_{k}", d) for k, d in (("threshold_db", -45), ("ratio", 6), ("attack_ms", 10), ("release_ms", 250)))
    loud = tuple(pre.get(f"loudnorm_{k}", d) for k, d in (("i", -18), ("tp", -2), ("lra", 11)))
    return filter_graph(
        highpass_hz=pre.get("highpass_hz", 80) if on("highpass", True) else None,
        lowpass_hz=pre.get("lowpass_hz", 12000) if on("lowpass", False) else None,
        noise_floor_db=pre.get("denoise_noise_floor_db", -25) if on("denoise", True) else None,
        gate=gate if on("noise_gate", True) else None,
        loudnorm=loud if on("loudnorm", False) else None,
        sample_rate=pre.get("sample_rate", 16000),
    )


def _made(out: Path, args: Callable[[Path], list[str]], run: Runner) -> Path:
    """`out`, made once: written beside it and renamed, so a broken run leaves nothing."""
    if not out.exists():
        out.parent.mkdir(parents=True, exist_ok=True)
        part = out.with_name(f"part-{out.name}")
        run(args(part))
        os.replace(part, out)
    return out


def preprocess(path: Path, cache: Path, pre: dict[str, Any], run: Runner = _ffmpeg) -> Path:
    """The cleaned file, or the original where preprocessing is off."""
    if not pre.get("enabled", False):
        return path
    graph = graph_of(pre)
    return _made(cache / f"{path.stem}-{signature(file=file_mark(path), graph=graph)}.wav", lambda out: ["-i", str(path), "-af", graph, "-ac", "1", str(out)], run)


def limited(path: Path, cache: Path, minutes: float | None, run: Runner = _ffmpeg) -> Path:
    """The first minutes of a file, or the file where there is no limit; times stay the same."""
    if not minutes:
        return path
    return _made(cache / f"{path.stem}-{signature(file=file_mark(path), minutes=minutes)}.wav", lambda out: ["-i", str(path), "-t", str(float(minutes) * 60), str(out)], run)


def _format(path: Path) -> tuple[int, int] | None:
    try:
        with wave.open(str(path)) as w:
            return (w.getframerate(), w.getnframes()) if (w.getsampwidth(), w.getnchannels()) == (2, 1) else None
    except (wave.Error, EOFError, OSError):
        return None


def _windows(path: Path, size: int) -> Iterator[np.ndarray]:
    with wave.open(str(path)) as w:
        while raw := w.readframes(size * BLOCK):
            x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
            yield x[: len(x) // size * size].reshape(-1, size)


def gate_tracks(paths: list[Path], cache: Path, window_ms: int = 30, margin_db: float = 6.0, floor_db: float = -55.0, dilate: int = 2) -> dict[Path, Path]:
    """Each track with bleed from louder tracks muted; empty unless all are 16-bit mono of one rate.

    Levels and gains pass through in blocks, so memory holds a level for each window and no audio.
    """
    formats = [_format(p) for p in paths]
    if len(paths) < 2 or None in formats or len({rate for rate, _ in formats}) > 1:
        log.info("tracks are not gated: they need one rate, 16 bits and one channel")
        return {}
    size = int(formats[0][0] * window_ms / 1000)
    mark = signature(files=[file_mark(p) for p in paths], window_ms=window_ms, margin_db=margin_db, floor_db=floor_db, dilate=dilate)
    out = {p: cache / f"{p.stem}-gated-{mark}.wav" for p in paths}
    if all(f.exists() for f in out.values()):
        return out
    cache.mkdir(parents=True, exist_ok=True)
    levels = [np.concatenate([20 * np.log10(np.sqrt((x**2).mean(axis=1)) + 1e-10) for x in _windows(p, size)] or [np.zeros(0)]) for p in paths]
    n = min(map(len, levels))
    e = np.stack([x[:n] for x in levels])
    leader = e.max(axis=0, initial=-200.0)
    for path, own in zip(paths, e, strict=True):
        keep = (own >= leader - margin_db) | (leader <= floor_db)
        wide = np.convolve(keep, np.ones(2 * dilate + 1))[dilate : dilate + n] > 0
        part = out[path].with_name(f"part-{out[path].name}")
        with wave.open(str(path)) as r, wave.open(str(part), "wb") as w:
            w.setparams(r.getparams())
            at, centres = 0, (np.arange(n) + 0.5) * size
            while raw := r.readframes(size * BLOCK):
                x = np.frombuffer(raw, "<i2")
                gain = np.interp(np.arange(at, at + len(x)), centres, wide.astype(float)) if n else 1.0
                w.writeframes((x * gain).astype("<i2").tobytes())
                at += len(x)
        os.replace(part, out[path])
    return out
