"""Settings: defaults, quality profiles, and what a configuration document overrides."""

from __future__ import annotations

import json
import logging
import os
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)


def _profile(highpass, noise, gate, dedupe, gap, decode) -> dict[str, Any]:
    threshold, ratio, attack, release = gate
    similarity, overlap, chars, louder = dedupe
    compression, logprob, no_speech, silence = decode
    return {
        "preprocess": {
            "highpass_enabled": True, "highpass_hz": highpass, "denoise_enabled": True, "denoise_noise_floor_db": noise,
            "noise_gate_enabled": True, "noise_gate_threshold_db": threshold, "noise_gate_ratio": ratio,
            "noise_gate_attack_ms": attack, "noise_gate_release_ms": release, "loudnorm_enabled": False,
        },
        "dedupe": {"similarity_threshold": similarity, "min_overlap_ratio": overlap, "min_text_len": chars, "prefer_louder_by_db": louder},
        "postprocess": {"repair_timings": True, "merge_adjacent_same_speaker": True, "merge_max_gap_sec": gap},
        "decode": {
            "condition_on_previous_text": False, "compression_ratio_threshold": compression, "logprob_threshold": logprob,
            "no_speech_threshold": no_speech, "hallucination_silence_threshold": silence, "initial_prompt": None,
        },
    }


# Highpass, noise floor, gate (threshold, ratio, attack, release), duplicates
# (similarity, overlap, characters, louder by), merge gap, decoding (compression, log
# probability, no speech, silence).
PROFILES = {
    "gentle": _profile(70, -28, (-52, 3, 8, 350), (0.88, 0.55, 24, 4.5), 0.9, (2.6, -1.2, 0.7, 5.0)),
    "balanced": _profile(80, -25, (-46, 5, 10, 280), (0.84, 0.45, 20, 3.0), 1.1, (2.4, -1.0, 0.6, 2.0)),
    "aggressive": _profile(90, -22, (-40, 8, 12, 220), (0.80, 0.35, 18, 2.0), 1.4, (2.2, -0.8, 0.5, 1.0)),
}
AI_DEFAULTS = {
    "enabled": False, "provider": "anthropic", "model": None, "mode": "batch", "batch_token_budget": 700_000, "structured_output": None,
    "base_url": None, "api_key_env": None, "max_output_tokens": 8000, "concurrency": 2,
}
PDF_DEFAULTS = {"enabled": False, "campaign_title": "", "subtitle": "", "assets_dir": "report_assets"}


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Nested dictionaries merged; the right one wins, also with None."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def with_profile(cfg: dict[str, Any]) -> dict[str, Any]:
    """The configuration over its quality profile; an unknown name warns and is balanced."""
    name = str(cfg.get("quality_profile", "balanced")).strip().lower()
    if name not in PROFILES:
        log.warning("unknown quality_profile %r, using balanced", name)
        name = "balanced"
    return deep_merge(PROFILES[name], cfg)


def ai_settings(cfg: dict[str, Any]) -> dict[str, Any]:
    """Extraction settings with defaults; raises ValueError for a provider that can't run."""
    given = cfg.get("ai_analysis") or {}
    ai = {**AI_DEFAULTS, **given}
    if ai["provider"] not in ("anthropic", "openai_compatible"):
        raise ValueError(f"unknown provider {ai['provider']!r}")
    if ai["provider"] == "openai_compatible":
        if not ai["base_url"]:
            raise ValueError("openai_compatible needs base_url")
        ai["mode"] = given.get("mode", "direct")
    if ai["structured_output"] is None:
        ai["structured_output"] = "api.openai.com" in (ai["base_url"] or "")
    return ai


def api_key(ai: dict[str, Any]) -> str | None:
    name = ai["api_key_env"] or ("ANTHROPIC_API_KEY" if ai["provider"] == "anthropic" else None)
    return os.environ.get(name) if name else None


def pdf_settings(cfg: dict[str, Any]) -> dict[str, Any]:
    return {**PDF_DEFAULTS, **(cfg.get("pdf") or {})}


def decode_options(decode: dict[str, Any] | None, legacy: dict[str, Any], backend: str) -> dict[str, Any]:
    """Options for a recognition backend: unset ones dropped, the log-probability option by the
    backend's name for it; without a decode block the older top-level setting counts."""
    options = {k: v for k, v in (decode if decode is not None else legacy).items() if v is not None}
    for a, b in (("logprob_threshold", "log_prob_threshold"),):
        have, want = (b, a) if backend.startswith("mlx") else (a, b)
        if have in options:
            options[want] = options.pop(have)
    return options


def backend_of(cfg: dict[str, Any]) -> str:
    return str(cfg.get("transcription_backend") or "faster_whisper").strip().lower()


def load_dotenv(*folders: Path) -> None:
    """Settings of .env files in order; what the environment has already stays."""
    for folder in folders:
        file = Path(folder) / ".env"
        if not file.is_file():
            continue
        for line in file.read_text(encoding="utf-8").splitlines():
            name, mark, value = line.strip().partition("=")
            if mark and name.strip() and not name.startswith("#"):
                os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def load(session_dir: Path, path: Path | None = None, **over: Any) -> dict[str, Any]:
    """A session's configuration with its profile; `over` holds command-line overrides."""
    load_dotenv(session_dir, Path.cwd())
    cfg = json.loads((path or session_dir / "config.json").read_text(encoding="utf-8"))
    if "session_name" not in cfg:
        raise ValueError("the configuration needs session_name")
    return with_profile({**cfg, **{k: v for k, v in over.items() if v is not None}})
