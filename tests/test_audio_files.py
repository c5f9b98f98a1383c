import wave

import numpy as np
import pytest

from loquela.sources import audio_files


def write(path, x, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes((x * 32767).astype("<i2").tobytes())


def level(path, a, b):
    with wave.open(str(path)) as w:
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2")[a * 16000 : b * 16000] / 32768
    return 20 * np.log10(np.sqrt((x**2).mean()) + 1e-10)


def test_gate(tmp_path):
    rng = np.random.default_rng(7)
    a, b = rng.normal(0, 0.2, (2, 48000))
    a[16000:32000] = 0  # a speaks, then b, then both
    b[:16000] = 0
    one, two = tmp_path / "a.wav", tmp_path / "b.wav"
    write(one, np.clip(a + 0.1 * b, -1, 1))
    write(two, np.clip(b + 0.1 * a, -1, 1))
    found = audio_files.gate_tracks([one, two], tmp_path / "cache")
    assert level(found[one], 0, 1) > -20 and level(found[two], 1, 2) > -20
    assert min(level(found[one], 2, 3), level(found[two], 2, 3)) > -20
    with wave.open(str(found[two])) as w:
        x = np.frombuffer(w.readframes(48000), "<i2")[2000:13000] / 32768
    assert 20 * np.log10(np.sqrt((x**2).mean()) + 1e-10) < -50
    before = found[one].stat().st_mtime_ns
    assert audio_files.gate_tracks([one, two], tmp_path / "cache") == found and found[one].stat().st_mtime_ns == before
    stereo = tmp_path / "s.wav"
    write(stereo, np.zeros(100), 2)
    assert audio_files.gate_tracks([one, stereo], tmp_path) == {}


def test_cached_external_steps(tmp_path):
    file = tmp_path / "x.wav"
    write(file, np.zeros(10))
    calls = []

    def run(args):
        calls.append(args)
        open(args[-1], "wb").close()

    assert audio_files.preprocess(file, tmp_path, {}, run) == file and audio_files.limited(file, tmp_path, None, run) == file
    a = audio_files.preprocess(file, tmp_path, {"enabled": True}, run)
    assert audio_files.preprocess(file, tmp_path, {"enabled": True}, run) == a != audio_files.preprocess(file, tmp_path, {"enabled": True, "highpass_hz": 90}, run)
    assert len(calls) == 2 and "highpass=f=80" in calls[0][3]
    with pytest.raises(OSError):
        audio_files.preprocess(tmp_path / "none.wav", tmp_path, {"enabled": True}, run)
    t = audio_files.transcription_signature({}, {"language": "ru"}, file)
    assert t != audio_files.transcription_signature({}, {"language": "en"}, file) and len(t) == 16
