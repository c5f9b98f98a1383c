"""Operators against the fixtures and against sequential models."""

import io
import random
import wave
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loquela import config
from loquela.functions import text
from loquela.operators import audio, chunks, dedup, folds, jobs, merge, quality, reports, timing
from loquela.plans import rebuild


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


SEGMENT = "session string, pos long, source_file string, speaker string, character string, speaker_priority int, start double, end double, start_hms string, end_hms string, text string, rms_db double, rms_db_original double, compression_ratio double"


def segments(spark, *rows):
    base = {"session": "s", "source_file": "t1.wav", "speaker": "a", "character": "", "speaker_priority": 50, "start_hms": "", "end_hms": "", "rms_db": -20.0, "rms_db_original": -20.0, "compression_ratio": 1.0}
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    full = [base | {"pos": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SEGMENT)


LONG = "обычная осмысленная реплика игрока тут"


@pytest.mark.parametrize(
    ("value", "ratio", "rms", "want"),
    [
        ("кросс кросс кросс кросс", 1.0, -10.0, ["repeated_words"]),
        ("да нет да нет да нет", None, None, ["repeated_words"]),
        ("персонаж идёт по тёмному коридору осторожно", None, None, []),
        ("кросс кросс", None, None, []),
        ("Продолжение следует...", 1.0, -10.0, ["blacklist"]),
        ("Спасибо.", None, None, ["blacklist"]),
        ("Спасибо тебе, друг мой", None, None, []),
        ("длинная нормальная фраза тут", 9.0, -10.0, ["very_high_compression"]),
        ("длинная нормальная фраза для проверки сжатия", 5.0, -10.0, ["high_compression"]),
        ("да", 5.0, -10.0, []),
        ("длинная нормальная фраза для проверки очень тихого сигнала", 1.0, -90.0, ["low_rms"]),
        ("да", 1.0, -90.0, []),
        (None, None, None, []),
    ],
)
def test_reasons(spark, value, ratio, rms, want):
    row = spark.createDataFrame([(value, ratio, rms)], "text string, compression_ratio double, rms_db double")
    assert row.select(quality.reasons().alias("r")).first()["r"] == want
    assert row.select(quality.reasons(quality.QualityRules(enabled=False)).alias("r")).first()["r"] == []


def test_split_and_summary(spark):
    rows = segments(spark, {"start": 0.0, "end": 1.0, "text": LONG}, {"start": 1.0, "end": 2.0, "text": "Продолжение следует"})
    kept, rejected = quality.split(rows)
    assert kept.count() == 1 and rejected.first()["reject_reasons"] == ["blacklist"]


def test_word_counts_match_row_form(spark):
    rows = spark.createDataFrame([(1, "a b a c a"), (2, "Ёж ёж еж"), (3, "...")], "id int, text string")
    found = {r["id"]: (r["n"], r["distinct_words"], r["most"]) for r in quality.word_counts(rows, "id", "text").collect()}
    assert found == {1: (5, 3, 3), 2: (3, 1, 3)}


def test_clock(spark):
    assert one(spark, text.hms(F.lit(3725.9))) == "1:02:05"
    assert one(spark, text.hms_ms(F.lit(1.9996))) == "00:00:01.1000"
    assert one(spark, text.hms_ms(F.lit(0.0005))) == "00:00:00.000"  # half to even
    assert one(spark, text.srt_time(F.lit(61.5))) == "00:01:01,500"
    assert one(spark, text.hms(F.lit(-3.0))) == "0:00:00"


def test_text_forms(spark):
    assert one(spark, text.filter_form(F.lit("  Ёлка  \n и Ёж! "))) == "елка и еж!"
    assert text.repair_json_text("```json\n{“character”: “Гай”}\n```") == '{"character": "Гай"}'
    assert text.repair_json_text("﻿й") == "й"
    assert [one(spark, text.duration_seconds(F.lit(t))) for t in ("6m0s", "1.5s", "1h2m3s", "", "x")] == [360.0, 1.5, 3723.0, None, None]
    a, b = (one(spark, text.struct_hash(**x)) for x in ({"b": F.lit(1), "a": F.lit(None).cast("int")}, {"a": F.lit(None).cast("int"), "b": F.lit(1)}))
    assert a == b and len(a) == 16


def test_filter_graph():
    assert text.filter_graph() == "highpass=f=80,afftdn=nf=-25,agate=threshold=-45dB:ratio=6:attack=10:release=250,aresample=16000"
    assert text.filter_graph(highpass_hz=None, noise_floor_db=None, gate=None, loudnorm=(-18, -2, 11)) == "loudnorm=I=-18:TP=-2:LRA=11,aresample=16000"


def test_durations(spark):
    rows = spark.createDataFrame([("Привет",), ("x" * 60,), ("слово " * 40,)], "text string")
    a, b, c = (r[0] for r in rows.select(timing.longest_duration(F.col("text"))).collect())
    assert (a, b) == (4.0, 7.0) and 7 < c <= 18


def test_timing_repair(spark):
    rows = segments(
        spark,
        {"start": 0.0, "end": 100.0, "text": "слово " * 40},
        {"start": 5.0, "end": 6.0, "text": "слово"},
        {"start": 0.0, "end": 50.0, "text": "Привет", "source_file": "t2.wav"},
        {"start": 5.0, "end": 5.0, "text": "x", "source_file": "t3.wav"},
    )
    done = {r["pos"]: r for r in timing.repair(rows).collect()}
    assert done[0]["end"] == 5.0 and done[0]["timing_repair"] == ["cap_to_next_same_source"] and done[0]["end_hms"] == "00:00:05.000"
    assert done[2]["end"] == 4.0 and done[2]["timing_repair"] == ["cap_by_text_length"]
    assert done[3]["end"] > 5 and done[3]["timing_repair"] == ["ensure_positive_duration"]
    assert timing.repair(rows, timing.TimingRules(enabled=False)) is rows


def test_similarity(spark):
    pairs = [("привет мир", "Привет Мир"), ("tide", "diet"), ("diet", "tide")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(dedup.text_similarity()("a", "b")).collect()]
    assert got == [1.0, SequenceMatcher(None, "tide", "diet").ratio(), SequenceMatcher(None, "diet", "tide").ratio()]


def test_similarity_of_every_letter_and_its_bounds(spark):
    rng = random.Random(4)
    say = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 40)))
    pairs = [(a := say(), rng.choice([say(), a, "uh " + a, a[3:9]])) for _ in range(200)] + [("", "")]
    model = [SequenceMatcher(None, a.strip(), b.strip(), False).ratio() for a, b in pairs]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(dedup.text_similarity(False)("a", "b")).collect()] == model
    for got, want in zip(df.select(dedup.text_similarity(False, 0.84)("a", "b")).collect(), model, strict=True):
        assert got[0] == want or (want < 0.84 and got[0] < 0.84)  # ruled out early


def test_similarity_aligns_few_pairs(spark, monkeypatch):
    """Texts of the same letters in another order are ruled out without being aligned; ratios stay those of the library."""
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("etaoin shrdlu") for _ in range(n))
    pairs = [(a := say(300), "".join(rng.sample(a, len(a)))) for _ in range(40)] + [(a := say(300), a[:140] + "x" + a[150:]) for _ in range(3)]
    pairs = [(a.strip(), b.strip()) for a, b in pairs]
    aligned, real = [], SequenceMatcher.ratio
    monkeypatch.setattr(dedup.SequenceMatcher, "ratio", lambda self: aligned.append(1) or real(self))
    for junk in (False, True):
        aligned.clear()
        got = dedup.text_similarity(junk, 0.84).func(*(pd.Series(x) for x in zip(*pairs, strict=True))).tolist()
        tried = len(aligned)
        model = [SequenceMatcher(None, a, b, junk).ratio() for a, b in pairs]
        assert [g for g in got if g >= 0.84] == [m for m in model if m >= 0.84] and all(g in (0, m) for g, m in zip(got, model, strict=True))
        assert tried <= 3


def test_overlap_ratio(spark):
    r = lambda *x: one(spark, dedup.overlap_ratio(*[F.lit(float(v)) for v in x]))
    assert (r(0, 2, 0, 4), r(0, 1, 5, 6), r(3, 3, 0, 9)) == (1.0, 0.0, 0.0)


def test_deduplicate_cases(spark):
    quiet = {"start": 0.0, "end": 3.0, "text": LONG, "rms_db": -30.0}
    loud = {"start": 0.2, "end": 3.1, "text": LONG, "rms_db": -20.0, "source_file": "t2.wav"}
    row = dedup.deduplicate(segments(spark, quiet, loud)).collect()
    assert len(row) == 1 and row[0]["source_file"] == "t2.wav" and row[0]["deduped_from"][0]["source_file"] == "t1.wav" and len(row[0]["deduped_from"][0]) == 10
    assert dedup.deduplicate(segments(spark, quiet, {**loud, "source_file": "t1.wav"})).count() == 2
    assert dedup.deduplicate(segments(spark, quiet, {**loud, "start": 50.0, "end": 53.0})).count() == 2
    assert dedup.deduplicate(segments(spark, {**quiet, "text": "да"}, {**loud, "text": "да"})).count() == 2
    high = dedup.deduplicate(segments(spark, {**quiet, "rms_db": -20.0}, {**loud, "speaker_priority": 90})).first()
    assert high["speaker_priority"] == 90
    off = dedup.deduplicate(segments(spark, quiet, loud), dedup.DedupRules(enabled=False)).collect()
    assert len(off) == 2 and {r["duplicate_status"] for r in off} == {"original"} and off[0]["deduped_from"] == []


def slot_model(rows, matches, wins, look_back):
    """The resolver written as the plainest loop."""
    slots, absorbed = [], {}
    for b in rows:
        for s in range(max(0, len(slots) - look_back), len(slots)):
            a = slots[s][0]
            if (a, b) in matches:
                if wins[a, b]:
                    slots[s] = [b, slots[s][1] + [a]]
                else:
                    slots[s][1].append(b)
                break
        else:
            slots.append([b, []])
    return {s[0]: s[1] for s in slots}


def test_resolver_against_loop():
    rng = random.Random(5)
    for _ in range(300):
        n, back = rng.randint(1, 14), rng.choice([1, 2, 40])
        rows = list(range(n))
        matches = {(a, b) for b in rows for a in range(b) if rng.random() < 0.25}
        wins = {p: rng.random() < 0.5 for p in matches}
        by_row = {b: {a: wins[a, b] for a in range(b) if (a, b) in matches} for b in rows}
        found = dedup.resolve({b: m for b, m in by_row.items() if m}, rows, back)
        slots = {}
        for p, s, turn in found:
            slots.setdefault(s, []).append((turn, p))
        got = {sorted(v)[0][1]: [p for _, p in sorted(v)[1:]] for v in slots.values()}
        assert got == slot_model(rows, matches, wins, back)


def test_slots_of_many_sessions_are_one_stream(spark):
    """Sessions go through a task as a stream of batches, none as a group of its own; slots as the resolver's."""
    rng = random.Random(6)
    rows = [(f"s{i}" if i else None, pos) for i in range(60) for pos in range(rng.randint(1, 30))]
    edges = [(k, a, pos, rng.random() < 0.5) for k, pos in rows for a in range(max(0, pos - 4), pos) if k and rng.random() < 0.3]
    found = dedup.greedy_slots(spark.createDataFrame(rows, "session string, pos long"), spark.createDataFrame(edges, "session string, kept long, later long, b_wins boolean"), look_back=3)
    want = set()
    for k in {k for k, _ in rows}:
        matches = {}
        for _, a, pos, wins in (e for e in edges if e[0] == k):
            matches.setdefault(pos, {})[a] = wins
        want |= {(k, *x) for x in dedup.resolve(matches, sorted(pos for s, pos in rows if s == k), 3)}
    assert set(map(tuple, found.collect())) == want and len(want) == len(rows)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()


def test_interval_pairs_match_theta_join(spark):
    rng = random.Random(3)
    rows = [("s" + str(rng.randint(0, 2)), i, a := rng.uniform(0, 300), a + rng.choice([0.0, rng.uniform(0, 18)])) for i in range(200)]
    df = spark.createDataFrame(rows, "session string, pos long, start double, end double")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3]}
    for bucket in (None, 5.0, 20.0):
        got = [(r.a.pos, r.b.pos) for r in dedup.interval_pairs(df, ["pos", "start", "end"], bucket=bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_merge_cases(spark):
    a, b = {"start": 0.0, "end": 2.0, "text": "первая часть"}, {"start": 2.5, "end": 4.0, "text": "вторая часть"}
    row = merge.merge_adjacent(segments(spark, a, b)).collect()
    assert len(row) == 1 and row[0]["text"] == "первая часть вторая часть" and row[0]["end"] == 4.0 and row[0]["merged_from"][0]["text"] == "вторая часть"
    assert merge.merge_adjacent(segments(spark, a, {**b, "speaker": "b"})).count() == 2
    assert merge.merge_adjacent(segments(spark, a, {**b, "start": 30.0, "end": 31.0})).count() == 2
    assert merge.merge_adjacent(segments(spark, a, {**b, "start": 1.5})).count() == 2
    assert merge.merge_adjacent(segments(spark, {**a, "text": "x" * 300}, {**b, "text": "y" * 121})).count() == 2
    assert merge.merge_adjacent(segments(spark, a, b), enabled=False).count() == 2


def merge_model(rows, gap, most):
    out = []
    for r in rows:
        p = out[-1] if out else None
        if p and p["who"] == r["who"] and 0 <= r["start"] - p["end"] <= gap and len(p["text"]) + len(r["text"]) <= most:
            p["end"], p["text"] = r["end"], p["text"].rstrip() + " " + r["text"].lstrip()
        else:
            out.append(dict(r))
    return [(p["text"], p["end"]) for p in out]


def test_merge_against_loop(spark):
    rng = random.Random(9)
    for seed in range(4):
        t, rows = 0.0, []
        for _ in range(60):
            t += rng.choice([0.2, 1.0, 2.0])
            rows.append({"who": rng.choice("ab"), "start": t, "end": t + 0.5, "text": rng.choice(["", " ", "x "]) + "w" * rng.randint(1, 9) + rng.choice(["", "  "])})
            t += 0.5
        df = segments(spark, *[{"speaker": r["who"], "start": r["start"], "end": r["end"], "text": r["text"]} for r in rows]).repartition(seed + 1)
        got = [(r["text"], r["end"]) for r in merge.merge_adjacent(df, 1.1, 20).orderBy("pos").collect()]
        assert got == merge_model(rows, 1.1, 20)


def test_long_islands_match_islands_in_bounded_tasks(spark):
    """One key with nearly all rows is cut into ranges; islands go on over the cuts."""
    rng = random.Random(8)
    rows = [(1 if i % 50 else 2, i, rng.choice("ab") if i < 1500 else "a") for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, pos long, c string")
    w = Window.partitionBy("k").orderBy("pos")
    want = folds.islands(df, ["k"], ["pos"], F.col("c") == F.lag("c").over(w))
    found = folds.long_islands(df, ["k"], ["pos"], ["c"], lambda before: F.col("c") == before["c"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 3000
    sizes = [r["count"] for r in folds.in_ranges(df, ["pos"]).groupBy("_b").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 300


def test_packs_and_buckets(spark):
    costs = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, 20, 1, 9, 1])], "i int, cost int")
    got = [r["pack"] for r in folds.greedy_packs(costs, [], ["i"], "cost", 10).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 2, 3]
    regions = spark.createDataFrame([("t", 0.0, 5.0), ("t", 5.2, 6.0), ("t", 9.0, 30.0), ("u", 0.0, 1.0)], "track string, start double, end double")
    merged = folds.vad_regions(regions, ["track"])
    assert sorted((r["track"], r["start"], r["end"]) for r in merged.collect()) == [("t", 0.0, 6.0), ("t", 9.0, 30.0), ("u", 0.0, 1.0)]
    assert [r["bucket"] for r in folds.vad_buckets(merged, ["track"], 10).orderBy("track", "start").collect()] == [0, 1, 0]


def test_chunks_and_scenes(spark):
    rows = segments(spark, {"start": 700.0, "end": 701.0, "text": "в прошлой"}, {"start": 800.0, "end": 801.0, "text": "игре рекап"}, {"start": 1900.0, "end": 1901.0, "text": "куб"}, {"start": 2500.0, "end": 2501.0, "text": "кубик"})
    made = chunks.make_chunks(rows).orderBy("chunk_index").collect()
    assert [(c["chunk_index"], c["start"], c["end"], c["scene_type"], len(c["events"])) for c in made] == [(0, 600, 1200, "recap", 2), (2, 1800, 2400, "combat_or_rolls", 1), (3, 2400, 3000, "gameplay", 1)]
    prompts = chunks.chunk_prompts(chunks.make_chunks(rows)).orderBy("chunk_index").collect()
    assert prompts[1]["name"] == "chunk_002" and '"events"' in prompts[0]["prompt"]


def pcm(values, width):
    scale = 1 << (8 * width - 1)
    ints = [max(-scale, min(scale - 1, int(v * scale))) for v in values]
    return b"".join((i + 128).to_bytes(1, "little") if width == 1 else i.to_bytes(width, "little", signed=True) for i in ints)


def wav(values, width=2, channels=1, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(pcm(values, width))
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_levels(width):
    half = wav([0.5] * 8000, width)
    assert audio.level(half, 0, 1) == pytest.approx(-6.02, abs=0.07)
    assert audio.level(wav([0.0] * 800, width), 0, 0.1) == -120.0
    assert audio.level(wav([0.5] * 4000 + [0.0] * 4000, width), 0, 1) == pytest.approx(-9.03, abs=0.07)
    assert audio.level(half, 0.5, 0.5) is None and audio.level(b"junk", 0, 1) is None and audio.level(None, 0, 1) is None


def test_wav_udfs(spark):
    df = spark.createDataFrame([(wav([0.5] * 1000),), (wav([0.5] * 1000, channels=2),), (b"x",)], "content binary")
    assert [(r.x.rate, r.x.frames) for r in df.select(audio.wav_info("content").alias("x")).collect()] == [(8000, 1000), (None, None), (None, None)]
    got = df.limit(1).select(audio.wav_envelope("content", F.lit(30)).alias("e")).first()["e"]
    assert len(got) == 4 and got[0] == pytest.approx(-6.02, abs=0.01)


def test_gate(spark):
    rng = np.random.default_rng(7)
    levels = rng.uniform(-70, -10, (2, 60))
    rows = [("s", f"t{t}", w, float(levels[t, w])) for t in range(2) for w in range(60)]
    gated = audio.leader_gate(spark.createDataFrame(rows, "session string, track string, win long, db double")).collect()
    leader = levels.max(axis=0)
    keep = (levels >= leader - 6) | (leader <= -55)
    want = np.array([[keep[t, max(0, w - 2) : w + 3].any() for w in range(60)] for t in range(2)])
    assert all(want[int(r["track"][1]), r["win"]] == r["keep"] for r in gated)


def test_gain(spark):
    df = spark.createDataFrame([([1.0] * 8, [True, False], 4)], "x array<float>, k array<boolean>, w int")
    got = df.select(audio.apply_gain("x", "k", "w").alias("y")).first()["y"]
    assert got[0] == 1.0 and got[-1] == 0.0 and all(a >= b for a, b in zip(got, got[1:]))


def test_weights(spark):
    values = ["2", '"1"', "2.9", '"1.5"', '"high"', "null", '" 3 "', "-2.9", "true", "{}"]
    rows = spark.createDataFrame([(f'{{"w": {v}}}',) for v in values], "j string")
    got = [r[0] for r in rows.select(reports.weight(F.try_variant_get(F.parse_json("j"), "$.w", "variant"))).collect()]
    assert got == [2, 1, 2, 1, 1, 1, 3, -2, 1, 1]


def test_as_text(spark):
    rows = spark.createDataFrame([('["a", null, "b"]',), ("null",), ('"x"',), ('[["a","b"],"c"]',), ("5",)], "j string")
    assert [r[0] for r in rows.select(reports.as_text(F.parse_json("j"))).collect()] == ["a\n\nb", "", "x", "a\n\nb\n\nc", "5"]


def test_jobs(spark):
    todo = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "name string, chunk_hash string")
    results = spark.createDataFrame([("b",), ("c",), ("d",)], "name string")
    ledger = spark.createDataFrame([("b", "2"), ("c", "old")], "name string, chunk_hash string")
    assert sorted(r["name"] for r in jobs.to_run(todo, results, ledger).collect()) == ["a", "c"]  # d was made by hand
    assert jobs.to_run(todo, results, ledger, force=True).count() == 4


def test_rebuild_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        t = i * 1.5
        said = f"реплика номер {i} про дорогу и таверну"
        rows.append({"start": t, "end": t + 1.2, "text": said, "source_file": f"t{i % 3}.wav", "speaker": "abc"[i % 3]})
        if rng.random() < 0.4:
            rows.append({"start": t + 0.1, "end": t + 1.3, "text": said, "source_file": "bleed.wav", "speaker": "z", "rms_db": -40.0})
    df = segments(spark, *rows)
    runs = [sorted((r["pos"], r["start"], r["end"], r["text"], len(r["deduped_from"])) for r in rebuild.clean(x)[0].collect()) for x in (df, df.repartition(7))]
    assert runs[0] == runs[1] and sum(r[4] for r in runs[0]) == len(rows) - 120


def test_settings(caplog):
    got = config.with_profile({"quality_profile": "gentle", "dedupe": {"min_text_len": 5}})
    assert got["dedupe"]["similarity_threshold"] == 0.88 and got["dedupe"]["min_text_len"] == 5
    assert config.with_profile({"quality_profile": "odd"})["dedupe"]["similarity_threshold"] == 0.84 and "odd" in caplog.text
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": None}}) == {"a": {"b": None, "c": 2}}
    assert config.decode_options({"logprob_threshold": -1.0, "x": None}, {}, "faster_whisper") == {"log_prob_threshold": -1.0}
    with pytest.raises(ValueError, match="base_url"):
        config.ai_settings({"ai_analysis": {"provider": "openai_compatible"}})
