"""Readers, writers, connectors, the session lifecycle, the command line and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loquela import cli, schema
from loquela.plans import session
from loquela.sources import extract, readers, sinks
from loquela.streaming import windows

RESULT = {
    "session": "s", "chunk_index": 0, "scene_type": "gameplay", "summary": "итог",
    "actions": [{"time": "00:02", "character": "Гай", "action": "идёт", "outcome": "дошёл", "importance": "high"}, {"time": "00:01", "character": "Ангрон", "action": "бьёт", "outcome": None, "importance": "low"}],
    "dice_rolls": [{"character": "Гай", "natural": 20}, {"character": "Гай", "natural": 1}, {"character": "Ангрон", "natural": None}],
    "mvp_signals": [{"character": "Гай", "category": "combat", "weight": 2}, {"character": "Гай", "category": "social", "weight": "1"}, {"character": "Ангрон", "weight": 1}],
}


@pytest.fixture
def results(spark, tmp_path):
    (tmp_path / "a.json").write_text("```json\n" + json.dumps(RESULT, ensure_ascii=False).replace('"итог"', "“итог”") + "\n```", encoding="utf-8")
    (tmp_path / "b.json").write_text("{broken", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"summary": "x"} trailing', encoding="utf-8")
    (tmp_path / "d.json").write_text("[1]", encoding="utf-8")
    return readers.read_results(spark, str(tmp_path))


def test_results_and_reports(spark, results):
    good, bad = results
    assert sorted(r["file"] for r in bad.collect()) == ["b.json", "c.json", "d.json"]
    lines = sinks.report_lines(good, "s")
    assert lines["actions_timeline.md"][2].startswith("- `00:01` **Ангрон**")
    assert "- **Гай**: 10.50 (2)" in lines["dice_stats.md"]
    assert lines["mvp_candidates.md"][-2:] == ["- **Гай**: 3", "- **Ангрон**: 1"]
    assert "- chunk 0: итог" in lines["session_report.md"]
    data = sinks.pdf_data(good, "s", "t", "u", {"scenes": [{"title": None}]}, spark.createDataFrame([("Гай",)], "name string"), spark.createDataFrame([(1, "scene1_x.PNG")], "n int, file string"))
    assert data["mvp_categories"]["Гай"] == {"combat": 2, "social": 1} and data["dice_stats"][0] == {"character": "Гай", "avg": 10.5, "count": 2, "nat20": 1, "nat1": 1}
    assert data["scenes"] == [{"title": "", "chunk_index": 0, "time": "", "image_prompt": "", "file": "images/scene1.png"}] and data["actions"][0]["outcome"] == ""


def test_missing_fields(spark):
    rows = spark.createDataFrame([('{"actions": null, "summary": ""}',), ("[1]",)], "j string")
    assert [r[0] for r in rows.select(readers.missing_fields(F.col("j"))).collect()] == [["dice_rolls", "mvp_signals"], None]


def test_jsonl(spark, tmp_path):
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    file = tmp_path / "x.jsonl"
    file.write_text('{"session": "s", "text": "a"}\n\n  \n{"session": "s", "text": "b", "rms_db": null}\n', encoding="utf-8")
    rows = readers.read_jsonl(spark, str(file))
    assert [r["text"] for r in rows.orderBy("pos").collect()] == ["a", "b"]
    sinks.write_jsonl(rows.select("text", "rms_db", "pos"), tmp_path / "y.jsonl")
    assert (tmp_path / "y.jsonl").read_text(encoding="utf-8") == '{"text":"a","rms_db":null}\n{"text":"b","rms_db":null}\n'
    file.write_text("not json\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_jsonl(spark, str(file)).collect()


def test_tracks(spark, caplog):
    names = ["dnd_2-Дима. Ангрон.wav", "b.WAV", "mix.wav", "out.wav", "note.txt", "Оля. А. Б.wav"]
    cfg = {"session_name": "dnd_2", "master_mix": "mix.wav", "exclude": ["out.wav"], "dm_speaker": "Оля"}
    found = readers.discover_tracks(names, cfg)
    assert [(t["speaker"], t["character"], t["priority"]) for t in found] == [("b", "b", 50), ("Дима", "Ангрон", 50), ("Оля", "А. Б", 100)]
    assert readers.discover_tracks(names, {"tracks": [{"file": "q"}]}) == [{"file": "q"}]
    assert readers.discover_tracks([], cfg) == [] and "no audio" in caplog.text
    rows = spark.createDataFrame([("b.WAV", None)], "source_file string, speaker string")
    assert readers.with_track_defaults(rows, readers.track_table(spark, found)).first()["speaker"] == "b"


def test_party_and_images(spark, tmp_path):
    assert readers.read_party(spark, tmp_path).count() == 0
    (tmp_path / "party.json").write_text(json.dumps([{"name": "Гай", "spells": ["щит"]}, {"class_ru": "x"}, 5]), encoding="utf-8")
    assert [r["name"] for r in readers.read_party(spark, tmp_path).collect()] == ["Гай"]
    (tmp_path / "party.json").write_text("{}", encoding="utf-8")
    assert readers.read_party(spark, tmp_path).count() == 0
    images = tmp_path / "img"
    images.mkdir()
    for n in ("scene1_tavern.png", "scene1_b.png", "scene3.JPG", "scene_bad.png", "ref.jpg"):
        (images / n).write_bytes(b"x")
    assert sorted((r["n"], r["file"]) for r in readers.scene_images(spark, str(images)).collect()) == [(1, "scene1_b.png"), (3, "scene3.JPG")]


def answer(content):
    return json.dumps({"choices": [{"message": {"content": content}}]}).encode()


GOOD = json.dumps({k: None for k in schema.RESULT_FIELDS})


def test_direct_retries_and_soft_failures():
    waits, replies = [], [(429, {"x-ratelimit-reset-tokens": "6m0s"}, b""), (429, {}, b""), (503, {}, b""), (200, {}, answer(GOOD)), (200, {}, answer("{}")), (400, {}, b"no")]
    service = extract.ChatCompletions("m", base_url="http://x", concurrency=1, transport=lambda *a: replies.pop(0), retries=extract.Retries(sleep=waits.append))
    a, b, c = service.analyze([extract.Job(n, "p") for n in "abc"])
    assert a.data is not None and "lacks" in b.error and "400" in c.error
    assert waits == [180.0, 37.5, 1.0]


def test_network_faults_end():
    def down(*a):
        raise OSError("down")

    waits = []
    got = extract.Messages("m", transport=down, retries=extract.Retries(sleep=waits.append)).analyze([extract.Job("a", "p")])
    assert "down" in got[0].error and waits == [1.0, 2.0]


def test_batches():
    def server(method, url, headers, body):
        if url.endswith("/files"):
            assert b'"custom_id": "a"' in body
            return 200, {}, b'{"id": "f"}'
        if url.endswith("/batches"):
            return 200, {}, b'{"id": "b1"}'
        if url.endswith("/batches/b1"):
            return 200, {}, b'{"status": "completed", "output_file_id": "o"}'
        return 200, {}, json.dumps({"custom_id": "a", "response": {"status_code": 200, "body": json.loads(answer(GOOD))}}).encode()

    made = []
    service = extract.ChatCompletionsBatch("m", base_url="http://x", transport=server, on_batch=lambda i, j: made.append(i))
    a, b = service.analyze([extract.Job("a", "p"), extract.Job("b", "p")])
    assert a.data is not None and b.error == "batch completed" and made == ["b1"]


def test_packs_and_durations():
    big = [extract.Job(str(i), "x" * 30_000) for i in range(3)]
    assert [len(p) for p in extract.packs(big, 25_000, 1_000)] == [2, 1]
    assert [len(p) for p in extract.packs(big[:1], 10, 1)] == [1]
    assert [extract.duration(t) for t in ("6m0s", "20ms", "", "x")] == [360, 0.02, None, None]


class Fake:
    def __init__(self, fail=()):
        self.fail, self.seen = fail, []

    def analyze(self, jobs, on_answer=None):
        self.seen += [j.name for j in jobs]
        out = [extract.Answer(j.name, error="bad") if j.name in self.fail else extract.Answer(j.name, RESULT) for j in jobs]
        for a in out:
            if on_answer:
                on_answer(a)
        return out


def test_session_lifecycle(spark, tmp_path, caplog):
    cfg = {"session_name": "s", "ai_analysis": {"enabled": False}}
    paths = sinks.session_paths(tmp_path)
    rows = [{"session": "s", "source_file": f"t{i % 2}.wav", "speaker": "ab"[i % 2], "start": i * 100.0, "end": i * 100.0 + 3, "start_hms": "x", "end_hms": "x", "text": f"реплика {i} про дорогу", "rms_db": -20.0} for i in range(14)]
    (paths["raw"] / "s_raw.jsonl").write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    session.run_rebuild(spark, tmp_path, cfg)
    assert len((paths["clean"] / "s_clean.jsonl").read_text(encoding="utf-8").splitlines()) == 14
    assert (paths["clean"] / "s_clean.txt").read_text(encoding="utf-8").startswith("[0:00:00] a: реплика 0")
    assert (paths["clean"] / "s_clean.srt").read_text(encoding="utf-8").startswith("1\n00:00:00,000 --> 00:00:03,000\na: реплика 0")
    assert sorted(p.name for p in paths["chunks"].iterdir()) == ["chunk_000.json", "chunk_001.json", "chunk_002.json"]
    assert not session.run_extract(spark, tmp_path, cfg)
    fake = Fake(fail={"chunk_001"})
    assert session.run_extract(spark, tmp_path, cfg, service=fake)
    assert fake.seen == ["chunk_000", "chunk_001", "chunk_002"] and "chunk_001" in caplog.text
    assert not (paths["manual_ai_results"] / "chunk_001.json").exists()
    again = Fake()
    session.run_extract(spark, tmp_path, cfg, service=again)
    assert again.seen == ["chunk_001"]
    session.run_report(spark, tmp_path, cfg)
    assert "- **Гай**: 9" in (paths["reports"] / "mvp_candidates.md").read_text(encoding="utf-8")
    data = json.loads(session.run_chronicle(spark, tmp_path, cfg).read_text(encoding="utf-8"))
    assert data["mvp_scores"][0] == {"character": "Гай", "score": 9}


def test_synthesis_shape():
    got = session.normal_synthesis({"recap": ["a", None, ["b", "c"]], "quest_hooks": [{"title": None}], "scenes": None})
    assert got == {"recap": "a\n\nb\n\nc", "quest_hooks": [{"title": "", "description": ""}], "scenes": []}


def test_cli_errors(tmp_path):
    assert cli.main(["build-report", str(tmp_path)]) == 1


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", "куб", "2024-01-01 00:00:01"), ("s", "b", "КУБ ", "2024-01-01 00:00:02"), ("s", "a", "x", "2024-01-01 01:00:00")], "session string, speaker string, text string, t string")
    rows.select("session", "speaker", "text", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("session string, speaker string, text string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("counts", windows.chunk_counts(stream())), ("scenes", windows.chunk_scenes(stream())), ("firsts", windows.first_mentions(stream()))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r["n"],) for r in spark.sql("select n from counts").collect()] == [(2,)]
    assert spark.sql("select scene_type from scenes").first()[0] == "combat_or_rolls"
    assert spark.sql("select * from firsts").count() == 2
