"""A session's lifecycle on files: clean, chunk, extract with resume, report, chronicle data."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import logging
import shutil
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquela import config
from loquela.operators import chunks, jobs, reports
from loquela.plans import rebuild
from loquela.sources import extract, readers, recognise, sinks

log = logging.getLogger(__name__)
#: The template that ships with the package.
TEMPLATE = Path(__file__).parent.parent / "templates" / "chronicle.typ"


def raw_path(paths: dict[str, Path], cfg: dict[str, Any], fall_back: bool = False) -> Path:
    """The raw rows of a full or a limited run; a rebuild takes the other where its own is missing."""
    name = cfg["session_name"]
    own, other = (paths["raw"] / f"{name}{s}_raw.jsonl" for s in (("_test", "") if cfg.get("limit_minutes") else ("", "_test")))
    return other if fall_back and not own.exists() and other.exists() else own


def run_rebuild(spark: SparkSession, root: Path, cfg: dict[str, Any]) -> None:
    """Clean rows, quality report, chunks and prompts from stored raw rows."""
    paths, name, test = sinks.session_paths(root), cfg["session_name"], bool(cfg.get("limit_minutes"))
    raw = readers.read_jsonl(spark, str(raw_path(paths, cfg, fall_back=True))).cache()
    held = [raw]
    clean, rejected = rebuild.clean(raw, cfg, held=held)
    clean = clean.cache()
    sinks.write_clean(clean, paths["clean"], name, test)
    sinks.write_rejected(rejected, paths["clean"], name)
    sinks.write_lines(paths["reports"] / f"quality_report{'_test' if test else ''}.md", sinks.quality_report(raw, clean, name, cfg.get("quality_profile", "balanced")))
    write_prompts(spark, root, cfg, clean)
    for rows in (*held, clean):
        rows.unpersist()


def run_prepare(spark: SparkSession, root: Path, cfg: dict[str, Any]) -> None:
    """Chunks and prompts from stored clean rows."""
    paths = sinks.session_paths(root)
    write_prompts(spark, root, cfg, readers.read_jsonl(spark, str(paths["clean"] / f"{cfg['session_name']}_clean.jsonl")))


def write_prompts(spark: SparkSession, root: Path, cfg: dict[str, Any], clean: DataFrame) -> None:
    paths = sinks.session_paths(root)
    party = chunks.party_lines(readers.read_party(spark, root))
    made, prompts = rebuild.chunked(clean, cfg, party)
    sinks.write_chunks(made, paths["chunks"], bool(cfg.get("limit_minutes")))
    sinks.write_prompts(prompts, paths["prompts"])


def _ledger_path(paths: dict[str, Path]) -> Path:
    return paths["cache"] / "ledger.json"


def _load_ledger(paths: dict[str, Path]) -> dict[str, Any]:
    """chunks by name, and one pending entry for each batch that was not read yet."""
    file = _ledger_path(paths)
    return {"chunks": {}, "pending": [], "synthesis": None} | (json.loads(file.read_text(encoding="utf-8")) if file.exists() else {})


def run_extract(spark: SparkSession, root: Path, cfg: dict[str, Any], force: bool = False, service: extract.Extractor | None = None) -> bool:
    """Run out-of-date jobs and keep each answer as it comes; False where there is no service.

    Pending batches are read first, under the hashes they were made with. Failed and uncovered
    jobs are warned of and run again next time.
    """
    paths, ai = sinks.session_paths(root), config.ai_settings(cfg)
    if service is None:
        key = config.api_key(ai)
        if not ai["enabled"] or (ai["provider"] == "anthropic" and not key):
            log.info("no extraction service; put results into %s by hand", paths["manual_ai_results"])
            return False
        service = extract.make_extractor(ai, key)
    ledger = _load_ledger(paths)
    keep = lambda: sinks.write_json(_ledger_path(paths), ledger)

    def taker(hashes: dict[str, str]):
        def take(answer: extract.Answer) -> None:
            if answer.error:
                log.warning("%s: %s", answer.name, answer.error)
                return
            sinks.write_json(paths["manual_ai_results"] / f"{answer.name}.json", answer.data)
            ledger["chunks"][answer.name] = {"chunk_hash": hashes.get(answer.name), "model": ai["model"], "provider": ai["provider"], "status": "done"}
            keep()

        return take

    for batch in list(ledger["pending"]):
        if not hasattr(service, "collect"):
            log.warning("batch %s stays pending: this service reads no batches", batch["batch_id"])
            continue  # it is paid for; a later run with the service that made it reads it
        old = [extract.Job(n, "", h) for n, h in batch["jobs"].items()]
        service.collect(batch["batch_id"], old, taker(batch["jobs"]))
        ledger["pending"].remove(batch)
        keep()
    files = sorted(paths["prompts"].glob("chunk_*_prompt.md"))
    rows = [(f.stem.removesuffix("_prompt"), f.read_text(encoding="utf-8")) for f in files]
    if not rows:
        return True
    all_jobs = jobs.jobs(spark.createDataFrame(rows, "name string, prompt string"))
    results = spark.createDataFrame([(f.stem,) for f in paths["manual_ai_results"].glob("*.json")], "name string")
    known = spark.createDataFrame([(n, c["chunk_hash"]) for n, c in ledger["chunks"].items()], "name string, chunk_hash string")
    wanted = [extract.Job(r["name"], r["prompt"], r["chunk_hash"]) for r in jobs.to_run(all_jobs, results, known, force).orderBy("name").collect()]
    hashes = {j.name: j.chunk_hash for j in wanted}
    if hasattr(service, "on_batch"):

        def made(batch_id: str, part: list[extract.Job]) -> None:
            ledger["pending"].append({"batch_id": batch_id, "jobs": {j.name: hashes[j.name] for j in part}})
            keep()

        service.on_batch = made
    answers = service.analyze(wanted, taker(hashes)) if wanted else []
    ledger["pending"] = []
    keep()
    done = {a.name for a in answers if not a.error}
    if left := sorted(set(hashes) - done):
        log.warning("not covered: %s", ", ".join(left))
    return True


def run_report(spark: SparkSession, root: Path, cfg: dict[str, Any]) -> None:
    """The four reports from the result folder; unreadable files are warned of and left out."""
    paths = sinks.session_paths(root)
    results, rejected = readers.read_results(spark, str(paths["manual_ai_results"]))
    for r in rejected.collect():
        log.warning("not a result: %s", r["file"])
    results = results.cache()
    for name, lines in sinks.report_lines(results, cfg["session_name"]).items():
        sinks.write_lines(paths["reports"] / name, lines)
    results.unpersist()


def normal_synthesis(data: dict[str, Any] | None) -> dict[str, Any]:
    """A synthesis in the shape that templates read: texts are texts, lists are lists."""

    def text(v: Any) -> str:
        if v is None:
            return ""
        return "\n\n".join(text(x) for x in v if x is not None) if isinstance(v, list) else str(v)

    data = dict(data or {})
    parts = {"quest_hooks": ("title", "description"), "scenes": ("title", "time", "image_prompt")}
    return {**data, "recap": text(data.get("recap")), **{k: [{**x, **{n: text(x.get(n)) for n in names}} for x in data.get(k) or []] for k, names in parts.items()}}


def synthesis_prompt(results: DataFrame, session: str, party: DataFrame) -> str:
    """A request for recap, open threads and scenes from the aggregated results."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    parts = {k: rows(df) for k, df in reports.synthesis_input(results).items()}

    def look(m: dict[str, Any]) -> str:
        known = (m.get("class_ru"), m.get("appearance_en"), ", ".join(m.get("spells") or ()))
        return f"- {m['name']}: " + "; ".join(x for x in known if x)

    looks = "\n".join(map(look, rows(party))) or "(не описаны)"
    ask = (
        "Составь материалы хроники и верни один JSON-объект: recap, quest_hooks[title, description], scenes[title, chunk_index, time, image_prompt].\n"
        "* recap — строка по-русски, четыре-шесть абзацев через пустую строку: что произошло в мире игры, в прошедшем времени, без разговоров за столом, "
        "бросков и номеров фрагментов; в конце — где герои остановились.\n"
        "* quest_hooks — открытые вопросы, найденные сведения и возможные пути, по-русски.\n"
        "* scenes — от трёх до пяти самых зрелищных сцен, первая годится на обложку; time из данных, image_prompt по-английски: "
        "dark fantasy oil painting, место, действие и внешность участников.\n"
        "Опирайся только на данные, имена не переводи."
    )
    return f"{ask}\n\nВнешность:\n{looks}\n\n" + json.dumps({"session": session, **parts}, ensure_ascii=False, indent=2)


def run_synthesis(spark: SparkSession, root: Path, cfg: dict[str, Any], results: DataFrame, force: bool = False, service: extract.Extractor | None = None) -> dict[str, Any] | None:
    """The session's synthesis, from its cache where prompt and model are the same; None without a service."""
    paths, ai = sinks.session_paths(root), config.ai_settings(cfg)
    prompt = synthesis_prompt(results, cfg["session_name"], readers.read_party(spark, root))
    mark = hashlib.sha1(json.dumps([prompt, ai["model"], ai["provider"]], ensure_ascii=False).encode()).hexdigest()[:16]
    file, ledger = paths["reports"] / "synthesis.json", _load_ledger(paths)
    if file.exists() and not force and (ledger["synthesis"] or {}).get("input_hash") == mark:
        return normal_synthesis(readers.read_json(file))
    if service is None:
        key = config.api_key(ai)
        if not ai["enabled"] or (ai["provider"] == "anthropic" and not key):
            return None
        service = extract.make_extractor(ai, key, synthesis=True)
    answer = service.analyze([extract.Job("synthesis", prompt, mark)])[0]
    if answer.error:
        log.warning("synthesis: %s", answer.error)
        return None
    sinks.write_json(file, answer.data)
    ledger["synthesis"] = {"input_hash": mark, "model": ai["model"], "provider": ai["provider"]}
    sinks.write_json(_ledger_path(paths), ledger)
    return normal_synthesis(answer.data)


def run_chronicle(spark: SparkSession, root: Path, cfg: dict[str, Any], force: bool = False, service: extract.Extractor | None = None) -> Path:
    """Stage the chronicle: data.json, images and reference pictures in one folder.

    Rendering needs the typst package, which is optional: RuntimeError says so if a template is
    configured and the package is missing. Without one configured the shipped template is used
    where the package is there.
    """
    paths, pdf = sinks.session_paths(root), config.pdf_settings(cfg)
    assets = root / pdf["assets_dir"]
    results = readers.read_results(spark, str(paths["manual_ai_results"]))[0].cache()
    synthesis = run_synthesis(spark, root, cfg, results, force, service)
    if synthesis:
        sinks.write_lines(paths["reports"] / "image_prompts.md", sinks.image_prompt_lines(synthesis["scenes"]))
    images = readers.scene_images(spark, str(assets))
    data = sinks.pdf_data(results, cfg["session_name"], pdf["campaign_title"], pdf["subtitle"], synthesis, readers.read_party(spark, root), images)
    build = paths["cache"] / "pdf_build"
    shutil.rmtree(build, ignore_errors=True)
    (build / "images").mkdir(parents=True)
    for r in images.collect():
        shutil.copy(assets / r["file"], build / "images" / f"scene{r['n']}{Path(r['file']).suffix.lower()}")
    for member in data["party"]:
        ref = member.get("ref")
        if ref and (assets / ref).is_file():
            shutil.copy(assets / ref, build / "images" / Path(ref).name)
            member["ref_file"] = f"images/{Path(ref).name}"
    sinks.write_json(build / "data.json", data)
    results.unpersist()
    template = pdf.get("template") or (TEMPLATE if importlib.util.find_spec("typst") else None)
    if template:
        render(Path(template), build, paths["reports"] / f"{cfg['session_name']}.pdf")
    return build / "data.json"


def render(template: Path, build: Path, out: Path) -> None:
    try:
        import typst
    except ImportError as e:
        raise RuntimeError("rendering a PDF needs the typst package") from e
    shutil.copy(template, build / template.name)
    fonts = build / "fonts"
    typst.compile(str(build / template.name), output=str(out), **({"font_paths": [str(fonts)]} if fonts.is_dir() else {}))


def run_session(spark: SparkSession, root: Path, cfg: dict[str, Any], source: readers.SegmentSource | recognise.Recogniser) -> None:
    """From a recogniser or stored segments to reports: all tracks in one row order, then the rebuild path.

    A recogniser hears cleaned, limited and gated audio. Stored segments take what they lack
    (names, priority, index) from their track.
    """
    paths = sinks.session_paths(root)
    if hasattr(source, "recognise"):
        found = recognise.track_rows(spark, root, cfg, source)
    else:
        tracks = readers.discover_tracks([p.name for p in root.iterdir() if p.is_file()], cfg)
        table = readers.track_table(spark, tracks) if tracks else None
        found = [readers.with_track_defaults(source.segments(spark, t), table).withColumn("seg_idx", F.monotonically_increasing_id()) for t in tracks]
    if not found:
        raise RuntimeError("no tracks, nothing to do")
    rows = chunks.within_minutes(chunks.union_tracks(found), cfg.get("limit_minutes"))
    sinks.write_jsonl(rows.drop("seg_idx"), raw_path(paths, cfg))
    run_rebuild(spark, root, cfg)
    if run_extract(spark, root, cfg):
        run_report(spark, root, cfg)
        if config.pdf_settings(cfg)["enabled"]:
            try:
                run_chronicle(spark, root, cfg)
            except Exception:  # a chronicle never fails a run
                log.exception("no chronicle")


