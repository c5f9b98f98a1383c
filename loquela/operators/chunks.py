"""Tumbling chunks with a data-dependent origin, a scene class for each, and prompts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loquela.functions.text import hms_ms

# Stems and whole words that tell a scene's kind; the first rule that holds wins.
COMBAT_WORDS = "инициатив|атака|урон|спасброс|хитов|двадцат|натуралк|куб|брос|d20|д20"
RECAP = "прошл(ой|ая|ую)|рекап|в прошлой игре|что случилось"
SETUP = "микрофон|слышно|запис|наушник|погромче|потише|прибавь|включ"
SOCIAL = "договор|убежд|спрос|охранник|настоятельниц|колледж|таверн|библиотек"


# What extraction results may say.
LEVELS = "low|medium|high"
ROLL_TYPES = "attack|damage|save|skill|initiative|other"
CATEGORIES = "combat|social|support|idea|roleplay|fun|story"


def chunk_seconds(minutes: float = 10) -> int:
    return int(float(minutes) * 60)


def scene_type(text: Column, combat: str = COMBAT_WORDS, recap: str = RECAP, setup: str = SETUP, social: str = SOCIAL) -> Column:
    """The scene's class from its whole lower-cased text; combat words count as bare words only."""
    t = F.lower(F.coalesce(text, F.lit("")))
    word = rf"(?<![\p{{L}}\p{{N}}_])(?:{combat})(?![\p{{L}}\p{{N}}_])"
    return (
        F.when(t.rlike(word), "combat_or_rolls")
        .when(F.regexp_count(t, F.lit(recap)) >= 2, "recap")
        .when(F.regexp_count(t, F.lit(setup)) >= 4, "setup")
        .when(t.rlike(social), "social_or_exploration")
        .otherwise("gameplay")
    )


def with_chunk(rows: DataFrame, seconds: int, key: str = "session") -> DataFrame:
    """Adds chunk_index, chunk_start and chunk_end. The origin is the first row's start (by pos),
    floored to a whole chunk; it comes from an aggregate with one row for each session."""
    origin = rows.groupBy(key).agg((F.floor(F.min_by("start", "pos") / seconds) * seconds).alias("_0"))
    index = F.floor((F.col("start") - F.col("_0")) / seconds).cast("long")
    begin = (F.col("_0") + index * seconds).cast("long")
    return rows.join(origin, key).withColumns({"chunk_index": index, "chunk_start": begin, "chunk_end": begin + seconds}).drop("_0")


def make_chunks(rows: DataFrame, minutes: float = 10, key: str = "session") -> DataFrame:
    """One row for each chunk that has rows: index, scene type, bounds, and events in row order."""
    event = F.struct("pos", F.struct(F.col("start_hms").alias("time"), "start", "end", "speaker", "character", "text").alias("e"))
    dealt = with_chunk(rows, chunk_seconds(minutes), key)
    grouped = dealt.groupBy(key, "chunk_index", F.col("chunk_start").alias("start"), F.col("chunk_end").alias("end")).agg(F.transform(F.array_sort(F.collect_list(event)), lambda x: x["e"]).alias("events"))
    joined = F.array_join(F.transform("events", lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return grouped.select(key, "chunk_index", scene_type(joined).alias("scene_type"), "start", "end", hms_ms(F.col("start")).alias("start_hms"), hms_ms(F.col("end")).alias("end_hms"), "events")


def chunk_name(index: Column, test: bool = False) -> Column:
    """File stem of a chunk; test runs have names of their own."""
    return F.format_string(("test_" if test else "") + "chunk_%03d", index)


def party_lines(party: DataFrame) -> str:
    """What a party table says about who can do what; empty without members. Party tables are a handful of rows."""
    about = F.concat(
        F.lit("- "),
        "name",
        F.coalesce(F.concat(F.lit(" — "), F.nullif("class_ru", F.lit(""))), F.lit("")),
        F.when(F.size("spells") > 0, F.concat(F.lit(". Заклинания: "), F.array_join("spells", ", "))).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(". Особенности: "), F.nullif("notes_ru", F.lit(""))), F.lit("")),
    )
    lines = [r[0] for r in party.filter(F.coalesce("name", F.lit("")) != "").select(about).collect()]
    return "\n".join(["Состав партии (кому принадлежат действия и заклинания):", *lines]) if lines else ""


def chunk_prompts(chunks: DataFrame, party: str = "", key: str = "session") -> DataFrame:
    """(key, chunk_index, name, prompt): an extraction request around each chunk's JSON."""
    ask = (
        "Разбери фрагмент записи настольной игры и верни один JSON-объект без обёртки: session, chunk_index, scene_type, "
        "actions[time, character, action, outcome, importance], dice_rolls[time, character, roll_type, die, natural, modifier, total, context, confidence, raw_text], "
        "mvp_signals[time, character, category, reason, weight], summary.\n"
        f"Допустимые значения: importance и confidence — {LEVELS}; roll_type — {ROLL_TYPES}; category — {CATEGORIES}.\n"
        "Как заполнять:\n"
        "* Время бери из фрагмента. В dice_rolls отделяй natural (что на кубе) от modifier и total; чего не слышно — null и confidence low.\n"
        "* Имена оставляй как в записи; при сомнении в говорящем называй самого вероятного и ставь confidence low.\n"
        "* mvp_signals — за влияние на игру (решения, помощь, переговоры, расследование, отыгрыш), а не только за урон; шутка весит не больше 1.\n"
        "* scene_type setup: разговоры о микрофонах и громкости — importance не выше low, кроме начала игры или пересказа.\n"
        "* scene_type recap: прошлое помечай как воспоминание, сигналы давай лишь за полезные уточнения."
    )
    body = F.to_json(F.struct(key, "chunk_index", "scene_type", "start", "end", "start_hms", "end_hms", "events"), {"pretty": "true", "ignoreNullFields": "false"})
    prompt = F.concat_ws("\n\n", F.lit(ask), F.lit(party or None).cast("string"), body)
    return chunks.select(key, "chunk_index", chunk_name(F.col("chunk_index")).alias("name"), prompt.alias("prompt"))


def union_tracks(tracks: list[DataFrame], key: str = "session") -> DataFrame:
    """All tracks' rows with pos by (start, end, speaker, track_index, seg_idx), the one row order."""
    rows = tracks[0]
    for t in tracks[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("start", "end", "speaker", "track_index", "seg_idx")
    return rows.withColumn("pos", F.row_number().over(w).cast("long"))


def within_minutes(rows: DataFrame, minutes: float | None) -> DataFrame:
    """Rows that start in the first minutes; the filter reaches the scan."""
    return rows if not minutes else rows.filter(F.col("start") < float(minutes) * 60)


def as_segments(found: DataFrame, track: dict, session: str) -> DataFrame:
    """Recognised (start, end, text, metrics) rows as segments of a track: empty texts go, ends
    are after starts, names default from each other and the file."""
    file = track["file"]
    character = track.get("character") or track.get("speaker") or file
    speaker = track.get("speaker") or track.get("character") or file
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    end = F.when(F.col("end") <= F.col("start"), F.col("start") + 0.01).otherwise(F.col("end"))
    rows = found.withColumns({"text": text, "end": end}).filter("text <> ''")
    fixed = {"session": session, "source_file": file, "speaker": speaker, "character": character, "duplicate_status": "raw"}
    rows = rows.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"speaker_priority": F.lit(int(track.get("priority", 50))), "track_index": F.lit(track.get("index")).cast("int")})
    return rows.withColumns({"start_hms": hms_ms(F.col("start")), "end_hms": hms_ms(F.col("end"))})


def with_audio(rows: DataFrame, backend: str | None, file: str, preprocessed: bool, limited: bool) -> DataFrame:
    """Says what audio the rows were recognised from."""
    return rows.withColumns({"transcription_backend": F.lit(backend).cast("string"), "transcription_file": F.lit(file), "audio_preprocessed": F.lit(preprocessed), "audio_limited": F.lit(limited)})




