"""Row types of the engine's tables, as DDL that readers take."""

WORD = "struct<start: double, end: double, word: string>"
LOSER = "struct<start: double, end: double, start_hms: string, end_hms: string, text: string, source_file: string, speaker: string, character: string, rms_db: double, rms_db_original: double>"
PART = "struct<start: double, end: double, text: string, source_file: string, speaker: string>"

#: One utterance. `pos` gives the row order that sequence operators follow.
SEGMENT = f"""session string, track_index int, source_file string, transcription_backend string, transcription_file string,
    audio_preprocessed boolean, audio_limited boolean, speaker string, character string, speaker_priority int,
    start double, end double, start_hms string, end_hms string, text string,
    avg_logprob double, no_speech_prob double, compression_ratio double, rms_db double, rms_db_original double,
    duplicate_status string, deduped_from array<{LOSER}>, words array<{WORD}>,
    timing_repair array<string>, merged_from array<{PART}>"""

ACTION = "struct<time: string, character: string, action: string, outcome: string, importance: string>"
ROLL = "struct<time: string, character: string, roll_type: string, die: string, natural: int, modifier: int, total: int, context: string, confidence: string, raw_text: string>"
SIGNAL = "struct<time: string, character: string, category: string, reason: string, weight: variant>"
RESULT = f"session string, chunk_index int, scene_type string, actions array<{ACTION}>, dice_rolls array<{ROLL}>, mvp_signals array<{SIGNAL}>, summary string"

#: The fields that an extraction result and a synthesis must have.
RESULT_FIELDS = ("actions", "dice_rolls", "mvp_signals", "summary")
SYNTHESIS_FIELDS = ("recap", "quest_hooks", "scenes")

PARTY = "name string, class_ru string, player string, ref string, spells array<string>, notes_ru string, appearance_en string"
LEDGER = "name string, chunk_hash string, model string, provider string, status string, batch_id string"


def _object(**fields: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}


def _list(**fields: dict) -> dict:
    return {"type": "array", "items": _object(**fields)}


_TEXT, _INT = {"type": "string"}, {"type": "integer"}
_LEVEL = {"type": "string", "enum": ["low", "medium", "high"]}
_MAYBE = lambda kind: {"anyOf": [kind, {"type": "null"}]}

#: JSON Schema that a model's answer for one chunk is held to.
RESULT_JSON_SCHEMA = _object(
    session=_TEXT,
    chunk_index=_INT,
    scene_type=_TEXT,
    actions=_list(time=_TEXT, character=_TEXT, action=_TEXT, outcome=_TEXT, importance=_LEVEL),
    dice_rolls=_list(
        time=_TEXT, character=_TEXT, roll_type=_TEXT, die=_MAYBE(_TEXT), natural=_MAYBE(_INT), modifier=_MAYBE(_INT),
        total=_MAYBE(_INT), context=_TEXT, confidence=_LEVEL, raw_text=_TEXT,
    ),
    mvp_signals=_list(time=_TEXT, character=_TEXT, category=_TEXT, reason=_TEXT, weight=_INT),
    summary=_TEXT,
)
#: The same for the synthesis of a session.
SYNTHESIS_JSON_SCHEMA = _object(
    recap=_TEXT,
    quest_hooks=_list(title=_TEXT, description=_TEXT),
    scenes=_list(title=_TEXT, chunk_index=_INT, time=_TEXT, image_prompt=_TEXT),
)
