"""Registered queries over the driver's tables, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loquela.functions import text
from loquela.operators import audio, chunks, dedup, folds, jobs, merge, quality, reports, timing
from loquela.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View V: scored signals from `events`."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("character"),
        F.col("user_id").alias("source"),
        F.get_json_object("props", "$.k").cast("int").alias("natural"),
        F.floor(F.col("value") / 100).cast("int").alias("weight"),
    )


V_SQL = """SELECT event_id, ts, event_type AS "character", user_id AS source,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS "natural",
  CAST(floor(value / 100) AS INTEGER) AS weight FROM events"""


@query(
    "dice_stats",
    f"""WITH v AS ({V_SQL})
SELECT coalesce(nullif("character", ''), '?') AS "character", round(avg("natural"), 9) AS avg_natural,
  count(*) AS n, count(*) FILTER ("natural" = 20) AS nat20, count(*) FILTER ("natural" = 1) AS nat1
FROM v WHERE "natural" IS NOT NULL GROUP BY 1""",
)
def dice_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dice_stats(signals(spark, sf_dir)).withColumn("avg_natural", F.round("avg_natural", 9))


# Views over the driver's tables


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View T: `conversations` as segments; times come from whole milliseconds."""
    start = F.col("turn") * 20000
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"),
        F.col("turn").alias("pos"),
        F.col("role").alias("source_file"),
        F.col("role").alias("speaker"),
        F.lit("").alias("character"),
        "text",
        (start / 1000).alias("start"),
        ((start + 400 * F.length("text")) / 1000).alias("end"),
    )


T_SQL = """SELECT conv_id AS session, turn AS pos, role AS source_file, role AS speaker, '' AS "character", text,
  turn * 20000 / 1000.0::DOUBLE AS start, (turn * 20000 + 400 * length(text)) / 1000.0::DOUBLE AS "end" FROM conversations"""


def bled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View D: T and a quieter copy of every row from another source, a little later."""
    t = transcript(spark, sf_dir).withColumns({"rms_db": F.lit(-20.0), "speaker_priority": F.lit(50)})
    copy = t.withColumns({"source_file": F.lit("bleed"), "text": F.concat(F.lit("uh "), F.col("text")), "start": F.col("start") + 0.2, "end": F.col("end") + 0.2, "rms_db": F.lit(-30.0), "pos": F.col("pos") * 2 + 1})
    both = t.withColumn("pos", F.col("pos") * 2).unionByName(copy)
    names = {c: F.lit(None).cast("string") for c in ("start_hms", "end_hms")} | {"rms_db_original": F.col("rms_db")}
    return both.withColumns(names)


def _ms(c: str):
    return F.round(F.col(c) * 1000).cast("long")


# Scores, dice and counts


@query("mvp_scores", f"""SELECT "character", CAST(sum(weight) AS BIGINT) AS score, min(event_id) AS first_id FROM ({V_SQL}) GROUP BY 1""")
def mvp_scores(spark, sf_dir):
    return reports.scores(signals(spark, sf_dir), "event_id").select("character", "score", F.col("first.event_id").alias("first_id"))


@query("mvp_categories", f"""SELECT "character", CASE WHEN event_id % 2 = 0 THEN 'even' ELSE '?' END AS category, CAST(sum(weight) AS BIGINT) AS score FROM ({V_SQL}) GROUP BY 1, 2""")
def mvp_categories(spark, sf_dir):
    return reports.category_scores(signals(spark, sf_dir).withColumn("category", F.when(F.col("event_id") % 2 == 0, "even").otherwise("")))


@query("mvp_top30", f"SELECT event_id, weight FROM ({V_SQL}) ORDER BY weight DESC, event_id LIMIT 30")
def mvp_top30(spark, sf_dir):
    return reports.top_signals(signals(spark, sf_dir), "event_id").select("event_id", "weight")


@query("mvp_scoreboard", f"""SELECT "character", score, CAST(row_number() OVER (ORDER BY score DESC, f) AS INTEGER) AS place FROM (SELECT "character", CAST(sum(weight) AS BIGINT) AS score, min(event_id) AS f FROM ({V_SQL}) GROUP BY 1)""")
def mvp_scoreboard(spark, sf_dir):
    board = reports.scores(signals(spark, sf_dir), "event_id")  # a row for each character
    return board.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "first"))).select("character", "score", "place")


@query("speaker_counts", f"""SELECT coalesce(nullif("character", ''), nullif(speaker, ''), '?') AS name, count(*) AS n FROM ({T_SQL}) GROUP BY 1""")
def speaker_counts(spark, sf_dir):
    return quality.speaker_counts(transcript(spark, sf_dir))


@query("key_actions_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'purchase'")
def key_actions_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("importance", F.when(F.col("event_type") == "purchase", "high").otherwise("low"))
    return reports.key_actions(e).select("event_id", "event_type")


@query("json_props_coerce", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS weight, CAST(0 AS INTEGER) AS missing FROM events")
def json_props_coerce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", reports.weight(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")).alias("weight"), F.size(readers.missing_fields(F.col("props"), ("k",))).alias("missing"))


@query("timeline_order", """SELECT event_id, CAST(row_number() OVER (ORDER BY coalesce(t, ''), event_id) AS INTEGER) AS place FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS t FROM events WHERE event_type = 'error')""")
def timeline_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_type")).alias("time"))
    return folds.numbered(e.withColumn("time", F.coalesce("time", F.lit(""))), ["time", "event_id"]).select("event_id", F.col("place").cast("int").alias("place"))


# Text filters


@query("text_normalize", r"SELECT doc_id, translate(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ё', 'е') AS norm FROM documents")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.filter_form(F.col("text")).alias("norm"))


@query(
    "repeated_words",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ё', 'е'), '[a-zа-я0-9]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS distinct_words, max(n) AS most,
  sum(n) >= 4 AND (max(n) / sum(n) >= 0.7 OR (count(*) <= 2 AND sum(n) >= 6)) AS garbage,
  sum(n) >= 4 AND (max(n) / sum(n) >= 0.2 OR (count(*) <= 2 AND sum(n) >= 6)) AS garbage_at_fifth
FROM c GROUP BY 1""",
)
def repeated_words(spark, sf_dir):
    counts = quality.word_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    flag = lambda share: quality.is_repeated(F.col("n"), F.col("distinct_words"), F.col("most"), quality.QualityRules(top_share=share))
    return counts.withColumns({"garbage": flag(0.7), "garbage_at_fifth": flag(0.2)})


_NORM = r"translate(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), 'ё', 'е')"


@query("blacklist_substring", f"SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains({_NORM.format('d.text')}, {_NORM.format('b.text')}))")
def blacklist_substring(spark, sf_dir):
    return quality.phrase_hits(table(spark, sf_dir, "documents"), "text", table(spark, sf_dir, "benchmark").withColumnRenamed("text", "phrase"), "phrase").select("doc_id")


@query("blacklist_exact", f"SELECT doc_id FROM documents WHERE {_NORM.format('text')} IN (SELECT {_NORM.format('text')} FROM documents GROUP BY text HAVING count(*) > 1)")
def blacklist_exact(spark, sf_dir):
    """The phrase list: every text that several documents share."""
    d = table(spark, sf_dir, "documents")
    return quality.whole_text_hits(d, "text", d.groupBy(F.col("text").alias("phrase")).count().filter("count > 1"), "phrase").select("doc_id")


def _judged(spark, sf_dir):
    t = transcript(spark, sf_dir)
    n = F.length("text")
    return t.withColumns({"compression_ratio": (n % 100) / 10.0, "rms_db": -(n % 90).cast("double"), "avg_logprob": -(n % 20) / 10.0, "no_speech_prob": F.lit(None).cast("double"), "deduped_from": F.array().cast("array<string>")})


_JUDGED = f"(SELECT *, length(text) % 100 / 10.0::DOUBLE AS cr, -(length(text) % 90)::DOUBLE AS db, -(length(text) % 20) / 10.0::DOUBLE AS lp FROM ({T_SQL}))"


@query(
    "quality_reasons",
    f"""SELECT session, pos, concat_ws(',', CASE WHEN cr >= 8 THEN 'very_high_compression' WHEN cr >= 4 AND length(norm) > 8 THEN 'high_compression' END,
  CASE WHEN db <= -78 AND length(norm) >= 18 THEN 'low_rms' END) AS reasons
FROM (SELECT *, {_NORM.format("text")} AS norm FROM {_JUDGED})""",
)
def quality_reasons(spark, sf_dir):
    return quality.judge(_judged(spark, sf_dir)).select("session", "pos", F.concat_ws(",", "reject_reasons").alias("reasons"))


#: What a transcript's rows are made to say, by their length: every label of the filters, alone and together.
_SAID = ("{}", "{} Спасибо за  просмотр!", "Всем СПАСИБО", "да да да {} да да да да да да да да да", "но ну но ну но ну", "ещё раз Субтитры сделал ё", "ага ага ага ага", "Пока")


def _said(spark, sf_dir):
    j = _judged(spark, sf_dir)
    word = F.regexp_extract("text", "^[^ ]*", 0)
    said = F.array(*[F.format_string(s.replace("{}", "%s"), word) if "{}" in s else F.lit(s) for s in _SAID])
    return j.withColumn("text", F.element_at(said, F.length("text") % len(_SAID) + 1))


_SAID_SQL = f"""(SELECT * REPLACE (list_extract([{", ".join("'" + s.replace("{}", "' || regexp_extract(text, '^[^ ]*') || '") + "'" for s in _SAID)}], CAST(length(text) % {len(_SAID)} + 1 AS INTEGER)) AS text) FROM {_JUDGED})"""


@query(
    "quality_all_labels",
    f"""WITH t AS (SELECT *, {_NORM.format("text")} AS norm FROM {_SAID_SQL}),
w AS (SELECT session, pos, unnest(regexp_extract_all(norm, '[a-zа-я0-9]+')) AS w FROM t), c AS (SELECT session, pos, w, count(*) AS n FROM w GROUP BY 1, 2, 3),
r AS (SELECT session, pos, sum(n) AS n, count(*) AS d, max(n) AS most FROM c GROUP BY 1, 2)
SELECT t.session, t.pos, concat_ws(',',
  CASE WHEN {" OR ".join(f"contains(norm, {_NORM.format(chr(39) + p + chr(39))})" for p in quality.PHRASES)} OR norm IN ({", ".join(_NORM.format(chr(39) + p + chr(39)) for p in quality.WHOLE_TEXTS)}) THEN 'blacklist' END,
  CASE WHEN coalesce(r.n >= 4 AND (r.most / r.n >= 0.7 OR (r.d <= 2 AND r.n >= 6)), false) THEN 'repeated_words' END,
  CASE WHEN cr >= 8 THEN 'very_high_compression' WHEN cr >= 4 AND length(norm) > 8 THEN 'high_compression' END,
  CASE WHEN db <= -78 AND length(norm) >= 18 THEN 'low_rms' END) AS reasons FROM t LEFT JOIN r ON t.session = r.session AND t.pos = r.pos""",
)
def quality_all_labels(spark, sf_dir):
    return quality.judge(_said(spark, sf_dir)).select("session", "pos", F.concat_ws(",", "reject_reasons").alias("reasons"))


@query(
    "quality_summary",
    f"""WITH t AS (SELECT *, cr >= 8 OR (cr >= 4 AND length(norm) > 8) OR (db <= -78 AND length(norm) >= 18) AS bad FROM (SELECT *, {_NORM.format("text")} AS norm FROM {_JUDGED}))
SELECT count(*) AS raw_rows, count(*) FILTER (NOT bad) AS clean_rows, count(*) FILTER (bad) AS removed_total, CAST(coalesce(sum(pos % 3) FILTER (NOT bad), 0) AS BIGINT) AS absorbed,
  count(*) FILTER (NOT bad AND (lp < -1.2 OR cr > 2.6)) AS suspicious FROM t""",
)
def quality_summary(spark, sf_dir):
    raw = _judged(spark, sf_dir).withColumn("deduped_from", F.array_repeat(F.lit("x"), (F.col("pos") % 3).cast("int")))
    return quality.quality_summary(raw, quality.split(raw)[0])


@query("suspicious_first30", f"SELECT session, pos FROM {_JUDGED} WHERE lp < -1.2 OR cr > 2.6 ORDER BY session * 1000 + pos LIMIT 30")
def suspicious_first30(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumns({"p": F.col("pos"), "pos": F.col("session") * 1000 + F.col("pos")})
    return quality.first_suspicious(rows).select("session", F.col("p").alias("pos"))


# Timing

_CAPPED = f"""(SELECT *, CASE WHEN nx > start + 0.8 AND "end" > nx + 0.05 THEN nx ELSE "end" END AS e1,
  CASE WHEN length({_NORM.format("text")}) <= 40 THEN 4.0 WHEN length({_NORM.format("text")}) <= 90 THEN 7.0
    ELSE greatest(0.8, least(18.0, length({_NORM.format("text")}) / 13.0::DOUBLE + 1.2)) END AS cap
  FROM (SELECT *, lead(start) OVER (PARTITION BY session, source_file ORDER BY start, "end", pos) AS nx FROM ({T_SQL})))"""


@query("timing_lead_cap", f"""SELECT session, pos, CAST(round(e1 * 1000) AS BIGINT) AS end_ms, e1 <> "end" AS capped FROM {_CAPPED}""")
def timing_lead_cap(spark, sf_dir):
    rows = transcript(spark, sf_dir).withColumn("timing_repair", F.lit(None).cast("array<string>"))
    done = timing.cap_to_next(rows)
    return done.select("session", "pos", _ms("end").alias("end_ms"), F.col("timing_repair").isNotNull().alias("capped"))


@query("timing_text_cap", f"""SELECT session, pos, CAST(round((CASE WHEN "end" - start > cap THEN start + greatest(0.8, cap) ELSE "end" END) * 1000) AS BIGINT) AS end_ms FROM {_CAPPED}""")
def timing_text_cap(spark, sf_dir):
    rows = transcript(spark, sf_dir).withColumn("timing_repair", F.lit(None).cast("array<string>"))
    return timing.positive(timing.cap_by_text(rows)).select("session", "pos", _ms("end").alias("end_ms"))


@query(
    "timing_repair_full",
    f"""SELECT session, pos, CAST(round((CASE WHEN e2 <= start THEN start + 0.8 ELSE e2 END) * 1000) AS BIGINT) AS end_ms, CAST((e1 <> "end")::INT + (e2 <> e1)::INT + (e2 <= start)::INT AS INTEGER) AS repairs
FROM (SELECT *, CASE WHEN e1 - start > cap THEN start + greatest(0.8, cap) ELSE e1 END AS e2 FROM {_CAPPED})""",
)
def timing_repair_full(spark, sf_dir):
    done = timing.repair(transcript(spark, sf_dir))
    return done.select("session", "pos", _ms("end").alias("end_ms"), F.coalesce(F.size("timing_repair"), F.lit(0)).alias("repairs"))


@query(
    "hms_format",
    f"""SELECT session, pos, printf('%d:%02d:%02d', CAST(floor(start) AS BIGINT) // 3600, CAST(floor(start) AS BIGINT) % 3600 // 60, CAST(floor(start) AS BIGINT) % 60) AS hms,
  printf('%02d:%02d:%02d.%03d', CAST(floor("end") AS BIGINT) // 3600, CAST(floor("end") AS BIGINT) % 3600 // 60, CAST(floor("end") AS BIGINT) % 60, CAST(round_even(("end" - floor("end")) * 1000, 0) AS BIGINT)) AS ms,
  printf('%02d:%02d:%02d,%03d', CAST(floor("end") AS BIGINT) // 3600, CAST(floor("end") AS BIGINT) % 3600 // 60, CAST(floor("end") AS BIGINT) % 60, CAST(round_even(("end" - floor("end")) * 1000, 0) AS BIGINT)) AS srt
FROM ({T_SQL})""",
)
def hms_format(spark, sf_dir):
    t = transcript(spark, sf_dir)
    return t.select("session", "pos", text.hms(F.col("start")).alias("hms"), text.hms_ms(F.col("end")).alias("ms"), text.srt_time(F.col("end")).alias("srt"))


# Pairs and folds


@query(
    "interval_overlap_pairs",
    f"""WITH t AS ({T_SQL}) SELECT a.session, a.pos AS kept, b.pos AS later, round(greatest(0, least(a."end", b."end") - greatest(a.start, b.start)) / least(a."end" - a.start, b."end" - b.start), 9) AS share
FROM t a JOIN t b ON a.session = b.session AND a.pos < b.pos AND a.source_file <> b.source_file AND a.start < b."end" AND b.start < a."end" """,
)
def interval_overlap_pairs(spark, sf_dir):
    p = dedup.interval_pairs(transcript(spark, sf_dir), ["pos", "start", "end", "source_file"]).filter("a.source_file <> b.source_file")
    a, b = F.col("a"), F.col("b")
    return p.select("session", F.col("a.pos").alias("kept"), F.col("b.pos").alias("later"), F.round(dedup.overlap_ratio(a["start"], a["end"], b["start"], b["end"]), 9).alias("share"))


# View D's copies say "uh " before the text, so the ratio of a row and its copy is 2n / (2n + 3), which is over 0.84 from 8
# letters on; pairs of different texts stay far below it. Rows are told apart by what stands after that word. The
# registered queries count every letter (no autojunk), which SQL can follow; tests hold the default against its library.
WHOLE = dedup.DedupRules(autojunk=False)
_BLED = f"""(SELECT session, pos * 2 AS pos, source_file, speaker, text, start, "end", -20.0::DOUBLE AS db, text AS bare FROM ({T_SQL})
UNION ALL SELECT session, pos * 2 + 1, 'bleed', speaker, 'uh ' || text, start + 0.2, "end" + 0.2, -30.0::DOUBLE, text FROM ({T_SQL}))"""
_EDGES = f"""(SELECT a.session, a.pos AS kept, b.pos AS later, b.db >= a.db + 3 AS b_wins FROM {_BLED} a JOIN {_BLED} b
  ON a.session = b.session AND a.pos < b.pos AND a.source_file <> b.source_file AND a.start < b."end" AND b.start < a."end"
  WHERE length(a.text) >= 20 AND length(b.text) >= 20 AND lower(trim(a.bare)) = lower(trim(b.bare))
    AND greatest(0, least(a."end", b."end") - greatest(a.start, b.start)) / least(a."end" - a.start, b."end" - b.start) >= 0.45)"""


@query("dup_edges_fuzzy", f"SELECT * FROM {_EDGES}")
def dup_edges_fuzzy(spark, sf_dir):
    return dedup.duplicate_edges(bled(spark, sf_dir), WHOLE)


@query(
    "dedup_greedy",
    f"""WITH RECURSIVE e AS (SELECT session, later AS pos, list(kept) AS kept, list(kept) FILTER (b_wins) AS beaten FROM {_EDGES} GROUP BY 1, 2),
o AS (SELECT d.session, d.pos, row_number() OVER (PARTITION BY d.session ORDER BY d.pos) AS rn, coalesce(kept, []) AS kept, coalesce(beaten, []) AS beaten FROM {_BLED} d LEFT JOIN e ON d.session = e.session AND d.pos = e.pos),
r AS (SELECT session, rn, [pos] AS slots, CAST(1 AS BIGINT) AS slot FROM o WHERE rn = 1
  UNION ALL SELECT session, rn, CASE WHEN hit IS NULL THEN list_append(slots, pos) WHEN list_contains(beaten, slots[hit]) THEN list_transform(slots, lambda x, i: CASE WHEN i = hit THEN pos ELSE x END) ELSE slots END, coalesce(hit, len(slots) + 1)
  FROM (SELECT o.session, o.rn, o.pos, o.kept, o.beaten, r.slots, list_min(list_filter(range(greatest(1, len(r.slots) - 39), len(r.slots) + 1), lambda i: list_contains(o.kept, r.slots[i]))) AS hit
    FROM r JOIN o ON o.session = r.session AND o.rn = r.rn + 1)),
f AS (SELECT session, unnest(slots) AS pos, unnest(range(1, len(slots) + 1)) AS slot FROM r QUALIFY row_number() OVER (PARTITION BY session ORDER BY rn DESC) = 1),
n AS (SELECT session, slot, count(*) - 1 AS absorbed FROM r GROUP BY 1, 2)
SELECT f.session, CAST(row_number() OVER (PARTITION BY f.session ORDER BY d.start, d."end", d.speaker, d.pos) AS BIGINT) AS pos, d.source_file, CAST(round(d.start * 1000) AS BIGINT) AS start_ms, CAST(n.absorbed AS INTEGER) AS absorbed
FROM f JOIN n ON f.session = n.session AND f.slot = n.slot JOIN {_BLED} d ON d.session = f.session AND d.pos = f.pos""",
)
def dedup_greedy(spark, sf_dir):
    done = dedup.deduplicate(bled(spark, sf_dir), WHOLE)
    return done.select("session", "pos", "source_file", _ms("start").alias("start_ms"), F.size("deduped_from").alias("absorbed"))


def _gapped(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp")) / 1000
    return table(spark, sf_dir, "events").select(
        F.lit(1).alias("session"), F.col("event_id").alias("pos"), F.col("event_type").alias("character"), F.lit("").alias("speaker"), F.lit("s").alias("source_file"),
        at.alias("start"), (at + 1).alias("end"), F.repeat("event_type", F.get_json_object("props", "$.k").cast("int") + 1).alias("text"), F.lit(None).cast("double").alias("rms_db"),
    )


_GAPPED = """(SELECT event_id AS pos, event_type AS c, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS start, (epoch_us(ts) // 1000) / 1000.0::DOUBLE + 1 AS "end",
  repeat(event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) AS text FROM events)"""


@query(
    "merge_islands",
    f"""WITH j AS (SELECT *, coalesce(c = lag(c) OVER (ORDER BY pos) AND start - lag("end") OVER (ORDER BY pos) BETWEEN 0 AND 600, false) AS j FROM {_GAPPED}),
i AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS island FROM j)
SELECT CAST(island AS BIGINT) AS island, min(pos) AS first_pos, count(*) AS n FROM i GROUP BY 1""",
)
def merge_islands(spark, sf_dir):
    gap = lambda before: F.col("start") - before["end"]
    joins = lambda before: (F.col("character") == before["character"]) & (gap(before) >= 0) & (gap(before) <= 600)
    found = folds.long_islands(_gapped(spark, sf_dir), ["session"], ["pos"], ["character", "end"], joins)
    return found.groupBy("island").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


@query(
    "merge_adjacent_capped",
    f"""WITH RECURSIVE j AS (SELECT *, row_number() OVER (ORDER BY pos) AS rn, coalesce(c = lag(c) OVER (ORDER BY pos) AND start - lag("end") OVER (ORDER BY pos) BETWEEN 0 AND 600, false) AS j FROM {_GAPPED}),
r AS (SELECT rn, CAST(1 AS BIGINT) AS pack, length(text) AS size FROM j WHERE rn = 1
  UNION ALL SELECT j.rn, CASE WHEN j.j AND r.size + length(j.text) <= 420 THEN r.pack ELSE r.pack + 1 END,
    CASE WHEN j.j AND r.size + length(j.text) <= 420 THEN r.size + 1 + length(j.text) ELSE length(j.text) END FROM r JOIN j ON j.rn = r.rn + 1)
SELECT min(j.pos) AS pos, count(*) AS n, length(string_agg(j.text, ' ' ORDER BY j.pos)) AS chars, CAST(round(max(j."end") * 1000) AS BIGINT) AS end_ms FROM r JOIN j USING (rn) GROUP BY r.pack""",
)
def merge_adjacent_capped(spark, sf_dir):
    m = merge.merge_adjacent(_gapped(spark, sf_dir), max_gap=600)
    return m.select("pos", (F.coalesce(F.size("merged_from"), F.lit(0)) + 1).cast("long").alias("n"), F.length("text").cast("long").alias("chars"), _ms("end").alias("end_ms"))


def _bursts(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp")) / 1000
    return table(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + 60).alias("end"))


_REGIONS = """(WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS start, (epoch_us(ts) // 1000) / 1000.0::DOUBLE + 60 AS "end" FROM events),
j AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY user_id ORDER BY start, "end") <= 14400, false) THEN 0 ELSE 1 END AS b FROM e),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY start, "end") AS island FROM j)
SELECT user_id, min(start) AS start, arg_max("end", start) AS "end" FROM i GROUP BY user_id, island)"""


@query("vad_region_merge", f"""SELECT user_id, CAST(round(start * 1000) AS BIGINT) AS start_ms, CAST(round("end" * 1000) AS BIGINT) AS end_ms FROM {_REGIONS}""")
def vad_region_merge(spark, sf_dir):
    return folds.vad_regions(_bursts(spark, sf_dir), ["user_id"], 14400).select("user_id", _ms("start").alias("start_ms"), _ms("end").alias("end_ms"))


@query(
    "vad_buckets",
    f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, "end") AS rn FROM {_REGIONS}),
r AS (SELECT user_id, rn, CAST(0 AS BIGINT) AS bucket, start AS f FROM g WHERE rn = 1
  UNION ALL SELECT g.user_id, g.rn, CASE WHEN g."end" - r.f > 86400 THEN r.bucket + 1 ELSE r.bucket END, CASE WHEN g."end" - r.f > 86400 THEN g.start ELSE r.f END FROM r JOIN g ON g.user_id = r.user_id AND g.rn = r.rn + 1)
SELECT r.user_id, bucket, count(*) AS regions, CAST(round(min(g.start) * 1000) AS BIGINT) AS start_ms FROM r JOIN g ON g.user_id = r.user_id AND g.rn = r.rn GROUP BY 1, 2""",
)
def vad_buckets(spark, sf_dir):
    b = folds.vad_buckets(folds.vad_regions(_bursts(spark, sf_dir), ["user_id"], 14400), ["user_id"], 86400)
    return b.groupBy("user_id", "bucket").agg(F.count("*").alias("regions"), F.min(_ms("start")).alias("start_ms"))


@query("speech_share", f"""SELECT user_id, round(sum("end" - start), 6) AS speech, round(sum("end" - start) / 1e6, 9) AS share FROM {_REGIONS} GROUP BY 1""")
def speech_share(spark, sf_dir):
    found = folds.speech_share(folds.vad_regions(_bursts(spark, sf_dir), ["user_id"], 14400).withColumn("d", F.lit(1e6)), ["user_id"], "d")
    return found.select("user_id", F.round("speech", 6).alias("speech"), F.round("share", 9).alias("share"))


# Chunks


def _by_user(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp")) / 1000
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), at.alias("start"), (at + 1).alias("end"), F.col("event_type").alias("text"), F.col("event_type").alias("speaker"), F.lit(None).cast("string").alias("character"), text.hms_ms(at).alias("start_hms"))


_CHUNKS = """(SELECT user_id AS session, event_id AS pos, event_type, s, o, CAST(floor((s - o) / 86400) AS BIGINT) AS chunk_index
FROM (SELECT *, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS s, floor(first_value((epoch_us(ts) // 1000) / 1000.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id) / 86400) * 86400 AS o FROM events))"""


@query("tumbling_chunks", f"SELECT session, chunk_index, CAST(min(o) + chunk_index * 86400 AS BIGINT) AS chunk_start, count(*) AS n FROM {_CHUNKS} GROUP BY 1, 2")
def tumbling_chunks(spark, sf_dir):
    return chunks.with_chunk(_by_user(spark, sf_dir), 86400).groupBy("session", "chunk_index").agg(F.min("chunk_start").alias("chunk_start"), F.count("*").alias("n"))


@query("chunk_events_nested", f"SELECT session, chunk_index, count(*) AS n, arg_min(event_type, pos) AS first_text, arg_max(event_type, pos) AS last_text, string_agg(event_type, ' ' ORDER BY pos) AS joined FROM {_CHUNKS} GROUP BY 1, 2")
def chunk_events_nested(spark, sf_dir):
    c = chunks.make_chunks(_by_user(spark, sf_dir), 24 * 60)
    e = F.col("events")
    return c.select("session", "chunk_index", F.size(e).cast("long").alias("n"), e[0]["text"].alias("first_text"), F.element_at(e, -1)["text"].alias("last_text"), F.array_join(F.transform(e, lambda x: x["text"]), " ").alias("joined"))


@query(
    "scene_type",
    r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(thing|ander)([^\p{L}\p{N}_]|$)') THEN 'combat_or_rolls'
  WHEN len(regexp_extract_all(lower(text), 'tion')) >= 2 THEN 'recap'
  WHEN len(regexp_extract_all(lower(text), 'keit|schaf')) >= 4 THEN 'setup' WHEN regexp_matches(lower(text), 'eau|ción') THEN 'social_or_exploration' ELSE 'gameplay' END AS scene FROM documents""",
)
def scene_type(spark, sf_dir):
    scene = chunks.scene_type(F.col("text"), "thing|ander", "tion", "keit|schaf", "eau|ción")
    return table(spark, sf_dir, "documents").select("doc_id", scene.alias("scene"))


#: Words that the default lists tell scenes by, and some that they must not be misled by.
_SCENES = ("атака", "атаковать", "кубик", "прошлая", "в прошлой игре", "микрофон", "включи", "включить запись", "слышно", "таверна", "просто идём", "d20")
_SCENE_TEXT = " || ' ' || ".join(f"list_extract([{', '.join(chr(39) + w + chr(39) for w in _SCENES)}], CAST((n_chars // {k}) % {len(_SCENES)} + 1 AS INTEGER))" for k in (1, 5, 7, 11, 13, 17))


@query(
    "scene_type_defaults",
    rf"""WITH t AS (SELECT doc_id, {_SCENE_TEXT} AS text FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])({chunks.COMBAT_WORDS})([^\p{{L}}\p{{N}}_]|$)') THEN 'combat_or_rolls'
  WHEN len(regexp_extract_all(lower(text), '{chunks.RECAP}')) >= 2 THEN 'recap' WHEN len(regexp_extract_all(lower(text), '{chunks.SETUP}')) >= 4 THEN 'setup'
  WHEN regexp_matches(lower(text), '{chunks.SOCIAL}') THEN 'social_or_exploration' ELSE 'gameplay' END AS scene FROM t""",
)
def scene_type_defaults(spark, sf_dir):
    said = [F.element_at(F.array(*map(F.lit, _SCENES)), (F.floor(F.col("n_chars") / k) % len(_SCENES)).cast("int") + 1) for k in (1, 5, 7, 11, 13, 17)]
    return table(spark, sf_dir, "documents").select("doc_id", chunks.scene_type(F.concat_ws(" ", *said)).alias("scene"))


# Audio levels


def _levels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.lit(1).alias("session"), F.col("event_type").alias("track"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 21600000).cast("long").alias("win")).agg(F.max("value").alias("db"))


_LEVELS = "(SELECT event_type AS track, CAST(floor((epoch_us(ts) // 1000) / 21600000) AS BIGINT) AS win, max(value) AS db FROM events GROUP BY 1, 2)"


@query(
    "leader_gate",
    f"""SELECT track, win, round(leader, 6) AS leader, max(k) OVER (PARTITION BY track ORDER BY win ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS keep
FROM (SELECT *, max(db) OVER (PARTITION BY win) AS leader, CASE WHEN db >= max(db) OVER (PARTITION BY win) - 60 OR max(db) OVER (PARTITION BY win) <= -55 THEN 1 ELSE 0 END AS k FROM {_LEVELS})""",
)
def leader_gate(spark, sf_dir):
    return audio.leader_gate(_levels(spark, sf_dir), margin_db=60).select("track", "win", F.round("leader", 6).alias("leader"), "keep")


@query(
    "muted_share",
    f"""SELECT track, round(1 - avg(CASE WHEN keep THEN 1 ELSE 0 END), 9) AS muted FROM (SELECT track, max(k) OVER (PARTITION BY track ORDER BY win ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS keep
FROM (SELECT *, CASE WHEN db >= max(db) OVER (PARTITION BY win) - 60 THEN 1 ELSE 0 END AS k FROM {_LEVELS}
  WHERE win <= (SELECT min(m) FROM (SELECT max(win) AS m FROM {_LEVELS} GROUP BY track)))) GROUP BY 1""",
)
def muted_share(spark, sf_dir):
    gated = audio.leader_gate(audio.aligned(_levels(spark, sf_dir)), margin_db=60)
    return audio.muted_share(gated).select("track", F.round("muted", 9).alias("muted"))


@query("frame_rms_db", "SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding))), 9) AS db FROM embeddings")
def frame_rms_db(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(audio.array_rms_db(F.col("embedding")), 9).alias("db"))


@query("rms_envelope", "SELECT vec_id, CAST(i // 16 AS BIGINT) AS win, round(20 * log10(sqrt(avg(x * x)) + 1e-10), 9) AS db FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def rms_envelope(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return audio.envelope(s, ["vec_id"], 16).withColumn("db", F.round("db", 9))


# Jobs


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.col("text").alias("prompt"), text.fingerprint16(F.col("text")).alias("chunk_hash"))


@query(
    "budget_packs",
    """WITH RECURSIVE c AS (SELECT doc_id, length(text) // 3 + 8000 AS cost, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT rn, doc_id, cost, CAST(0 AS BIGINT) AS pack, cost AS size FROM c WHERE rn = 1
  UNION ALL SELECT c.rn, c.doc_id, c.cost, CASE WHEN r.size + c.cost > 700000 THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.size + c.cost > 700000 THEN c.cost ELSE r.size + c.cost END FROM r JOIN c ON c.rn = r.rn + 1)
SELECT doc_id, cost, pack FROM r""",
)
def budget_packs(spark, sf_dir):
    return jobs.batches(_jobs(spark, sf_dir), order="doc_id")


@query("job_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0)")
def job_anti_join(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), (F.col("doc_id") % 3 == 0).alias("stale"))
    current = j.join(done, "name").select("name", F.when(F.col("stale"), F.lit("old")).otherwise(F.col("chunk_hash")).alias("chunk_hash"))
    return jobs.to_run(j, done.select("name"), current).select("doc_id")


@query("resume_leftover", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def resume_leftover(spark, sf_dir):
    answers = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("toxic") != 0, "failed").alias("error"))
    return jobs.leftovers(_jobs(spark, sf_dir), answers).select("doc_id")


@query("job_hash_back", "SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'pending' ELSE substr(sha1(d.text), 1, 16) END AS chunk_hash FROM labels l LEFT JOIN documents d USING (doc_id)")
def job_hash_back(spark, sf_dir):
    named = table(spark, sf_dir, "labels").withColumn("name", F.col("doc_id").cast("string"))
    pending = named.filter("quality = 1").select("name", F.lit("pending").alias("chunk_hash"))
    return jobs.with_hashes(named.select("doc_id", "name"), _jobs(spark, sf_dir), pending).select("doc_id", "chunk_hash")


@query("ledger_upsert", "SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'new' ELSE 'old' END AS status FROM documents")
def ledger_upsert(spark, sf_dir):
    old = _jobs(spark, sf_dir).select("name", F.lit("old").alias("status"))
    news = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("name"), F.lit("new").alias("status"))
    return jobs.upsert(old, news)


@query("content_fingerprint", "SELECT doc_id, substr(sha1(text), 1, 16) AS hash, substr(sha1(concat_ws(':', source, n_chars::VARCHAR, (doc_id * 60)::VARCHAR)), 1, 16) AS file_hash FROM documents")
def content_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.fingerprint16(F.col("text")).alias("hash"), text.file_fingerprint(F.col("source"), F.col("n_chars"), F.col("doc_id") * 60).alias("file_hash"))


@query(
    "union_tracks_sorted",
    f"""SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY start, "end", speaker, seg_idx) AS BIGINT) AS pos, seg_idx, speaker FROM (SELECT *, pos AS seg_idx FROM ({T_SQL}))""",
)
def union_tracks_sorted(spark, sf_dir):
    t = transcript(spark, sf_dir).withColumnRenamed("pos", "seg_idx").withColumn("track_index", F.lit(1))
    parts = [t.filter(F.col("speaker") == "user"), t.filter(F.col("speaker") != "user")]
    return chunks.union_tracks(parts).select("session", "pos", "seg_idx", "speaker")


@query(
    "duration_parse",
    """WITH s(t) AS (VALUES ('6m0s'), ('1.5s'), ('20ms'), ('1h2m3s'), (''), ('garbage')),
p AS (SELECT t, unnest(regexp_extract_all(t, '[0-9]+(?:[.][0-9]+)?(?:ms|h|m|s)')) AS x FROM s)
SELECT s.t, round(sum(CAST(regexp_extract(x, '^[0-9.]+') AS DOUBLE) * CASE regexp_extract(x, '[a-z]+$') WHEN 'ms' THEN 0.001 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END), 6) AS seconds FROM s LEFT JOIN p USING (t) GROUP BY 1""",
)
def duration_parse(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in ("6m0s", "1.5s", "20ms", "1h2m3s", "", "garbage")], "t string")
    return rows.select("t", F.round(text.duration_seconds(F.col("t")), 6).alias("seconds"))


@query("record_defaults", "SELECT doc_id, coalesce(NULLIF(lang, 'fr'), '') AS lang, coalesce(source, '') AS source FROM documents")
def record_defaults(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("lang", F.nullif("lang", F.lit("fr")))
    return reports.filled(d, {"lang": "", "source": ""}, "doc_id")


@query("within_minutes", f"SELECT session, pos FROM ({T_SQL}) WHERE start < 60")
def within_minutes(spark, sf_dir):
    return chunks.within_minutes(transcript(spark, sf_dir), 1).select("session", "pos")


@query("rebuild_rows")
def rebuild_rows(spark, sf_dir):
    """The whole cleaning path over view D."""
    from loquela.plans import rebuild

    done = rebuild.clean(bled(spark, sf_dir).withColumn("compression_ratio", F.lit(1.0)))[0]
    return done.select("session", "pos", "source_file", _ms("start").alias("start_ms"), _ms("end").alias("end_ms"), F.length("text").alias("chars"))
