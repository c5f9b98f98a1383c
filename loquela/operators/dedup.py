"""Cross-source duplicates: an interval join with a fuzzy test, then an ordered greedy resolver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

LOSER = ("start", "end", "start_hms", "end_hms", "text", "source_file", "speaker", "character", "rms_db", "rms_db_original")


@dataclass(frozen=True)
class DedupRules:
    enabled: bool = True
    similarity: float = 0.84
    overlap: float = 0.45
    least_chars: int = 20
    look_back: int = 40
    louder_db: float = 3.0
    priority_gap: int = 20
    longer_chars: int = 5
    autojunk: bool = True


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared time over the shorter duration; zero where the shorter one is not positive."""
    shared = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    shorter = F.least(a_end - a_start, b_end - b_start)
    return F.when(shorter <= 0, F.lit(0.0)).otherwise(shared / shorter)


def common_letters(a: str, place: dict[str, int]) -> int:
    """Length of the longest common subsequence of a and the text whose letters have the bits
    `place`: matching blocks hold no more letters. A row of the usual table is one number here."""
    full = v = (1 << max((m.bit_length() for m in place.values()), default=0)) - 1
    for c in a:
        u = v & place.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return full.bit_count() - v.bit_count()


def letter_places(text: str) -> dict[str, int]:
    """For each letter of a text, the bits of where it stands."""
    place: dict[str, int] = {}
    for i, c in enumerate(text):
        place[c] = place.get(c, 0) | 1 << i
    return place


def text_similarity(autojunk: bool = True, least: float = 0.0):
    """Arrow UDF of (later text, kept text): the matching-block ratio of their stripped lower
    case. It is not symmetric, and with autojunk it passes over frequent letters of long texts.
    Pairs whose letters, or their longest common subsequence, rule `least` out get 0; a kept text
    is analysed once in a row."""

    @F.pandas_udf(DoubleType())
    def ratio(later: pd.Series, kept: pd.Series) -> pd.Series:
        found, matcher, now = [0.0] * len(later), SequenceMatcher(None, "", "", autojunk), ""
        placed, place = None, {}
        pairs = [(b.lower().strip(), a.lower().strip(), i) for i, (a, b) in enumerate(zip(later, kept, strict=True))]
        for b, a, i in sorted(pairs):
            if not autojunk and (a in b or b in a):  # the shorter one is the longest block there can be
                found[i] = 2 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 1.0
                continue
            if least and a and b:
                if 2 * min(len(a), len(b)) / (len(a) + len(b)) < least:
                    continue
                if b != placed:
                    placed, place = b, letter_places(b)
                if 2 * common_letters(a, place) / (len(a) + len(b)) < least:
                    continue
            if b != now:
                matcher.set_seq2(b)
                now = b
            matcher.set_seq1(a)
            found[i] = matcher.ratio()
        return pd.Series(found, dtype="float64")

    return ratio


def interval_pairs(rows: DataFrame, columns: list[str], key: str = "session", bucket: float | None = None) -> DataFrame:
    """(key, a, b) pairs of rows whose intervals overlap in time, a before b by pos; a and b
    are structs of `columns`, which include pos, start and end.

    A range join as a hash join: intervals are listed under every bucket of time that they
    touch, and a pair is kept in the later one's first bucket, so it comes out once, whatever
    the bucket. With one that 99 of 100 intervals fit, these are listed twice at most; that
    length is measured where none is given, and a thousandth of the longest interval at least,
    so that an outlier is listed a thousand times and makes no one's bucket longer.
    """
    if bucket is None:
        size = F.col("end") - F.col("start")
        longest, usual = rows.agg(F.max(size), F.percentile_approx(size, 0.99)).first()
        bucket = max(1.0, float(usual or 0), float(longest or 0) / 1000)
    slot = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    listed = rows.select(key, F.struct(*columns).alias("r"), F.explode(F.sequence(slot(F.col("start")), F.greatest(slot(F.col("start")), slot(F.col("end"))))).alias("slot"))
    a, b = listed.withColumnRenamed("r", "a"), listed.withColumnRenamed("r", "b")
    once = F.col("slot") == F.greatest(slot(F.col("a.start")), slot(F.col("b.start")))
    touch = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return a.join(b, [key, "slot"]).filter((F.col("a.pos") < F.col("b.pos")) & once & touch).drop("slot")


def new_wins(a: Column, b: Column, rules: DedupRules = DedupRules()) -> Column:
    """Whether the later row b replaces the kept row a: louder, then priority, then longer text (chars)."""
    louder = F.when(b["rms_db"] >= a["rms_db"] + rules.louder_db, True).when(a["rms_db"] >= b["rms_db"] + rules.louder_db, False)
    pa, pb = F.coalesce(a["speaker_priority"], F.lit(50)), F.coalesce(b["speaker_priority"], F.lit(50))
    higher = F.when(F.abs(pb - pa) >= rules.priority_gap, pb > pa)
    return F.coalesce(louder, higher, b["chars"] > a["chars"] + rules.longer_chars)


def duplicate_edges(rows: DataFrame, rules: DedupRules = DedupRules(), key: str = "session", bucket: float | None = None) -> DataFrame:
    """(key, kept, later, b_wins) positions of probable duplicates of different sources.

    Cheap tests run in the JVM on times and lengths; only pairs whose lengths could reach the
    ratio fetch their texts and meet the Arrow UDF.
    """
    rows = rows.filter(F.length("text") >= rules.least_chars)
    slim = rows.select(key, "pos", "start", "end", "source_file", "rms_db", "speaker_priority", F.length("text").alias("chars"), F.length(F.trim("text")).alias("bare"))
    pairs = interval_pairs(slim, [c for c in slim.columns if c != key], key, bucket)
    a, b = F.col("a"), F.col("b")
    pairs = pairs.filter(~a["source_file"].eqNullSafe(b["source_file"]) & (overlap_ratio(a["start"], a["end"], b["start"], b["end"]) >= rules.overlap))
    could = 2 * F.least(a["chars"], b["chars"]) / (a["bare"] + b["bare"]) >= rules.similarity
    pairs = pairs.filter(could).select(key, a["pos"].alias("kept"), b["pos"].alias("later"), new_wins(a, b, rules).alias("b_wins"))
    text = lambda name, c: rows.select(key, F.col("pos").alias(name), F.col("text").alias(c))
    both = pairs.join(text("kept", "_a"), [key, "kept"]).join(text("later", "_b"), [key, "later"])
    scored = both.withColumn("ratio", text_similarity(rules.autojunk, rules.similarity)(F.col("_b"), F.col("_a")))
    return scored.filter(F.col("ratio") >= rules.similarity).select(key, "kept", "later", "b_wins")


def resolve(matches: dict[int, dict[int, bool]], order: list[int], look_back: int) -> list[tuple[int, int, int]]:
    """(pos, slot, turn) of every position: the slot it ends in, and when it was absorbed (0: it stays).

    In order, a row is absorbed by the first of the last `look_back` slots whose present row
    it matches; the winner is the slot's row from then on. Otherwise it opens a slot.
    """
    slots: list[int] = []
    slot_of: dict[int, int] = {}
    turn: dict[int, int] = {}
    at_slot: dict[int, int] = {}  # present row -> slot
    for n, pos in enumerate(order, 1):
        turn[pos] = 0
        near = [at_slot[a] for a in matches.get(pos, ()) if a in at_slot]
        near = [s for s in near if s >= len(slots) - look_back]
        if not near:
            slot_of[pos] = at_slot[pos] = len(slots)
            slots.append(pos)
            continue
        s = min(near)
        old = slots[s]
        slot_of[pos] = s
        if matches[pos][old]:
            turn[old] = n
            del at_slot[old]
            slots[s], at_slot[pos] = pos, s
        else:
            turn[pos] = n
    return [(p, slot_of[p], turn[p]) for p in order]


def greedy_slots(rows: DataFrame, edges: DataFrame, key: str = "session", look_back: int = 40) -> DataFrame:
    """(key, pos, slot, turn): the resolver over positions and edges alone, a session at a time.

    Sessions are sorted streams: a task holds the edges of one session's open rows, no texts.
    """
    per_row = edges.groupBy(key, "later").agg(F.collect_list(F.struct("kept", "b_wins")).alias("m")).withColumnRenamed("later", "pos")
    slim = rows.select(key, F.col("pos").cast("long").alias("pos")).join(per_row, [key, "pos"], "left").select(F.col(key).alias("k"), "pos", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the rows of the open session
        for batch in batches:
            kind, done = batch.schema.field("k").type, []
            for row in zip(*[batch.column(c).to_pylist() for c in ("k", "pos", "m")], strict=True):
                if held and held[0][0] != row[0]:
                    done += settle(held)
                    held = []
                held.append(row)
            yield placed(done, kind)
        if held:
            yield placed(settle(held), kind)

    def settle(held: list[tuple]) -> list[tuple]:
        matches = {pos: {x["kept"]: x["b_wins"] for x in m} for _, pos, m in held if m}
        return [(held[0][0], *x) for x in resolve(matches, [pos for _, pos, _ in held], look_back)]

    def placed(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["k", "pos", "slot", "turn"])

    found = slim.repartition("k").sortWithinPartitions("k", "pos").mapInArrow(run, f"k {dict(rows.dtypes)[key]}, pos long, slot long, turn long")
    return found.withColumnRenamed("k", key)


def deduplicate(rows: DataFrame, rules: DedupRules = DedupRules(), key: str = "session", bucket: float | None = None) -> DataFrame:
    """One row for each slot, losers in deduped_from in the order they were absorbed.

    Rows need pos; the result has a new pos by (start, end, speaker). Disabled: every row stays
    in its order, marked original, with an empty list.
    """
    loser = F.struct(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in LOSER])
    rest = [c for c in rows.columns if c not in ("duplicate_status", "deduped_from")]
    marked = rows.select(*rest, F.lit("original").alias("duplicate_status"))
    empty = F.filter(F.array(loser), lambda x: F.lit(False))
    if not rules.enabled:
        return marked.withColumn("deduped_from", empty)
    slots = greedy_slots(rows, duplicate_edges(rows, rules, key, bucket), key, rules.look_back)
    placed = marked.join(slots, [key, "pos"])
    lost = placed.filter("turn > 0").groupBy(key, "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", loser.alias("x")))), lambda y: y["x"]).alias("deduped_from"))
    kept = placed.filter("turn = 0").join(lost, [key, "slot"], "left").withColumn("deduped_from", F.coalesce("deduped_from", empty))
    w = Window.partitionBy(key).orderBy("start", "end", "speaker", "pos")
    return kept.drop("slot", "turn").withColumn("pos", F.row_number().over(w).cast("long"))
