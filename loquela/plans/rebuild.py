"""The cleaning path: filter, repair, resolve duplicates, repair, merge, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loquela.operators import chunks, dedup, merge, quality, timing


def rules_of(cfg: dict) -> tuple[quality.QualityRules, timing.TimingRules, dedup.DedupRules, dict]:
    """Operator rules from a session's configuration."""
    f, d, p = (cfg.get(k) or {} for k in ("hallucination_filter", "dedupe", "postprocess"))
    pick = lambda block, **names: {ours: block[theirs] for ours, theirs in names.items() if block.get(theirs) is not None}
    q = pick(
        f, enabled="enabled", drop_blacklisted="drop_blacklisted_phrases", drop_repeated="drop_repeated_words", drop_compressed="drop_high_compression", drop_quiet="drop_low_rms",
        high_compression="max_compression_ratio", very_high_compression="very_high_compression_ratio", short_chars="short_reaction_max_chars", quiet_db="low_rms_db",
        quiet_keep_chars="min_chars_for_low_rms_keep", keep_short="keep_short_reactions",
    )
    q |= {k: tuple(f[n]) for k, n in (("phrases", "blacklist"), ("whole_texts", "blacklist_exact")) if f.get(n) is not None}
    t = pick(
        p, enabled="repair_timings", shortest="timing_min_duration_sec", padding="timing_padding_sec", chars_per_second="timing_chars_per_sec", short_chars="timing_short_text_chars",
        short_cap="timing_short_max_duration_sec", medium_chars="timing_medium_text_chars", medium_cap="timing_medium_max_duration_sec", long_cap="timing_long_max_duration_sec",
    )
    u = pick(d, enabled="enabled", similarity="similarity_threshold", overlap="min_overlap_ratio", least_chars="min_text_len", look_back="search_back", louder_db="prefer_louder_by_db")
    m = pick(p, enabled="merge_adjacent_same_speaker", max_gap="merge_max_gap_sec", max_chars="merge_max_chars")
    return quality.QualityRules(**q), timing.TimingRules(**t), dedup.DedupRules(**u), m


def clean(raw: DataFrame, cfg: dict | None = None, key: str = "session", held: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected rows) of raw rows that carry pos.

    Repaired segments are no longer than the longest text's cap, which makes the interval
    join's bucket; without repair the bucket is measured. The rows that several later steps
    read are persisted (memory, then disk), so no step computes an earlier one again; they are
    appended to `held`, for the caller to release when the results are written.
    """
    q, t, d, m = rules_of(cfg or {})
    held = [] if held is None else held
    judged = quality.judge(raw, q).persist()
    kept, rejected = quality.sides(judged)
    repaired = timing.repair(kept, t, (key,)).persist()
    rows = dedup.deduplicate(repaired, d, key, bucket=max(20.0, t.long_cap) if t.enabled else None)
    rows = timing.repair(rows, t, (key,)).persist()
    held += [judged, repaired, rows]
    rows = merge.merge_adjacent(rows, key=key, **m)
    return timing.repair(rows, t, (key,)), rejected


def chunked(rows: DataFrame, cfg: dict | None = None, party: str = "", key: str = "session") -> tuple[DataFrame, DataFrame]:
    """(chunks, prompts) of clean rows."""
    made = chunks.make_chunks(rows, (cfg or {}).get("chunk_minutes", 10), key)
    return made, chunks.chunk_prompts(made, party, key)
