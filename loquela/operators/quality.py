"""Garbage filters with multi-label reasons, suspicious rows, and quality summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquela.functions.text import filter_form, let, truthy_or, words_of

# Phrases that speech recognition makes up, anywhere in a text and as a whole text.
PHRASES = (
    "Продолжение следует", "Субтитры создавал", "Субтитры сделал", "Субтитры делал", "Добавил субтитры", "Редактор субтитров",
    "Корректор субтитров", "DimaTorzok", "Питер Каватый", "Спасибо за просмотр", "Подписывайтесь на канал",
)
WHOLE_TEXTS = ("Спасибо.", "Спасибо", "Спасибо!", "Всем спасибо", "Всем спасибо.", "Пока.", "Пока!", "До встречи.", "До новых встреч.")


#: First letters by which phrases and texts meet where the phrase table is large.
GRAM = 8


@dataclass(frozen=True)
class QualityRules:
    """Which filters run, and their thresholds. An empty phrase list switches its filter off."""

    enabled: bool = True
    drop_blacklisted: bool = True
    drop_repeated: bool = True
    drop_compressed: bool = True
    drop_quiet: bool = True
    phrases: tuple[str, ...] = PHRASES
    whole_texts: tuple[str, ...] = WHOLE_TEXTS
    top_share: float = 0.70
    least_words: int = 4
    high_compression: float = 4.0
    very_high_compression: float = 8.0
    short_chars: int = 8
    quiet_db: float = -78.0
    quiet_keep_chars: int = 18
    keep_short: bool = True


def word_shares(words: Column) -> Column:
    """A struct of n (words), distinct words, and most (the most frequent one's count), in the row:
    one pass over the sorted words."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(0).alias("distinct"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when((acc["run"] > 0) & (acc["w"] == x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("w"), run.alias("run"), (acc["n"] + 1).alias("n"), (acc["distinct"] + F.when(run == 1, 1).otherwise(0)).alias("distinct"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(F.array_sort(words), start, step)


def is_repeated(n: Column, distinct: Column, most: Column, rules: QualityRules = QualityRules()) -> Column:
    """One word makes up most of the text, or two words at most make up six or more."""
    return (n >= rules.least_words) & ((most / n >= rules.top_share) | ((distinct <= 2) & (n >= 6)))


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, distinct_words, most) of long texts: words are exploded and counted map-side.

    Keys identify rows; rows without a word are left out.
    """
    words = df.select(key, F.explode(words_of(filter_form(F.col(text)))).alias("w"))
    return words.groupBy(key, "w").count().groupBy(key).agg(F.sum("count").alias("n"), F.count("*").alias("distinct_words"), F.max("count").alias("most"))


def has_phrase(norm: Column, phrases: tuple[str, ...]) -> Column:
    """Some phrase, in its filter form, is within the text's."""
    if not phrases:
        return F.lit(False)
    return F.exists(F.array(*[filter_form(F.lit(p)) for p in phrases]), lambda p: F.contains(norm, p))


def is_whole_text(norm: Column, phrases: tuple[str, ...]) -> Column:
    if not phrases:
        return F.lit(False)
    return F.array_contains(F.array(*[filter_form(F.lit(p)) for p in phrases]), norm)


def phrase_hits(df: DataFrame, text: str, phrases: DataFrame, phrase: str, most_chars: int = 1 << 22) -> DataFrame:
    """Rows whose text holds a phrase of a table: a semi-join on containment.

    Containment has no hash key. A table of up to `most_chars` characters is broadcast; a larger
    one meets the texts by the first letters of its phrases, which every text lists, and what
    meets is tested for containment.
    """
    p = phrases.select(filter_form(F.col(phrase)).alias("_p")).filter("_p <> ''").distinct()
    rows = df.withColumn("_t", filter_form(F.col(text)))
    if (p.agg(F.sum(F.length("_p"))).first()[0] or 0) <= most_chars:
        return rows.join(F.broadcast(p), F.contains("_t", "_p"), "left_semi").drop("_t")
    size = F.least(F.length("_p"), F.lit(GRAM))
    sizes = [r[0] for r in p.select(size.alias("n")).distinct().collect()]  # GRAM rows at most
    grams = lambda t: F.array_distinct(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i, n=n: F.substring(t, i, F.lit(n))) for n in sizes])))
    texts = rows.select("_t").distinct().select("_t", F.explode(grams(F.col("_t"))).alias("_g"))
    hits = texts.join(p.select("_p", F.substring(F.col("_p"), F.lit(1), size).alias("_g")), "_g").filter(F.contains("_t", "_p")).select("_t").distinct()
    return rows.join(hits, "_t", "left_semi").drop("_t")


def whole_text_hits(df: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """Rows whose whole text is a phrase of a table: a hash semi-join."""
    p = phrases.select(filter_form(F.col(phrase)).alias("_p")).distinct()
    return df.withColumn("_t", filter_form(F.col(text))).join(p, F.col("_t") == F.col("_p"), "left_semi").drop("_t")


def reasons(rules: QualityRules = QualityRules(), text: str = "text", compression: str = "compression_ratio", rms: str = "rms_db") -> Column:
    """Why a row is garbage: an array of labels in a fixed order, empty for a good row."""
    if not rules.enabled:
        return F.array().cast("array<string>")
    ratio, db = F.col(compression), F.col(rms)
    label = lambda on, cond, name: F.when(F.lit(on) & F.coalesce(cond, F.lit(False)), F.lit(name))

    def judged(norm: Column) -> Column:
        size = F.length(norm)
        repeated = let(word_shares(words_of(norm)), lambda s: is_repeated(s["n"], s["distinct"], s["most"], rules))
        return F.array(
            label(rules.drop_blacklisted, has_phrase(norm, rules.phrases) | is_whole_text(norm, rules.whole_texts), "blacklist"),
            label(rules.drop_repeated, repeated, "repeated_words"),
            label(rules.drop_compressed, ratio >= rules.very_high_compression, "very_high_compression"),
            label(rules.drop_compressed, (ratio < rules.very_high_compression) & (ratio >= rules.high_compression) & (size > rules.short_chars), "high_compression"),
            label(rules.drop_quiet, (db <= rules.quiet_db) & ((size >= rules.quiet_keep_chars) | F.lit(not rules.keep_short)), "low_rms"),
        )

    return F.array_compact(let(filter_form(F.col(text)), judged))


def judge(rows: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """All rows with their reject_reasons."""
    return rows.withColumn("reject_reasons", reasons(rules))


def sides(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows with reject_reasons) of judged rows.

    A caller that reads both sides persists the judged rows, or each side judges anew.
    """
    empty = F.size("reject_reasons") == 0
    return judged.filter(empty).drop("reject_reasons"), judged.filter(~empty)


def split(rows: DataFrame, rules: QualityRules = QualityRules()) -> tuple[DataFrame, DataFrame]:
    """sides() of judge()."""
    return sides(judge(rows, rules))


def suspicious() -> Column:
    """Recognition metrics past fixed thresholds; missing metrics say nothing."""
    return F.coalesce(F.col("avg_logprob") < -1.2, F.lit(False)) | F.coalesce(F.col("no_speech_prob") > 0.65, F.lit(False)) | F.coalesce(F.col("compression_ratio") > 2.6, F.lit(False))


def first_suspicious(rows: DataFrame, n: int = 30) -> DataFrame:
    """The first n suspicious rows in row order (a top-k, no full sort)."""
    return rows.filter(suspicious()).orderBy("pos").limit(n)


def speaker_counts(rows: DataFrame) -> DataFrame:
    """Rows of each character (else speaker, else ?), by name in code-point order."""
    return rows.groupBy(truthy_or("?", "character", "speaker").alias("name")).agg(F.count("*").alias("n")).orderBy("name")


def quality_summary(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: raw and clean counts, their difference, absorbed duplicates, suspicious rows."""
    a = raw.agg(F.count("*").alias("raw_rows"))
    b = clean.agg(
        F.count("*").alias("clean_rows"),
        F.coalesce(F.sum(F.size(F.coalesce("deduped_from", F.array().cast(clean.schema["deduped_from"].dataType)))), F.lit(0)).cast("long").alias("absorbed"),
        F.count_if(suspicious()).alias("suspicious"),
    )
    both = a.join(b)  # one row each
    return both.select("raw_rows", "clean_rows", F.greatest(F.lit(0), F.col("raw_rows") - F.col("clean_rows")).alias("removed_total"), "absorbed", "suspicious")
