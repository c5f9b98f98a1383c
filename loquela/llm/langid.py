"""Language identification by Bayesian evidence fusion.

Four pieces of evidence: letter-trigram likelihoods of the whole text, the language that the
markup declares, the suffix of the address, and the host. The likelihoods are fitted on a
bounded sample of rows that declare a language. The other evidence is counted over all rows, by
grouped aggregation of what the text alone says: how often a language's texts declare each
language, and a prior for each host that is smoothed towards its suffix's, which is smoothed
towards the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquela.llm._shared import in_slices, task, written

#: Rows of each declared language that the likelihoods are fitted on (in expectation), and
#: languages whose table a task holds at once; more take more passes.
SAMPLE, LANGUAGES = 500, 64
#: Neighbouring trigrams share letters, so they count as a third of independent evidence.
TEMPER = 1 / 3
#: Weight of the parent's prior, in rows; smoothing of trigram and declaration counts.
PARENT, ADD, ADD_DECLARED = 20.0, 0.5, 1.0
#: Posterior that a document needs to be kept.
CONFIDENT = 0.5
#: A host or suffix with more than one of so many rows is joined by broadcast: fewer than that exist.
FREQUENT = 256

CELLS = 1 << 18
_FOLD = np.zeros(256, np.uint32)  # a-z are 1 to 26, other scripts' bytes 27 to 58, the rest 0
_FOLD[np.arange(ord("a"), ord("z") + 1)] = _FOLD[np.arange(ord("A"), ord("Z") + 1)] = np.arange(1, 27)
_FOLD[128:] = 27 + np.arange(128) % 32


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, owner's first cell) of the letter trigrams of some texts, words apart.

    Every text is padded by a gap on both sides; trigrams with a gap in the middle are left out.
    """
    raw = [b" " + (t or "").encode("utf-8", "surrogatepass") + b"  " for t in texts]
    sizes = np.array([len(r) - 2 for r in raw], np.int64)
    x = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    cells = x[:-2] << 12 | x[1:-1] << 6 | x[2:]
    ends = np.cumsum(sizes + 2)
    keep = x[1:-1] > 0
    keep[ends[:-1] - 2] = keep[ends[:-1] - 1] = False  # what spans two texts
    owner_counts = np.add.reduceat(np.concatenate([keep, [False, False]]).astype(np.int64), np.concatenate([[0], ends[:-1]]))
    return cells[keep], owner_counts


def primary(tag: Column) -> Column:
    """The primary subtag of a declared language, in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*|\s*)$", 1)), F.lit(""))


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[np.ndarray]]:
    """(languages, log-likelihood tables [CELLS, LANGUAGES at most]) from (doc_id, text, declared) rows.

    Every declared language is one. Only the sampled rows' texts are read; what reaches the
    driver are trigram counts, whose number is bounded by the cells and the languages (two or
    three letters each).
    """
    found = rows.filter("declared IS NOT NULL").groupBy("declared").count().orderBy("declared").collect()
    langs = [r["declared"] for r in found]
    if not langs:
        return [], []
    spark = rows.sparkSession
    chances = spark.createDataFrame([(r["declared"], i, min(1.0, sample / r["count"]) * (1 << 30)) for i, r in enumerate(found)], "declared string, lang int, chance double")
    drawn = rows.select("doc_id", "declared", "text").join(F.broadcast(chances), "declared").filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.col("chance"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            by: dict[int, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                cell, n = np.unique(trigrams(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), lang, np.int32)), pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "cell", "n"])

    summed = drawn.select("lang", "text").mapInArrow(task(count), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    if len(langs) > LANGUAGES:
        summed = written(summed)
    seen = np.zeros(CELLS, bool)  # cells never met say nothing for or against
    seen[summed.select("cell").distinct().toArrow().column(0).to_numpy()] = True
    tables = []
    for first in range(0, len(langs), LANGUAGES):
        table = np.full((CELLS, min(LANGUAGES, len(langs) - first)), ADD)
        for r in summed.filter((F.col("lang") >= first) & (F.col("lang") < first + LANGUAGES)).toArrow().to_batches():
            table[r.column("cell").to_numpy(), r.column("lang").to_numpy() - first] += r.column("n").to_numpy()
        logs = np.log(table / table[seen].sum(axis=0)) if seen.any() else np.zeros_like(table)
        logs[~seen] = 0
        tables.append(logs.astype(np.float32))
    return langs, tables


def score(rows: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """The rows without text, with ll (tempered log-likelihoods), n_grams and best (index or null).

    Tables beyond the first are passes of their own, so that a task holds one of them.
    """
    keep = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{n} {k}" for n, k in rows.dtypes if n != "text")

    def run(shared, last: bool):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in in_slices(batches, "text"):
                if not batch.num_rows:
                    continue
                cells, sizes = trigrams(batch.column("text").to_pylist())
                out = np.zeros((len(sizes), table.shape[1]))
                ends = np.cumsum(sizes)
                for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
                    if b > a:
                        out[i] = table[cells[a:b]].sum(axis=0, dtype=np.float64)
                out *= TEMPER
                before = batch.column("ll").flatten().to_numpy().reshape(len(sizes), -1) if "ll" in batch.schema.names else np.zeros((len(sizes), 0))
                out = np.concatenate([before, out], axis=1)
                ll = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64())) if out.shape[1] else pa.array([[]] * len(sizes), pa.list_(pa.float64()))
                if not last:
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("text"), ll], [*keep, "text", "ll"])
                    continue
                best = pa.array(out.argmax(axis=1) if out.shape[1] else np.zeros(len(sizes)), pa.int32(), mask=(sizes == 0) | (out.shape[1] == 0))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ll, pa.array(sizes), best], [*keep, "ll", "n_grams", "best"])

        return task(part)

    tables = tables or [np.zeros((CELLS, 0), np.float32)]
    for table in tables[:-1]:
        shared = rows.sparkSession.sparkContext.broadcast(table)  # CELLS x LANGUAGES floats at most
        rows = written(rows.mapInArrow(run(shared, False), f"{kinds}, text string, ll array<double>"))
    shared = rows.sparkSession.sparkContext.broadcast(tables[-1])
    return rows.mapInArrow(run(shared, True), f"{kinds}, ll array<double>, n_grams long, best int")


def _tally(scored: DataFrame, *keys: str, name: str) -> DataFrame:
    """For each key, how many rows there are and how many of them the text alone gives each language."""
    each = scored.groupBy(*keys, "best").agg(F.count("*").alias("c"))
    counts = F.map_from_entries(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", F.col("c").cast("double")))))
    return each.groupBy(*keys).agg(F.sum("c").alias("_rows"), counts.alias(name))


def _with_counts(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows with their key's counts: those of frequent keys by broadcast, so that no task gets a whole one."""
    frequent = written(table.filter(F.col("_rows") * FREQUENT > total))  # fewer than FREQUENT rows
    names = [r[0] for r in frequent.select(key).collect()]
    rest = table.join(F.broadcast(frequent.select(key)), key, "left_anti").drop("_rows")
    often = F.coalesce(F.col(key).isin(names), F.lit(False)) if names else F.lit(False)
    return rows.filter(often).join(F.broadcast(frequent.drop("_rows")), key).unionByName(rows.filter(~often).join(rest, key, "left"))


def identify(docs: DataFrame, doc_id: Column, text: Column, declared: Column, host: Column, suffix: Column, confident: float = CONFIDENT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_hash, language, confidence, declared, kept) of every row of `docs`.

    A row is rejected (kept false) where no language reaches the posterior `confident`, or
    where its text has no letter at all: then language is null and confidence 0. Null texts
    count as empty; a null declaration, suffix or host is no evidence. If no row declares a
    language, every row is rejected. Counts combine map-side; rows of a very frequent host or
    suffix meet its counts where they are.
    """
    rows = docs.select(
        doc_id.cast("long").alias("doc_id"),
        text.cast("string").alias("text"),
        F.xxhash64(text.cast("string")).alias("text_hash"),
        primary(declared.cast("string")).alias("declared"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(suffix.cast("string"), F.lit("")).alias("suffix"),
    )
    langs, tables = fit(rows, sample)
    n = len(langs)
    scored = written(score(rows, tables))
    if n == 0:
        return scored.select("doc_id", "text_hash", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), "declared", F.lit(False).alias("kept"))
    at = {lang: i for i, lang in enumerate(langs)}
    total, declares = np.zeros(n), np.full((n, n), ADD_DECLARED / n)  # [declared, language]
    for r in scored.filter("best IS NOT NULL").groupBy("declared", "best").count().collect():
        total[r["best"]] += r["count"]
        if r["declared"] in at:
            declares[at[r["declared"]], r["best"]] += r["count"]
    declares = np.log(declares / declares.sum(axis=0))
    corpus = (total + 1) / (total + 1).sum()
    n_rows = scored.count()
    by_suffix = _tally(scored.filter("suffix <> ''"), "suffix", name="of_suffix")
    by_host = _tally(scored.filter("host <> ''"), "host", name="of_host")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            ll, of_host, of_suffix = batch.column("ll").flatten().to_numpy().reshape(m, n), np.zeros((m, n)), np.zeros((m, n))
            for out, name in ((of_host, "of_host"), (of_suffix, "of_suffix")):
                for row, pairs in zip(out, batch.column(name).to_pylist(), strict=True):
                    for i, c in pairs or ():
                        row[i] = c
            best = batch.column("best").to_pylist()
            for i, b in enumerate(best):  # a row is no evidence for itself
                if b is not None:
                    of_host[i, b] = max(0, of_host[i, b] - 1)
                    of_suffix[i, b] = max(0, of_suffix[i, b] - 1)
            p = (of_suffix + PARENT * corpus) / (of_suffix.sum(axis=1, keepdims=True) + PARENT)
            p = (of_host + PARENT * p) / (of_host.sum(axis=1, keepdims=True) + PARENT)
            post = ll + np.log(p)
            for i, d in enumerate(batch.column("declared").to_pylist()):
                if d in at:
                    post[i] += declares[at[d]]
            post = np.exp(post - post.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            top, letters = post.argmax(axis=1), np.array([b is not None for b in best], bool)
            sure = np.where(letters, post.max(axis=1), 0.0)
            language = pa.array([langs[t] if ok else None for t, ok in zip(top, letters, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), language, pa.array(sure), batch.column("declared"), pa.array(letters & (sure >= confident))], ["doc_id", "text_hash", "language", "confidence", "declared", "kept"])

    joined = _with_counts(_with_counts(scored, by_host, "host", n_rows), by_suffix, "suffix", n_rows)
    return joined.select("doc_id", "text_hash", "declared", "ll", "best", "of_host", "of_suffix").mapInArrow(task(fuse), "doc_id long, text_hash long, language string, confidence double, declared string, kept boolean")


def identify_documents(docs: DataFrame) -> DataFrame:
    """identify() for (doc_id, text, lang, source): lang is the declaration, source the host."""
    return identify(docs, F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), F.lit(None))


def identify_pages(pages: DataFrame) -> DataFrame:
    """identify() for (page_id, url, html): the html element's lang, the URL's host and its last label.

    The text is the html without its tags; page_id comes out as doc_id.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    lang = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", " ")
    return identify(pages, F.col("page_id"), text, lang, host, F.regexp_extract(host, r"([^.]+)$", 1))


def keep_identified(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of `docs` that some decision on the same id and text keeps, columns unchanged."""
    yes = decisions.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
    match = docs["doc_id"].cast("long").eqNullSafe(yes["_id"]) & (F.xxhash64(docs["text"].cast("string")) == yes["_th"])
    return docs.join(yes, match, "left_semi")
