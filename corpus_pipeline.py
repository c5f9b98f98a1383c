"""From raw documents to packed training sequences: five stages over whole tables.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and is
the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loquela.llm import decontam, langid, packing, pii, simhash
from loquela.llm._shared import drop_folder, settled, shared_dir, written
from loquela.llm.queries import PII_KEY, _vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or with no likely language go."""
    return langid.keep_identified(docs, written(langid.identify_documents(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: op1's fingerprint links at up to three differing
    bits, by its index, and those of texts whose sets of five words are similar (0.8 or more)."""

    def classes() -> DataFrame:
        by_bits = settled(spark, lambda: simhash.fingerprint_classes(docs), shared_dir(spark))
        return simhash.similar_documents(docs, known=by_bits)

    return simhash.keep_one(docs, settled(spark, classes, shared_dir(spark)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced in their format; lengths don't change."""
    return pii.pseudonyms(docs, PII_KEY).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence of at most 2048 tokens."""
    items = written(packing.pieces(docs, _vocabulary("byte_bpe_50k.json")))
    return packing.pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("packing", pack_sequences),
]

#: No stage is plain SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's own tables and its input go when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        folder = shared_dir(spark)
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), folder)
        if before:
            drop_folder(spark, before)
        before = folder
    return docs
