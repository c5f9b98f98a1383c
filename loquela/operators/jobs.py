"""Incremental extraction jobs: what to run, what came back, and how requests are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquela.functions.text import fingerprint16, token_estimate
from loquela.operators.folds import greedy_packs

BUDGET = 700_000


def jobs(prompts: DataFrame) -> DataFrame:
    """(name, prompt, chunk_hash) of chunk prompts."""
    return prompts.select("name", "prompt", fingerprint16(F.col("prompt")).alias("chunk_hash"))


def to_run(all_jobs: DataFrame, results: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Jobs whose result is missing or out of date.

    A result with no ledger entry was made by hand and is never run over; one whose ledger hash
    equals the job's is current. An anti-join on the name, so results and ledger may be large.
    """
    if force:
        return all_jobs
    known = results.select("name").distinct().join(ledger.select("name", F.col("chunk_hash").alias("done_hash")), "name", "left")
    j, k = all_jobs.alias("j"), known.alias("k")
    return j.join(k, (F.col("j.name") == F.col("k.name")) & (F.col("done_hash").isNull() | (F.col("done_hash") == F.col("j.chunk_hash"))), "left_anti")


def with_hashes(answers: DataFrame, fresh: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Answers with the hash of the job they answer: a resumed batch's own hash goes before a fresh one."""
    out = answers.join(fresh.select("name", F.col("chunk_hash").alias("_fresh")), "name", "left")
    if pending is None:
        return out.withColumnRenamed("_fresh", "chunk_hash")
    out = out.join(pending.select("name", F.col("chunk_hash").alias("_pending")), "name", "left")
    return out.withColumn("chunk_hash", F.coalesce("_pending", "_fresh")).drop("_pending", "_fresh")


def leftovers(all_jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """Jobs that no successful answer covers."""
    return all_jobs.join(answers.filter("error IS NULL").select("name"), "name", "left_anti")


def batches(all_jobs: DataFrame, max_output_tokens: int = 8000, budget: int = BUDGET, order: str = "name") -> DataFrame:
    """(order, cost, pack): consecutive jobs packed within a token budget; an oversized job goes alone.

    The fold follows one global order, so its names and costs, not the prompts, pass through one task.
    """
    slim = all_jobs.select(order, token_estimate(F.col("prompt"), max_output_tokens).alias("cost"))
    return greedy_packs(slim, [], [order], "cost", budget)


def upsert(ledger: DataFrame, news: DataFrame) -> DataFrame:
    """The ledger with new rows in place of old ones of the same name."""
    return ledger.join(news.select("name"), "name", "left_anti").unionByName(news, allowMissingColumns=True)
