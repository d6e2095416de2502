"""A training corpus in five stages, each an operator of :mod:`textpipe.llm`.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpipe.llm import bpe, decontaminate, langid, simhash, substring
from textpipe.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    known = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, known, keep=COLUMNS).where("NOT rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, the one with the smallest id (null ids come last).

    A row is told by its id and its text's hash: other texts under the same or a null id are other documents.
    """
    keys = ["no_id", "id", "hash"]
    docs = docs.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "hash": F.xxhash64("text")})
    found = simhash.near_duplicates(docs.select(F.struct("no_id", "doc_id", "hash", "id").alias("key"), "text"), id_col="key")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*[F.col(f"doc_id.{k}").alias(k) for k in keys]).distinct()
    return docs.join(kept, keys, "left_semi").dropDuplicates(keys).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of which nothing is left goes."""
    found = written(substring.duplicates(docs).where("removed"), "removed")
    cut = substring.cut(docs.select(*COLUMNS), found)
    return cut.where("text IS NOT NULL AND trim(text) <> ''").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digests of the ids and of the decoded text."""
    return bpe.digests(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark", benchmark), ("tokens", tokens)]

#: The language models, the trie join and the tokeniser have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
