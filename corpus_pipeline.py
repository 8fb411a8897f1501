"""The corpus pipeline: five stages over documents, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoset.llm import decontam, line_dedup, ngram_join, sentence_piece, toxicity
from chronoset.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the lines that ten documents or more hold, one document keeps each, so that the next stage finds one whole text where many were
    copies; every document stays, with n_chars of its new text."""
    cleaned = line_dedup.dedup_lines(docs, keep_one=True)
    return cleaned.withColumn("text", F.col("_kept")).withColumn("n_chars", F.length("_kept").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id; documents without words all stay."""
    return ngram_join.drop_near_copies(docs).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left with its piece ids, their number, and whether decoding gives the text again."""
    found = sentence_piece.tokenize(docs.select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "lang", "source", F.col("_ids").alias("ids"), F.col("_n_tokens").alias("n_tokens"), F.col("_ids_sha256").alias("ids_sha256"), F.col("_round_trip").alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: Toxicity and the join are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
