"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return documents with the columns
they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import _io, line_runs, mixing, packing, quality_lm, superminhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside their language's perplexity band go."""
    return quality_lm.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller doc_id holds go from the text."""
    return line_runs.keep_first_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays."""
    return superminhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's weight asks for."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its sequence and place there."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Kneser-Ney models, SuperMinHash and column generation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each other stage returns is written as Parquet to the shared folder and read again."""
    docs = _io.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = _io.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
