"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import _io, curve_packing, line_runs, mixing, packing, passages, pii_votes, posting_ann, ppm_lang, quality_lm, spelling, superminhash, toolcalls, vector_codes


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds prose only: calls and results are derived from its turns, all of which stay (see with_calls)."""
    return toolcalls.linked(toolcalls.with_calls(_io.table(spark, sf_dir, "conversations")))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_io.table(spark, sf_dir, "documents"))


def op3_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_ann.neighbours(_io.table(spark, sf_dir, "embeddings"))


def op4_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.judged(_io.table(spark, sf_dir, "documents"))


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.grouped(_io.table(spark, sf_dir, "documents"))


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_lang.predicted(_io.table(spark, sf_dir, "documents"))


def op6_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_io.table(spark, sf_dir, "documents"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(_io.table(spark, sf_dir, "documents"))


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_votes.spans(_io.table(spark, sf_dir, "documents"))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed(_io.table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_io.table(spark, sf_dir, "documents"))


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.packed(_io.table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_io.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_call_linking": op1_tool_call_linking,
    "op2_compact_windows": op2_compact_windows,
    "op3_balanced_postings": op3_balanced_postings,
    "op4_ngram_perplexity": op4_ngram_perplexity,
    "op5_ppm_language": op5_ppm_language,
    "op6_linear_grouping": op6_linear_grouping,
    "op7_line_runs": op7_line_runs,
    "op8_superminhash": op8_superminhash,
    "op9_weak_supervision_pii": op9_weak_supervision_pii,
    "op10_temperature_mix": op10_temperature_mix,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_curve_packing": op12_curve_packing,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_runs": line_runs.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
