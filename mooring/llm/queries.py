"""Queries of the training-data problems over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooring.llm import language, packing, pairs, quantiles, repetition, residue, tokens, truncation
from mooring.session import cut, table

_FIELDS = ["aprob", "entropy_anchoring"]


# 1: percentiles of very large columns


def p1_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The stored, mergeable result: one sketch for each method, run_day and field, counting every stored row."""
    return quantiles.sketches(table(spark, d, "metric_records"), ["method", "run_day"], _FIELDS).drop("part")


def _scopes(days: DataFrame) -> DataFrame:
    whole = quantiles.percentiles(quantiles.merge_sketches(days, ["method"]), ["method"])
    by_day = quantiles.percentiles(days, ["method", "run_day"])
    return whole.withColumns({"scope": F.lit("whole"), "run_day": F.lit(None).cast("date")}).unionByName(by_day.withColumn("scope", F.lit("run_day")))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and other percentiles of both fields for each method over all stored rows (scope ``whole``).

    They are merged from the sketches of the days, whose own percentiles come out
    too (scope ``run_day``). The sketches are kept, so rows are read once.
    """
    m = table(spark, d, "metric_records")
    return _scopes(cut(quantiles.sketches(m, ["method", "run_day"], _FIELDS)))


def p1_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles for each method and run_day."""
    m = table(spark, d, "metric_records")
    return quantiles.percentiles(quantiles.sketches(m, ["method", "run_day"], _FIELDS), ["method", "run_day"])


def p1_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Are the percentiles of the whole within the stated rank error of the exact ranks?"""
    m = table(spark, d, "metric_records")
    return quantiles.rank_check(m, cut(quantiles.percentiles(quantiles.sketches(m, ["method"], _FIELDS), ["method"])), ["method"])


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """Results of single days, runs and ranks, each merged to the whole, against exact ranks."""
    m = table(spark, d, "metric_records")
    out = None
    for by in ("run_day", "run_id", "rank_no"):
        merged = quantiles.merge_sketches(quantiles.sketches(m, ["method", by], _FIELDS), ["method"])
        one = quantiles.rank_check(m, cut(quantiles.percentiles(merged, ["method"])), ["method"]).withColumn("merged_from", F.lit(by))
        out = one if out is None else out.unionByName(one)
    return out


# 2: truncated texts


def _texts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "raw_output": table(spark, d, "raw_generations").select(F.col("seq").alias("rec_id"), "source", F.col("raw_output").alias("text")),
        "reasoning_trace": table(spark, d, "conv_traces").select(F.col("row_idx").alias("rec_id"), "source", F.col("reasoning_trace").alias("text")),
    }


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Truncation score of every text."""
    return truncation.truncated(_texts(spark, d))


def _cut_off(spark: SparkSession, d: str) -> DataFrame:
    """Scored texts; cases of p3_found are not cut off."""
    other = p3_found(spark, d).select(F.lit("raw_output").alias("field"), F.col("seq").alias("rec_id"), F.lit(True).alias("_other"))
    scored = truncation.truncated(_texts(spark, d)).join(other, ["field", "rec_id"], "left")
    return scored.withColumn("truncated", F.col("truncated") & F.col("_other").isNull()).drop("_other")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that were cut off and are no cases of p3_found."""
    return _cut_off(spark, d).where("truncated").select("field", "rec_id")


def p2_source_shares(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates, counting just what p2_found gives."""
    return truncation.shares(_cut_off(spark, d))


# 3: template residue


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Records to exclude, with the kinds of evidence."""
    return residue.residue(table(spark, d, "raw_generations"), "seq", "raw_output", "source")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records to exclude."""
    return p3_kinds(spark, d).select("seq")


# 4: repetition


def _reasonings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metric_rows").select(F.col("sample_idx").alias("rec_id"), F.explode("reasonings").alias("method", "text"))


def _repeatable(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    raw = table(spark, d, "raw_generations").select(F.col("seq").alias("rec_id"), F.coalesce("method", F.lit("R0")).alias("method"), F.col("raw_output").alias("text"))
    return {"raw_output": raw, "reasonings": _reasonings(spark, d)}


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Repeated share of every text, counted."""
    return repetition.shares(_repeatable(spark, d)).withColumn("share", F.round("share", 9))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a repeated share of at least 0.33, told by the trees and verified where these may err."""
    return repetition.found(repetition.repeated(_repeatable(spark, d)))


# 5: broken pairs


def _language_model(spark: SparkSession, d: str):
    return language.train_model(table(spark, d, "documents"), table(spark, d, "lang_codes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers and reasonings with their defect."""
    return pairs.defects(table(spark, d, "metric_rows"), _language_model(spark, d))


# 6: token ids


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Do the ids decode to the very bytes of the text?"""
    return tokens.round_trip(table(spark, d, "documents"))


# 7: containers


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of each document (or piece of one) for every spec."""
    return packing.pack_corpus(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every document placed, whole, within the capacity, and the containers filled? For every spec."""
    return packing.invariants(cut(p7_containers(spark, d)), table(spark, d, "pack_specs"))


# 8: languages


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the documents whose label is missing or wrong or that mix languages."""
    docs, codes = table(spark, d, "documents"), table(spark, d, "lang_codes")
    return language.found(language.languages(docs, _language_model(spark, d), codes))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document with a sentence."""
    docs, codes = table(spark, d, "documents"), table(spark, d, "lang_codes")
    return language.languages(docs, _language_model(spark, d), codes)


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of documents, each with its language and confidence."""
    return language.segments(table(spark, d, "documents"), _language_model(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_percentiles, p1_sketches, p1_by_day, p1_rank_check, p1_merged, p2_found, p2_scores, p2_source_shares, p3_found, p3_kinds, p4_found, p4_shares, p5_found, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_found, p8_languages, p8_segments)
    return {f.__name__: f for f in own}
