"""Queries of the core operators over the tables of a folder.

Every query reads whole tables. ``metric_records`` stands for scored records,
``metric_rows`` for metric-format input, ``conv_traces`` for conversation rows
and ``raw_generations`` for raw outputs (their row_idx counts metric rows from 0,
whose sample_idx counts from FIRST_SAMPLE). Computed doubles are rounded to six
places, since sums come in another order elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mooring.functions import metrics as M
from mooring.functions import text as X
from mooring.operators import generation as G
from mooring.operators import prepare, scoring, summary
from mooring.schemas import CONTROL_METHODS, MAIN_METHODS, SECTIONS
from mooring.session import cut, shared_folder, spread, table
from mooring.sources import files, jsonl

FIRST_SAMPLE = 1000
BASE = "SSR"


def _round(c: Column | str) -> Column:
    return F.round(c, 6)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metric_rows").select("sample_idx", "id", *SECTIONS)


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).withColumn("row_idx", (F.col("sample_idx") - FIRST_SAMPLE).cast("int"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_generations").select("seq", "row_idx", "id", "method", "raw_output")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metric_records").select("run_id", "rank_no", "method", "sample_idx", "lexical_anchoring", "entropy_anchoring", "aprob", "scored_at", "run_day")


def _flat(df: DataFrame, *maps: str) -> DataFrame:
    """Maps as sorted arrays of ``key=value``, which compare everywhere."""
    return df.withColumns({m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<null>"))))) for m in maps})


# preparation


def conversation_qa(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conv_traces")
    return t.select("row_idx", X.question_answer(F.col("conversations")).alias("x")).select("row_idx", "x.question", "x.answer")


def conversation_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conv_traces").select("row_idx", X.format_conversation(F.col("conversations")).alias("transcript"))


def convert_rows(spark: SparkSession, d: str) -> DataFrame:
    out = prepare.convert(table(spark, d, "conv_traces"), BASE)
    return out.select("row_idx", "id", *[F.element_at(s, BASE).alias(s[:-1]) for s in SECTIONS])


def long_rows(spark: SparkSession, d: str) -> DataFrame:
    return prepare.to_long(_rows(spark, d))


def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("sample_idx", prepare.first_failure(MAIN_METHODS).alias("reason")).withColumn("ok", F.col("reason").isNull())


def validated(spark: SparkSession, d: str) -> DataFrame:
    return prepare.validate(_rows(spark, d), [BASE]).select("sample_idx", "id", F.size("questions").alias("methods"))


def validate_summary(spark: SparkSession, d: str) -> DataFrame:
    return prepare.validation_counts(_rows(spark, d), MAIN_METHODS)


def function_word_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.function_word_skeleton(F.col("text")).alias("skeleton"))


def controlled_variants(spark: SparkSession, d: str) -> DataFrame:
    return prepare.controlled(_rows(spark, d), BASE)


def controlled_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = prepare.to_wide(prepare.controlled(_rows(spark, d), BASE))
    return _flat(wide, "answers", "reasonings").select("sample_idx", "id", "answers", "reasonings")


# traces


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conv_traces").select("row_idx", F.col("reasoning_trace").alias("reasoning"))


def split_steps(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).select("row_idx", F.posexplode(X.steps(F.col("reasoning"))).alias("step", "text"))


def sampled_steps(spark: SparkSession, d: str) -> DataFrame:
    t = _traces(spark, d).select("row_idx", M.step_ends(F.transform(X.steps(F.col("reasoning")), lambda s: F.size(X.words(s)))).alias("ends"), F.size(X.steps(F.col("reasoning"))).alias("n"))
    return t.select("row_idx", "ends", F.explode(M.sampled_steps(F.col("n"))).alias("step")).select("row_idx", "step", M.prefix_end(F.col("ends"), F.col("step")).alias("prefix_tokens"))


def step_boundaries(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.transform(X.steps(F.col("reasoning")), lambda s: F.size(X.words(s)))
    return _traces(spark, d).select("row_idx", M.step_ends(sizes, separator=1).alias("ends"))


def parse_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("seq", X.parse_reasoning(F.col("raw_output")).alias("p")).select("seq", "p.reason", "p.skeleton", "p.mode")


def parse_mode_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.parse_counts(G.rcot_parts(_indexed(spark, d), _raw(spark, d), MAIN_METHODS))


# generation


def latest_raw_output(spark: SparkSession, d: str) -> DataFrame:
    return G.latest(_raw(spark, d)).select("row_idx", "method", "seq", "raw_output")


def prompt_context_choice(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("sample_idx", G.first_method(F.col("questions")).alias("method"), "questions", "answers", "contexts").select("sample_idx", "method", G.prompt_context(F.col("method")).alias("context"), G.prompt_context(F.col("method"), "NEU").alias("neutral_context"))


def rcot_requests(spark: SparkSession, d: str) -> DataFrame:
    r = G.rcot_requests(_indexed(spark, d), MAIN_METHODS)
    return r.select("row_idx", "sample_id", "method", "prompt_context", "source_method", (F.length("prompt") - F.length("prompt_context")).alias("frame_chars"), F.length("prompt_context").alias("prompt_context_chars"))


def r0_requests(spark: SparkSession, d: str) -> DataFrame:
    return G.r0_requests(_indexed(spark, d)).select("row_idx", "sample_id", "method", "prompt_context", "source_method")


def requests_pending(spark: SparkSession, d: str) -> DataFrame:
    return G.pending(G.rcot_requests(_indexed(spark, d), MAIN_METHODS), _raw(spark, d)).select("row_idx", "method")


def head_requests(spark: SparkSession, d: str) -> DataFrame:
    """The head limit as a feature: requests of the first twenty rows."""
    return G.r0_requests(_indexed(spark, d), limit=20).select("row_idx", "source_method")


def rcot_build(spark: SparkSession, d: str) -> DataFrame:
    out = G.rcot_build(_indexed(spark, d), _raw(spark, d), ["NEU", "SSR"])
    return _flat(out, "questions", "reasonings", "generated_parse_modes", "generated_skeletons").select("row_idx", "id", "questions", "reasonings", "generated_parse_modes", "generated_skeletons")


def rcot_rejected(spark: SparkSession, d: str) -> DataFrame:
    return G.rcot_rejected(_indexed(spark, d), _raw(spark, d), ["NEU", "SSR"])


def r0_build(spark: SparkSession, d: str) -> DataFrame:
    return _flat(G.r0_build(_indexed(spark, d), _raw(spark, d)), "questions", "answers", "reasonings", "generated_parse_modes").select("row_idx", "id", "questions", "answers", "reasonings", "generated_parse_modes")


def r0_rejected(spark: SparkSession, d: str) -> DataFrame:
    return G.r0_rejected(_indexed(spark, d), _raw(spark, d))


# metrics


def _long(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scoreable(prepare.to_long(spread(_rows(spark, d))))


def lexical_anchoring(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).select("sample_idx", "method", scoring.lcs_recall(X.words(F.col("answer")), X.words(F.col("reasoning"))).alias("lexical_anchoring"))


def prob_anchoring(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    counts = scoring.token_counts(long, ["sample_idx", "method"])
    lk = scoring.likelihoods(counts, scoring.word_shares(long, "answer", "reasoning"), ["sample_idx", "method"])
    bits = lambda c: M.bits_per_token(M.ln_to_log10(F.col(c)), F.col("n"))
    return lk.select("sample_idx", "method", F.col("n").alias("answer_words"), _round(bits("base")).alias("base_bits"), _round(bits("final")).alias("final_bits"), _round(M.probabilistic_anchoring(bits("base"), bits("final"))).alias("aprob"))


def _segments(long: DataFrame, segment: Column) -> DataFrame:
    """Means of the surprisals of each segment of each trace, in order."""
    keys = ["sample_idx", "method"]
    means = scoring.mean_surprisals(scoring.trace_tokens(long, keys), scoring.word_shares(long, "reasoning"), keys, segment)
    return scoring.segment_lists(means, keys)


def entropy_anchoring(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    later = F.transform(F.filter("v", lambda x: x["segment"] > 1), lambda x: x["entropy"])
    g = _segments(long, F.col("step")).select("sample_idx", "method", M.entropy_of_means(later).alias("e"))
    return long.select("sample_idx", "method").join(g, ["sample_idx", "method"], "left").select("sample_idx", "method", _round(F.coalesce("e", F.lit(0.0))).alias("entropy_anchoring"))


def entropy_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    g = _segments(_long(spark, d), F.floor(F.col("pos") / M.WINDOW))
    return g.select("sample_idx", "method", F.size("v").alias("windows"), _round(M.entropy_of_means(F.col("v.entropy"))).alias("entropy_anchoring"))


def scored_records(spark: SparkSession, d: str) -> DataFrame:
    """Surrogate scoring of every (sample, method) and the sample gate, end to end."""
    long = prepare.to_long(spread(_rows(spark, d)))
    recs = scoring.score_records(scoring.SurrogateScorer(), scoring.scoreable(long))
    every = cut(long.select("sample_idx", "method").join(recs, ["sample_idx", "method"], "left"))  # the gate looks twice
    return scoring.gate(every).select("sample_idx", "method", *[_round(c).alias(c) for c in ("lexical_anchoring", "entropy_anchoring", "Aprob")])


def resumed_raw_output(spark: SparkSession, d: str) -> DataFrame:
    """Resume state read from a folder of JSON lines to which raw outputs were appended in three unequal batches."""
    raw = _raw(spark, d).withColumn("_late", F.row_number().over(Window.partitionBy("row_idx", F.coalesce("method", F.lit("R0"))).orderBy("seq")))
    folder = f"{shared_folder(spark)}/raw-{uuid.uuid4()}"
    for part in (F.col("_late") == 1, F.col("_late") == 2, F.col("_late") > 2):
        jsonl.append_jsonl(raw.where(part).orderBy("_late").select("row_idx", "id", "method", "raw_output", F.col("seq").cast("int").alias("output_tokens")), folder)
    last = cut(jsonl.read_completed(spark, folder).select("row_idx", "method", F.col("output_tokens").cast("bigint").alias("seq"), "raw_output"))
    files.delete(spark, folder)
    return last


# records

_VALUES = ("lexical_anchoring", "entropy_anchoring", "aprob")


def finite_records(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return r.groupBy("method").agg(F.count("*").alias("rows"), *[F.count_if(M.finite(F.col(c))).alias(f"finite_{c}") for c in _VALUES], F.count_if(M.all_finite(*[F.col(c) for c in _VALUES])).alias("finite"))


def sample_gate(spark: SparkSession, d: str) -> DataFrame:
    return scoring.gate(_records(spark, d), ["run_id", "sample_idx"], _VALUES)


def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return scoring.gate_counts(prepare.to_long(rows), _records(spark, d).withColumnRenamed("aprob", "Aprob"), rows)


def valid_data(spark: SparkSession, d: str) -> DataFrame:
    return scoring.valid_data(_rows(spark, d), _records(spark, d).withColumnRenamed("aprob", "Aprob")).select("sample_idx", "id")


def shard_rows(spark: SparkSession, d: str) -> DataFrame:
    """One shard of four is the operator's feature."""
    return scoring.shard(_rows(spark, d), 4, 1).select("sample_idx", "id")


def aggregate_fixed_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary.aggregate(_records(spark, d)))


def aggregate_by_run(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary.aggregate(_records(spark, d), "run_id"))


def aggregate_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary.aggregate_all_numeric(_records(spark, d)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_round(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def _main(spark: SparkSession, d: str) -> DataFrame:
    """Gated records, as zones are only made of those; kept, as thresholds are found in several passes."""
    return cut(scoring.gate(_records(spark, d), ["run_id", "sample_idx"], _VALUES).select("method", *_VALUES))


def scaled_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy("run_id", "method").agg(F.count("*").alias("n"), F.count_if(F.isnan(M.scaled(F.col("aprob")))).alias("nan"), _round(F.avg(F.when(~F.isnan("aprob"), M.scaled(F.col("aprob"))))).alias("mean_scaled"))


def zone_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary.thresholds(summary.scale(_main(spark, d))))


def zone_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary.zones(_main(spark, d)))


def zone_summary_ungated(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(summary.zones(_records(spark, d).select("method", *_VALUES)))


def zone_points(spark: SparkSession, d: str) -> DataFrame:
    return summary.zone_points(_main(spark, d)).groupBy("method", "zone").agg(F.count("*").alias("n"), _round(F.avg("c")).alias("mean_lexical"))


def figure_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = summary.figure_cells(summary.zone_points(_main(spark, d)))
    return cells.select("method", _round("x").alias("x"), _round("y").alias("y"), _round("c").alias("c"), "n")


def method_order(spark: SparkSession, d: str) -> DataFrame:
    return summary.ordered_methods(_records(spark, d))


def method_coverage(spark: SparkSession, d: str) -> DataFrame:
    return summary.covers(_records(spark, d), [*MAIN_METHODS, *CONTROL_METHODS, "Unseen"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        zone_summary, conversation_qa, conversation_format, convert_rows, long_rows, validate_rows, validated, validate_summary, function_word_skeleton, controlled_variants, controlled_wide,
        split_steps, sampled_steps, step_boundaries, parse_reasoning, parse_mode_counts, latest_raw_output, prompt_context_choice, rcot_requests, r0_requests, requests_pending, head_requests,
        rcot_build, rcot_rejected, r0_build, r0_rejected, lexical_anchoring, prob_anchoring, entropy_anchoring, entropy_fixed_windows, scored_records, resumed_raw_output, finite_records, sample_gate, gate_summary,
        valid_data, shard_rows, aggregate_fixed_quadrants, aggregate_by_run, aggregate_numeric, scaled_records, zone_thresholds, zone_summary_ungated, zone_points, figure_cells, method_order, method_coverage,
    )
    return {f.__name__: f for f in own}
