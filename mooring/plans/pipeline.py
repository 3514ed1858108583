"""The pipeline: validate, derive variants, score, gate, summarise, report.

Stages hand DataFrames on and keep what they made as JSON-lines folders of the
run, in any file system Spark writes to, reused under the same rules as before a
rerun: inputs unless ``force``, metrics if every expected method is there.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mooring.operators import generation as G
from mooring.operators import prepare, scoring, summary
from mooring.plans import report
from mooring.schemas import CONTROL_METHODS, MAIN_METHODS, METRIC_ROW
from mooring.session import cut, shared_folder
from mooring.sources import files, jsonl


def metrics_complete(spark: SparkSession, folder: str, expected: Sequence[str]) -> bool:
    """Does the folder hold records of every expected method?"""
    try:
        recs = jsonl.read_metric_records(spark, folder)
    except FileNotFoundError:
        return False
    return summary.covers(recs, expected).first().complete


def read_metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows with ``sample_idx`` = physical line number; the raw line is kept."""
    return jsonl.read_jsonl(spark, path, METRIC_ROW, numbered=True).withColumnRenamed("line_no", "sample_idx").drop("row_no")


def score_rows(rows: DataFrame, scorer: scoring.Scorer) -> tuple[DataFrame, DataFrame]:
    """``(gated records, valid input rows)`` of metric rows.

    Every (sample, method) of ``questions`` must have a finite record, or the
    whole sample goes. The records are cut off from their lineage, so no trace is
    scored twice.
    """
    long = prepare.to_long(rows)
    recs = scoring.score_records(scorer, scoring.scoreable(long))
    every = cut(long.select("sample_idx", "method").join(recs, ["sample_idx", "method"], "left"))
    kept = scoring.gate(every)
    return kept.select("method", "sample_idx", "lexical_anchoring", "entropy_anchoring", "Aprob"), rows.join(kept.select("sample_idx"), "sample_idx", "left_semi")


def score_file(spark: SparkSession, rows_path: str, out: str, scorer: scoring.Scorer, rank: int = 0, world: int = 1) -> dict:
    """Scores a metric file, or one of ``world`` shards of it, into the files of ``rank``; gives the numbers of samples.

    A sample without any method is in the total only.
    """
    rows = read_metric_rows(spark, rows_path)
    rows = rows if world == 1 else scoring.shard(rows, world, rank)
    recs, valid = score_rows(rows, scorer)
    jsonl.write_jsonl(recs, f"{out}/metrics_rank{rank}.jsonl")
    jsonl.write_raw(valid, f"{out}/valid_data/valid_data_rank{rank}.jsonl")
    total, with_method = rows.agg(F.count("*"), F.count_if(F.size("questions") > 0)).first()
    kept = spark.read.text(f"{out}/valid_data/valid_data_rank{rank}.jsonl").count()
    return {"rank": rank, "total": total, "valid": kept, "discarded": with_method - kept}


def run_metrics(spark: SparkSession, rows_path: str, out: str, methods: Sequence[str], scorer: scoring.Scorer | None, force: bool = False, skip: bool = False) -> bool:
    """Scores a metric file into ``out``; False if existing records were reused."""
    if skip:
        if not metrics_complete(spark, out, methods):
            raise FileNotFoundError(f"metrics of {out} are incomplete and scoring is skipped")
        return False
    if files.exists(spark, out):
        if not force:
            if metrics_complete(spark, out, methods):
                return False
            raise FileExistsError(f"{out} exists but is incomplete; force overwrites it")
        files.delete(spark, out)
    score_file(spark, rows_path, out, scorer)
    return True


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.read_metric_records(spark, folder).withColumnRenamed("Aprob", "aprob")


def summarise(spark: SparkSession, metrics: str, out: str, prefix: str, quantile: float = 0.6) -> dict:
    recs = cut(_records(spark, metrics))  # looked at several times
    made = report.write_zone_tables(summary.zones(recs, quantile), out, prefix, metrics, quantile)
    report.write_figure(summary.zone_points(recs, quantile), out, prefix, made["zone_threshold"])
    return made


def aggregate_file(spark: SparkSession, metrics: str, output: str, by: str = "method") -> dict:
    """The stand-alone aggregation by any field: nested means of every numeric field and quadrants as JSON, even if empty."""
    recs = jsonl.read_any_records(spark, metrics, text=(by,))
    for name, kind in ((by, "string"), ("Aprob", "double"), ("entropy_anchoring", "double")):
        if name not in recs.columns:
            recs = recs.withColumn(name, F.lit(None).cast(kind))
    nested = report.aggregate_json(summary.aggregate_all_numeric(recs, by, y="Aprob"))
    report.write_json(spark, output, nested, 4)
    return nested


def run(
    spark: SparkSession, input_path: str, run_dir: str, scorer: scoring.Scorer | None = None, methods: Sequence[str] = MAIN_METHODS, base: str = "NEU",
    force: bool = False, skip_metrics: bool = False, skip_controlled: bool = False, quantile: float = 0.6, model: str = "surrogate",
) -> dict:
    """The whole pipeline; returns the manifest it writes."""
    scorer, run_dir = scorer or scoring.SurrogateScorer(), str(run_dir)
    own, ctl = f"{run_dir}/inputs/example.metric.jsonl", f"{run_dir}/inputs/controlled_reference.metric.jsonl"
    if force or not files.exists(spark, own):
        jsonl.write_raw(prepare.validate(read_metric_rows(spark, input_path), methods, strict=True), own)
    if force or not files.exists(spark, ctl):
        wide = prepare.to_wide(prepare.controlled(read_metric_rows(spark, own), base)).orderBy("sample_idx")
        jsonl.write_jsonl(wide, ctl, columns=["id", "questions", "answers", "contexts", "reasonings"])
    m_dir, c_dir = f"{run_dir}/metrics/methods", f"{run_dir}/metrics/controlled"
    run_metrics(spark, own, m_dir, methods, scorer, force, skip_metrics)
    summarise(spark, m_dir, f"{run_dir}/figures/methods", "methods", quantile)
    if not skip_controlled:
        run_metrics(spark, ctl, c_dir, CONTROL_METHODS, scorer, force)
        summarise(spark, c_dir, f"{run_dir}/figures/controlled", "controlled", quantile)
    manifest = {"input": input_path, "model": model, "run_dir": run_dir, "python": sys.executable, "method_metrics": m_dir, "controlled_metrics": c_dir}
    report.write_json(spark, f"{run_dir}/manifest.json", manifest)
    report.write_report(spark, run_dir)
    return manifest


def _indexed(spark: SparkSession, path: str) -> DataFrame:
    return jsonl.read_jsonl(spark, path, METRIC_ROW, numbered=True).withColumn("row_idx", F.col("row_no").cast("int"))


def generate_missing(
    spark: SparkSession, rows_path: str, raw_path: str, make: Callable[[], G.Generator], mode: str = "rcot", methods: Sequence[str] = MAIN_METHODS, context_method: str = "same",
    limit: int | None = None, chunk: int = 256, template: Callable[[Column, Column], Column] = G.chat, wave_rows: int | None = None,
) -> dict:
    """Generates what has no raw output yet and appends it to ``raw_path``; a rerun goes on where the last ended.

    The requests are laid down once, in waves of about ``wave_rows`` (four chunks a
    core unless given), and each wave is appended when it is done, so a failure
    costs no more than one.
    """
    rows = _indexed(spark, rows_path)
    requests = G.rcot_requests(rows, methods, context_method, limit, template) if mode == "rcot" else G.r0_requests(rows, methods[0], limit, template)
    todo = cut(G.pending(requests, jsonl.read_completed(spark, raw_path)))
    n = todo.count()
    each = wave_rows or 4 * chunk * spark.sparkContext.defaultParallelism
    waves, done, folder = -(-n // each), 0, f"{shared_folder(spark)}/requests-{uuid.uuid4()}"
    if waves > 1:
        todo.withColumn("wave", F.pmod(F.xxhash64("row_idx", "method"), F.lit(waves))).repartition("wave").write.partitionBy("wave").parquet(folder)
        stored = spark.read.parquet(folder)
        parts = [stored.where(F.col("wave") == w).drop("wave").repartition(spark.sparkContext.defaultParallelism) for w in range(waves)]
    else:
        parts = [todo] if n else []
    try:
        for part in parts:
            done += jsonl.append_jsonl(G.generate(part, make, chunk), raw_path)
    finally:
        files.delete(spark, folder)
    return {"mode": mode, "pending": n, "generated": done, "waves": waves, "methods": list(methods), "prompt_context_method": context_method if mode == "rcot" else None, "raw_output": raw_path}


def build_only(spark: SparkSession, rows_path: str, raw_path: str, output: str, mode: str = "rcot", methods: Sequence[str] = MAIN_METHODS, limit: int | None = None, rejected_path: str | None = None, summary_path: str | None = None) -> dict:
    """Parses existing raw outputs into metric rows, no model and no tokenizer, and writes rows, rejected rows and a summary."""
    rows = _indexed(spark, rows_path)
    raw = jsonl.read_completed(spark, raw_path).withColumn("seq", F.lit(0))
    built, rejected = G.dispatch(mode, rows, raw, methods, limit)
    rejected_path = rejected_path or jsonl.beside(output, "rejected.jsonl")
    n = jsonl.write_jsonl(built, output, columns=[c for c in built.columns if c != "row_idx"])
    bad = jsonl.write_jsonl(rejected, rejected_path)
    parts = G.rcot_parts(rows, raw, methods, limit) if mode == "rcot" else G.r0_parts(rows, raw, methods[0], limit)
    made = {
        "mode": mode, "input_rows": n + bad, "complete_rows": n, "rejected_rows": bad, "methods": list(methods), "parse_counts": {r.mode: r.n for r in G.parse_counts(parts).collect()},
        "input": rows_path, "output": output, "raw_output": raw_path, "rejected_output": rejected_path,
    }
    report.write_json(spark, summary_path or jsonl.beside(output, "summary.json"), made)
    return made
