"""Command line: prepare, generate, build, score, aggregate, summarise, run the pipeline, report."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.operators import generation, model, prepare, scoring
from mooring.plans import pipeline, report
from mooring.schemas import CONVERSATION_ROW, DEFAULT_METHOD, MAIN_METHODS
from mooring.session import local_session
from mooring.sources import jsonl

_NEED, _FLAG = {"required": True}, {"action": "store_true"}
_INT, _FLOAT = (lambda n: {"type": int, "default": n}), (lambda x: {"type": float, "default": x})
_METHODS = ("--methods", {"default": ",".join(MAIN_METHODS)})
_MODE = (("--mode", {"choices": ["rcot", "r0"], "default": "rcot"}), _METHODS, ("--method-name", {"default": DEFAULT_METHOD}), ("--limit", {"type": int}), ("--rejected-output", {}), ("--summary-output", {}))
#: A model of one's own; without one the deterministic surrogate scores.
_SCORER = (("--disable-shared-prefix-past", _FLAG), ("--debug-errors", _FLAG))

#: What each command takes.
COMMANDS: dict[str, tuple] = {
    "validate": (("--input", _NEED), ("--output", _NEED), _METHODS, ("--strict", _FLAG)),
    "convert": (("--input", _NEED), ("--output", _NEED), ("--method", {"default": "SSR"})),
    "controlled": (("--input", _NEED), ("--output", _NEED), ("--base-method", {"default": "NEU"})),
    "build": (("--input", _NEED), ("--raw-output", _NEED), ("--output", _NEED), *_MODE),
    "generate": (
        ("--input", _NEED), ("--raw-output", _NEED), ("--output", {"help": "metric rows to build in the end"}), *_MODE, ("--build-only", _FLAG), ("--model", {"help": "local checkpoint; without one prompts are echoed"}), ("--prompt-context-method", {"default": "same"}), ("--chunk-size", _INT(256)),
        ("--max-model-len", _INT(32768)), ("--max-tokens", _INT(8192)), ("--temperature", _FLOAT(0.0)), ("--top-p", _FLOAT(1.0)), ("--tensor-parallel-size", _INT(4)), ("--gpu-memory-utilization", _FLOAT(0.9)), ("--seed", _INT(42)), ("--enforce-eager", _FLAG), ("--disable-custom-all-reduce", _FLAG),
    ),
    "score": (("--input", _NEED), ("--output-dir", _NEED), ("--scoring-model", {}), *_SCORER, ("--rank", _INT(0)), ("--world-size", _INT(1))),
    "aggregate": (("--input", _NEED), ("--output", _NEED), ("--group-by", {"default": "method"})),
    "zones": (("--metrics", _NEED), ("--out-dir", _NEED), ("--prefix", _NEED), ("--zone-quantile", _FLOAT(0.6))),
    "pipeline": (("--input", _NEED), ("--run-dir", _NEED), ("--model", {}), _METHODS, ("--control-base-method", {"default": "NEU"}), ("--zone-quantile", _FLOAT(0.6)), ("--force", _FLAG), ("--skip-metrics", _FLAG), ("--skip-controlled-metrics", _FLAG), *_SCORER),
    "report": (("--run-dir", _NEED), ("--output", {})),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mooring", description=__doc__)
    sub = top.add_subparsers(dest="what", required=True)
    for name, flags in COMMANDS.items():
        p = sub.add_parser(name)
        for flag, kw in flags:
            p.add_argument(flag, **kw)
    return top


def _scorer(checkpoint: str | None, a: argparse.Namespace) -> scoring.Scorer:
    if not checkpoint:
        return scoring.SurrogateScorer()
    return scoring.ModelScorer(model.transformers_scorer(checkpoint, not a.disable_shared_prefix_past), a.debug_errors)


def _generator(a: argparse.Namespace):
    if not a.model:
        return generation.echo_generator
    return generation.vllm_generator(a.model, a.max_tokens, a.max_model_len, a.temperature, a.top_p, a.seed, a.tensor_parallel_size, a.gpu_memory_utilization, a.enforce_eager, not a.disable_custom_all_reduce)


def _messages(rows: DataFrame) -> Column:
    """Messages of the file schema with the sender field named as in the tables."""
    return F.transform("conversations", lambda m: F.struct(m["role"].alias("role"), m["from"].alias("from_role"), m["content"].alias("content"), m["value"].alias("value")))


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2))
    spark = local_session()
    if a.what == "report":
        print(report.write_report(spark, a.run_dir, a.output))
    elif a.what == "validate":
        rows, own = pipeline.read_metric_rows(spark, a.input), a.methods.split(",")
        jsonl.write_raw(prepare.validate(rows, own, a.strict), a.output)
        say({"mode": "validate", "input": a.input, "output": a.output, "methods": own, **prepare.validation_counts(rows, own).first().asDict()})
    elif a.what == "convert":
        rows = jsonl.read_jsonl(spark, a.input, CONVERSATION_ROW, numbered=True)
        rows = rows.withColumn("conversations", _messages(rows)).withColumnRenamed("row_no", "row_idx")
        n = jsonl.write_jsonl(prepare.convert(rows, a.method).orderBy("row_idx").drop("row_idx"), a.output)
        say({"mode": "convert", "input": a.input, "output": a.output, "method": a.method, "written": n})
    elif a.what == "controlled":
        long = prepare.controlled(pipeline.read_metric_rows(spark, a.input), a.base_method)
        n = jsonl.write_jsonl(prepare.to_wide(long).orderBy("sample_idx").drop("sample_idx"), a.output)
        say({"mode": "controlled", "input": a.input, "output": a.output, "base_method": a.base_method, "written": n})
    elif a.what in ("build", "generate"):
        methods = generation.split_methods(a.methods) if a.mode == "rcot" else [a.method_name]
        if a.what == "generate" and not a.build_only:
            template = generation.tokenizer_template(generation.pretrained_tokenizer(a.model)) if a.model else generation.chat
            say(pipeline.generate_missing(spark, a.input, a.raw_output, _generator(a), a.mode, methods, a.prompt_context_method, a.limit, a.chunk_size, template))
        if a.output:
            say(pipeline.build_only(spark, a.input, a.raw_output, a.output, a.mode, methods, a.limit, a.rejected_output, a.summary_output))
    elif a.what == "score":
        say(pipeline.score_file(spark, a.input, a.output_dir, _scorer(a.scoring_model, a), a.rank, a.world_size))
    elif a.what == "aggregate":
        print(report.aggregate_text(pipeline.aggregate_file(spark, a.input, a.output, a.group_by)))
    elif a.what == "zones":
        say(pipeline.summarise(spark, a.metrics, a.out_dir, a.prefix, a.zone_quantile))
    else:
        say(
            pipeline.run(
                spark, a.input, a.run_dir, _scorer(a.model, a), a.methods.split(","), a.control_base_method, a.force, a.skip_metrics, a.skip_controlled_metrics, a.zone_quantile, a.model or "surrogate",
            )
        )


if __name__ == "__main__":
    main()
