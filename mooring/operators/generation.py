"""Generation requests, resume state and building metric rows from raw outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooring.functions import text as X
from mooring.operators.model import chat_text
from mooring.schemas import DEFAULT_METHOD, RAW_GENERATION

#: Own wording of the system prompts by method.
PROMPTS = {
    "NEU": "Reconstruct the reasoning that leads from the user's request to the given reply. Put it between <reason> and </reason>.",
    "SUP": "Reconstruct the reasoning that leads from the user's request to the given reply, without using or hinting at the reply before the end. Put it between <reason> and </reason>.",
    "AUG-SUP": "Reconstruct the reasoning that leads from the user's request to the given reply. Work the problem out anew, explain each choice, check intermediate results, and never use or hint at the reply before the end. Put it between <reason> and </reason>.",
    "SSR": "First write a skeleton of the reasoning as numbered, tagged steps between <skeleton> and </skeleton>; then follow it and write the reasoning between <reason> and </reason>.",
}
BLIND_PROMPT = "Think the question through step by step. Put the reasoning between <reason> and </reason>."


def split_methods(value: str) -> list[str]:
    """Methods of a comma-separated list, stripped, without empty ones."""
    return [m.strip() for m in value.split(",") if m.strip()]


def latest(raw: DataFrame, order: str = "seq") -> DataFrame:
    """The last row of each (row_idx, method); a null method is R0.

    The filter on row_number lets Spark drop all but one row a key before the
    shuffle, so a key that holds a large share of the rows does no harm.
    """
    w = Window.partitionBy("row_idx", "method").orderBy(F.col(order).desc())
    return raw.withColumn("method", F.coalesce("method", F.lit(DEFAULT_METHOD))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def first_method(questions: Column) -> Column:
    """NEU if it is a key, else the first key, else R0."""
    return F.when(F.coalesce(F.map_contains_key(questions, F.lit("NEU")), F.lit(False)), F.lit("NEU")).otherwise(F.coalesce(F.get(F.map_keys(questions), F.lit(0)), F.lit(DEFAULT_METHOD)))


def prompt_context(method: Column, context_method: str = "same") -> Column:
    """Context of the method (or of a fixed one); a blank one falls back to question and answer."""
    q, a = (X.text(F.try_element_at(F.col(s), method)) for s in ("questions", "answers"))
    c = X.text(F.try_element_at(F.col("contexts"), method if context_method == "same" else F.lit(context_method)))
    back = F.when(a != "", X.strip(F.concat(F.lit("User: "), q, F.lit("\n\nAssistant: "), a))).otherwise(q)
    return F.when(X.strip(c) != "", c).otherwise(back)


def chat(system: Column, user: Column) -> Column:
    """The literal chat format used where no tokenizer brings its own template."""
    return F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def chat_prefix(user: Column) -> Column:
    """The same for a user message alone, as scoring conditions on it."""
    return F.concat(F.lit("<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def tokenizer_template(make: Callable[[], Any]) -> Callable[[Column, Column], Column]:
    """The chat template of a model's own tokenizer, for ``template`` of the requests.

    ``make()`` loads the tokenizer, once a Python task; thinking is turned off where
    the template knows of it, and one without a template gets the literal format.
    """

    @F.pandas_udf("string")
    def render(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokenizer = make()
        for system, user in parts:
            yield pd.Series([chat_text(tokenizer, [{"role": "system", "content": a}, {"role": "user", "content": b}]) for a, b in zip(system, user)], dtype="object")

    return render


def pretrained_tokenizer(path: str) -> Callable[[], Any]:
    """A tokenizer of a local checkpoint, if the transformers library is installed; untested here."""

    def make() -> Any:
        from transformers import AutoTokenizer

        return AutoTokenizer.from_pretrained(path)

    return make


def rcot_requests(rows: DataFrame, methods: Sequence[str], context_method: str = "same", limit: int | None = None, template: Callable[[Column, Column], Column] = chat) -> DataFrame:
    """A request for each row and method with a context that isn't blank.

    ``rows`` has ``row_idx, id`` and the maps. An unknown method is an error.
    """
    unknown = [m for m in methods if m not in PROMPTS]
    if unknown:
        raise ValueError(f"unknown methods: {unknown}; known: {sorted(PROMPTS)}")
    head = rows if limit is None else rows.where(F.col("row_idx") < limit)
    prompts = F.create_map(*[F.lit(x) for x in chain.from_iterable(PROMPTS.items())])
    each = head.select("row_idx", "id", "questions", "answers", "contexts", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    return _requests(each.select("row_idx", "id", "method", prompt_context(F.col("method"), context_method).alias("prompt_context"), F.col("method").alias("source_method"), F.element_at(prompts, F.col("method")).alias("_system")), template)


def r0_requests(rows: DataFrame, method: str = DEFAULT_METHOD, limit: int | None = None, template: Callable[[Column, Column], Column] = chat) -> DataFrame:
    """A request for each row with a question, blind to the answer."""
    head = rows if limit is None else rows.where(F.col("row_idx") < limit)
    source = first_method(F.col("questions"))
    return _requests(head.select("row_idx", "id", F.lit(method).alias("method"), X.text(F.try_element_at(F.col("questions"), source)).alias("prompt_context"), source.alias("source_method"), F.lit(BLIND_PROMPT).alias("_system")), template)


def _requests(flat: DataFrame, template: Callable[[Column, Column], Column]) -> DataFrame:
    return flat.where(~X.blank(F.col("prompt_context"))).select("row_idx", F.coalesce("id", F.col("row_idx").cast("string")).alias("sample_id"), "method", template(F.col("_system"), F.col("prompt_context")).alias("prompt"), "prompt_context", "source_method")


def pending(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """Requests without any raw output of their (row_idx, method)."""
    done = raw.select("row_idx", F.coalesce("method", F.lit(DEFAULT_METHOD)).alias("method"))
    return requests.join(done, ["row_idx", "method"], "left_anti")


Generator = Callable[[list[str]], list[tuple[str, str, int]]]


def generate(requests: DataFrame, make: Callable[[], Generator], chunk: int = 256) -> DataFrame:
    """Raw generation rows for the requests.

    ``make()`` builds the model once a task; it maps prompts to
    ``(text, finish_reason, tokens)``. Rows go to it in chunks of ``chunk``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            for at in range(0, len(pdf), chunk):
                part = pdf.iloc[at : at + chunk]
                got = model(part.prompt.tolist())
                yield pd.DataFrame(
                    {
                        "row_idx": part.row_idx.to_numpy(),
                        "id": part.sample_id.to_numpy(),
                        "method": part.method.to_numpy(),
                        "raw_output": [t for t, _, _ in got],
                        "finish_reason": [f for _, f, _ in got],
                        "output_tokens": [n for _, _, n in got],
                        "prompt_chars": part.prompt.str.len().to_numpy(),
                        "prompt_context_chars": part.prompt_context.str.len().to_numpy(),
                        "source_method": part.source_method.to_numpy(),
                    }
                )

    return requests.mapInPandas(run, RAW_GENERATION)


def echo_generator() -> Generator:
    """Stand-in model for tests: repeats the prompt's last line inside reason tags."""
    return lambda prompts: [(f"<reason>{p.strip().splitlines()[-1]}</reason>", "stop", len(p.split())) for p in prompts]


def vllm_generator(model: str, max_tokens: int = 8192, context: int = 32768, temperature: float = 0.0, top_p: float = 1.0, seed: int = 42, devices: int = 4, memory: float = 0.9, eager: bool = False, own_all_reduce: bool = True) -> Callable[[], Generator]:
    """A generator on a local inference engine, if one is installed; untested here.

    Greedy and seeded by default. No output of the engine gives an empty text.
    """

    def make() -> Generator:
        from vllm import LLM, SamplingParams

        llm = LLM(model=model, tensor_parallel_size=devices, gpu_memory_utilization=memory, max_model_len=context, seed=seed, enforce_eager=eager, disable_custom_all_reduce=not own_all_reduce)
        params = SamplingParams(temperature=temperature, top_p=top_p, max_tokens=max_tokens)

        def run(prompts: list[str]) -> list[tuple[str, str, int]]:
            outs = [o.outputs[0] if o.outputs else None for o in llm.generate(prompts, params)]
            return [("", "", 0) if o is None else (o.text, o.finish_reason or "", len(o.token_ids)) for o in outs]

        return run

    return make


def _parsed(rows: DataFrame, methods: Column, raw: DataFrame, limit: int | None) -> DataFrame:
    """``row_idx, method_pos, method`` of all wanted pairs with the parse of their latest output."""
    head = rows if limit is None else rows.where(F.col("row_idx") < limit)
    want = head.select("row_idx", F.posexplode(methods).alias("method_pos", "method"))
    got = latest(raw).select("row_idx", "method", F.lit(True).alias("there"), X.parse_reasoning(F.col("raw_output")).alias("p"))
    return want.join(got, ["row_idx", "method"], "left").select("row_idx", "method_pos", "method", F.coalesce("there", F.lit(False)).alias("there"), "p.reason", "p.skeleton", "p.mode")


def rcot_parts(rows: DataFrame, raw: DataFrame, methods: Sequence[str], limit: int | None = None) -> DataFrame:
    """One row a wanted (row, method): is it there, how was it parsed, is it missing?"""
    p = _parsed(rows, F.array(*[F.lit(m) for m in methods]), raw, limit)
    return p.withColumn("missing", ~F.col("there") | X.blank(F.col("reason")))


def parse_counts(parts: DataFrame) -> DataFrame:
    """Outputs by parse mode, blank ones too."""
    return parts.where("there").groupBy("mode").agg(F.count("*").alias("n"))


def rcot_build(rows: DataFrame, raw: DataFrame, methods: Sequence[str], limit: int | None = None) -> DataFrame:
    """Metric rows of all rows for which every method has a reasoning.

    Adds ``generated_parse_modes`` and ``generated_skeletons`` (null where no
    method has a skeleton). Each row's few methods are grouped; texts stay apart.
    """
    parts = rcot_parts(rows, raw, methods, limit)
    g = parts.groupBy("row_idx").agg(F.max("missing").alias("bad"), F.array_sort(F.collect_list(F.struct("method_pos", "method", "reason", "skeleton", "mode"))).alias("p")).where(~F.col("bad"))
    pick = lambda s: F.map_from_arrays(F.array(*[F.lit(m) for m in methods]), F.array(*[X.text(F.try_element_at(F.col(s), F.lit(m))) for m in methods])).alias(s)
    with_skeleton = F.filter("p", lambda x: x["skeleton"] != "")
    return rows.join(g, "row_idx").select(
        "row_idx", F.coalesce("id", F.col("row_idx").cast("string")).alias("id"), pick("questions"), pick("answers"), pick("contexts"),
        F.map_from_arrays(F.col("p.method"), F.col("p.reason")).alias("reasonings"), F.map_from_arrays(F.col("p.method"), F.col("p.mode")).alias("generated_parse_modes"),
        F.when(F.size(with_skeleton) > 0, F.map_from_arrays(F.transform(with_skeleton, lambda x: x["method"]), F.transform(with_skeleton, lambda x: x["skeleton"]))).alias("generated_skeletons"),
    )


def rcot_rejected(rows: DataFrame, raw: DataFrame, methods: Sequence[str], limit: int | None = None) -> DataFrame:
    """``row_idx, id, missing`` of the rows some method lacks, methods in the order asked for."""
    parts = rcot_parts(rows, raw, methods, limit).where("missing")
    g = parts.groupBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("method_pos", "method"))).alias("m"))
    return rows.select("row_idx", F.coalesce("id", F.col("row_idx").cast("string")).alias("id")).join(g, "row_idx").select("row_idx", "id", F.col("m.method").alias("missing"))


def r0_parts(rows: DataFrame, raw: DataFrame, method: str = DEFAULT_METHOD, limit: int | None = None) -> DataFrame:
    """One row a row: question, answer, parse and reject reason (null: accepted)."""
    p = _parsed(rows, F.array(F.lit(method)), raw, limit)
    source = first_method(F.col("questions"))
    own = rows.select("row_idx", F.coalesce("id", F.col("row_idx").cast("string")).alias("id"), *[X.text(F.try_element_at(F.col(s), source)).alias(s[:-1]) for s in ("questions", "answers")])
    reason = F.when(~F.col("there"), F.lit("missing_raw_output")).when(X.blank(F.col("reason")), F.lit("empty_reasoning"))
    return own.join(p, "row_idx").withColumn("reject", reason)


def r0_build(rows: DataFrame, raw: DataFrame, method: str = DEFAULT_METHOD, limit: int | None = None) -> DataFrame:
    """One-method metric rows; the context is the question."""
    ok = r0_parts(rows, raw, method, limit).where("reject is null")
    one = lambda c: F.create_map(F.lit(method), F.col(c))
    return ok.select("row_idx", "id", one("question").alias("questions"), one("answer").alias("answers"), one("question").alias("contexts"), one("reason").alias("reasonings"), one("mode").alias("generated_parse_modes"))


def r0_rejected(rows: DataFrame, raw: DataFrame, method: str = DEFAULT_METHOD, limit: int | None = None) -> DataFrame:
    return r0_parts(rows, raw, method, limit).where("reject is not null").select("row_idx", "id", F.col("reject").alias("reason"))


def dispatch(mode: str, rows: DataFrame, raw: DataFrame, methods: Iterable[str], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(built, rejected)`` for mode ``rcot`` or ``r0``."""
    methods = list(methods)
    if mode == "rcot":
        return rcot_build(rows, raw, methods, limit), rcot_rejected(rows, raw, methods, limit)
    if mode == "r0":
        return r0_build(rows, raw, methods[0], limit), r0_rejected(rows, raw, methods[0], limit)
    raise ValueError(f"unknown mode: {mode}")
