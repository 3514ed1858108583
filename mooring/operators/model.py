"""Scoring a trace with a causal language model.

:func:`trace_scorer` is the procedure, for any :class:`LanguageModel`: the answer's
log-likelihood after the question and none, all or a sample of the trace's steps,
in micro-batches behind a shared prefix; and the entropies of the trace's tokens
behind the context, in chunks. :class:`TransformersModel` is one such model.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Sequence
from typing import Any, Protocol

#: What opens and closes a thought, and stands between steps.
THINK_OPEN, THINK_CLOSE, SEPARATOR = "<think>\n", "</think>\n\n", "\n\n"
#: Sequences scored at once; trace tokens whose entropies are worked out at once.
MICRO_BATCH, ENTROPY_CHUNK = 8, 512


class LanguageModel(Protocol):
    """``limit``: tokens of the longest context or None. ``full``: the exception that says memory ran out."""

    limit: int | None
    full: type[BaseException]

    def encode(self, text: str) -> list[int]: ...
    def chat(self, user: str) -> list[int]: ...
    def start(self, prefix: Sequence[int]) -> Any:
        """State after ``prefix``; None if states can't be kept."""

    def logprobs(self, state: Any, prompts: Sequence[Sequence[int]], answer: Sequence[int]) -> list[float]:
        """ln P(answer) after each prompt, the prompts standing behind ``state``."""

    def entropies(self, state: Any, tokens: Sequence[int], of: int) -> tuple[list[float], Any]:
        """Entropies (nats) of what follows each of the last ``of`` tokens, and the state after all."""


def sampled(n: int) -> list[int]:
    """Steps of the curve: all up to 50, then every fourth, and the last (see ``functions.metrics.sampled_steps``)."""
    return [i for i in range(max(n, 0) + 1) if i <= 50 or (i - 50) % 4 == 0 or i == n]


def in_batches(run: Callable[[Sequence], list[float]], items: Sequence, size: int, full: type[BaseException]) -> list[float]:
    """``run`` over slices of ``size`` items; when memory runs out the size is halved, down to one item, and work goes on where it was."""
    out: list[float] = []
    while len(out) < len(items):
        try:
            out += run(items[len(out) : len(out) + size])
        except full:
            if size == 1:
                raise
            size = max(1, size // 2)
    return out


def trace_scorer(model: LanguageModel, shared_prefix: bool = True, curve: bool = False, batch: int = MICRO_BATCH, chunk: int = ENTROPY_CHUNK) -> Callable[[str, str, str, str], dict]:
    """``score(question, answer, context, reasoning)`` giving the fields of the scored frame.

    Likelihoods are conditioned on the question, entropies on the context. Without
    a shared prefix every prompt is scored whole and loses its oldest tokens to fit
    the model's limit; behind one, nothing is cut. ``curve``: all sampled steps are
    scored and come out as ``curve`` (step, tokens before it, log10 p); else only
    none and all steps, which is all the metrics use.
    """
    opening, closing, between = (model.encode(x) for x in (THINK_OPEN, THINK_CLOSE, SEPARATOR))

    def answer_curve(prefix: list[int], parts: list[list[int]], answer: list[int]) -> list[float]:
        state = model.start(prefix) if shared_prefix else None
        ends = [p + closing for p in parts]
        if state is None:
            ends = [prefix + p for p in ends]
            if model.limit is not None:
                room = max(1, model.limit - len(answer))
                ends = [p[max(0, len(p) - room) :] for p in ends]
        return in_batches(lambda some: model.logprobs(state, some, answer), ends, batch, model.full)

    def token_entropies(prefix: list[int], flat: list[int]) -> list[float]:
        state, out = model.start(prefix) if shared_prefix else None, []
        for at in range(0, len(flat), chunk):
            some = flat[at : at + chunk]
            if state is None:
                got, _ = model.entropies(None, prefix + flat[: at + len(some)], len(some))
            else:
                got, state = model.entropies(state, some, len(some))
            out += got
        return out

    def score(question: str, answer: str, context: str, reasoning: str) -> dict:
        flat: list[int] = []
        ends: list[int] = []
        for part in filter(None, map(str.strip, reasoning.strip().split(SEPARATOR))):
            flat += (between if ends else []) + model.encode(part)
            ends.append(len(flat))
        tokens = model.encode(answer)
        if not flat or not tokens:
            raise ValueError("answer or trace has no token")
        steps = sampled(len(ends)) if curve else [0, len(ends)]
        stops = [ends[s - 1] if s else 0 for s in steps]
        logs = [x / math.log(10) for x in answer_curve(model.chat(question) + opening, [flat[:n] for n in stops], tokens)]
        out = {"reason_tokens": list(map(str, flat)), "ans_tokens": list(map(str, tokens)), "end_pos": ends, "log10p_base": logs[0], "log10p_final": logs[-1], "entropies": token_entropies(model.chat(context) + opening, flat)}
        return {**out, "curve": list(zip(steps, stops, logs))} if curve else out

    return score


class TransformersModel:
    """A local checkpoint of the transformers library, in bfloat16, with fast attention if it is installed.

    Code that comes with a checkpoint is not run. Not tested here, where neither
    the library nor a checkpoint is; the procedure around it is.
    """

    def __init__(self, path: str):
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        self.torch, self.full = torch, torch.cuda.OutOfMemoryError
        self.device = "cuda" if torch.cuda.is_available() else "cpu"
        self.tokenizer = AutoTokenizer.from_pretrained(path)
        load = lambda **kw: AutoModelForCausalLM.from_pretrained(path, torch_dtype=torch.bfloat16, low_cpu_mem_usage=True, **kw)
        try:
            self.model = load(attn_implementation="flash_attention_2")
        except (ImportError, ValueError, RuntimeError):
            self.model = load()
        self.model.to(self.device).eval()
        self.limit = getattr(self.model.config, "max_position_embeddings", None)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer(text, add_special_tokens=False)["input_ids"]

    def chat(self, user: str) -> list[int]:
        return self.encode(chat_text(self.tokenizer, [{"role": "user", "content": user}]))

    def _run(self, state: Any, rows: Sequence[Sequence[int]], keep: bool) -> Any:
        torch = self.torch
        width, before = max(map(len, rows)), 0 if state is None else state.get_seq_length()
        ids = torch.zeros((len(rows), width), dtype=torch.long)
        seen = torch.zeros((len(rows), before + width), dtype=torch.long)
        for i, r in enumerate(rows):
            ids[i, : len(r)] = torch.tensor(r)
            seen[i, : before + len(r)] = 1
        past = None
        if state is not None:
            past = copy.deepcopy(state)  # a cache grows in place
            past.batch_repeat_interleave(len(rows))
        with torch.no_grad():
            return self.model(input_ids=ids.to(self.device), attention_mask=seen.to(self.device), past_key_values=past, use_cache=keep)

    def start(self, prefix: Sequence[int]) -> Any:
        past = self._run(None, [prefix], True).past_key_values
        return past if hasattr(past, "batch_repeat_interleave") and hasattr(past, "get_seq_length") else None

    def logprobs(self, state: Any, prompts: Sequence[Sequence[int]], answer: Sequence[int]) -> list[float]:
        torch, answer = self.torch, list(answer)
        logits = self._run(state, [[*p, *answer] for p in prompts], False).logits
        target = torch.tensor(answer, device=logits.device)[:, None]
        return [float(torch.log_softmax(logits[i, len(p) - 1 : len(p) - 1 + len(answer)].float(), -1).gather(1, target).sum()) for i, p in enumerate(prompts)]

    def entropies(self, state: Any, tokens: Sequence[int], of: int) -> tuple[list[float], Any]:
        out = self._run(state, [tokens], True)
        logp = self.torch.log_softmax(out.logits[0, len(tokens) - of :].float(), -1)
        return (-(logp.exp() * logp).sum(-1)).tolist(), out.past_key_values


def chat_text(tokenizer: Any, messages: list[dict]) -> str:
    """Messages in the tokenizer's own chat template, thinking off where it knows of it; the literal format without a template."""
    template = getattr(tokenizer, "apply_chat_template", None)
    if template is None:
        return "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages) + "<|im_start|>assistant\n"
    try:
        return template(messages, tokenize=False, add_generation_prompt=True, enable_thinking=False)
    except TypeError:
        return template(messages, tokenize=False, add_generation_prompt=True)


def transformers_scorer(path: str, shared_prefix: bool = True) -> Callable[[], Callable[[str, str, str, str], dict]]:
    """What :class:`mooring.operators.scoring.ModelScorer` takes, for a local checkpoint."""
    return lambda: trace_scorer(TransformersModel(path), shared_prefix)
