"""Explicit schemas of the records; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
TEXTS = T.MapType(_S, _S)
SECTIONS = ("questions", "answers", "contexts", "reasonings")

#: Customary order of the methods in tables.
MAIN_METHODS = ("NEU", "SUP", "AUG-SUP", "SSR")
CONTROL_METHODS = ("Real CoT", "+Prob Anchor", "+Entropy Anchor", "Response as CoT")
ZONES = ("Reason", "Encode", "Cloze", "Copy")
DEFAULT_METHOD = "R0"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


METRIC_ROW = _struct(id=_S, **{s: TEXTS for s in SECTIONS})
MESSAGE = _struct(role=_S, content=_S, value=_S).add("from", _S)
CONVERSATION_ROW = _struct(id=_S, reasoning_trace=_S, conversations=T.ArrayType(MESSAGE))
RAW_GENERATION = _struct(row_idx=_I, id=_S, method=_S, raw_output=_S, finish_reason=_S, output_tokens=_I, prompt_chars=_I, prompt_context_chars=_I, source_method=_S)
REQUEST = _struct(row_idx=_I, sample_id=_S, method=_S, prompt=_S, prompt_context=_S, source_method=_S)
METRIC_RECORD = _struct(method=_S, sample_idx=_L, lexical_anchoring=_D, entropy_anchoring=_D, Aprob=_D)
SCORED = _struct(sample_idx=_L, method=_S, reason_tokens=T.ArrayType(_S), ans_tokens=T.ArrayType(_S), end_pos=T.ArrayType(_I), log10p_base=_D, log10p_final=_D, entropies=T.ArrayType(_D), error=_S)
