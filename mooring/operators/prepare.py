"""Reshaping and preparing metric rows: wide and long form, validation, conversion, variants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.functions import text as X
from mooring.schemas import CONTROL_METHODS, SECTIONS, TEXTS


def to_long(rows: DataFrame, key: str = "sample_idx", position: str = "method_pos") -> DataFrame:
    """One row for each key of ``questions``, in key order, with the four texts of that method.

    Null or empty questions give no row; missing keys and null maps give null texts.
    Look-ups by key in the other maps need no join.
    """
    return rows.select(*[c for c in (key, "id") if c in rows.columns], F.posexplode(F.map_keys("questions")).alias(position, "method"), *SECTIONS).select(
        *[c for c in (key, "id") if c in rows.columns], position, "method", *[F.try_element_at(F.col(s), F.col("method")).alias(s[:-1]) for s in SECTIONS]
    )


def first_failure(methods: Sequence[str]) -> Column:
    """Why a metric row is invalid for ``methods``; null for valid rows.

    Sections are tried in order: a null map, then methods whose text is blank.
    """

    def of(section: str) -> Column:
        m = F.col(section)
        missing = F.filter(F.array(*[F.lit(x) for x in methods]), lambda x: X.blank(F.try_element_at(m, x)))
        return F.when(m.isNull(), F.lit(f"missing dict section: {section}")).when(F.size(missing) > 0, F.concat(F.lit(f"section {section} missing methods: "), F.array_join(missing, ",")))

    return F.coalesce(*[of(s) for s in SECTIONS]) if methods else F.coalesce(*[F.when(F.col(s).isNull(), F.lit(f"missing dict section: {s}")) for s in SECTIONS])


def validate(rows: DataFrame, methods: Sequence[str], strict: bool = False) -> DataFrame:
    """The valid rows, whole. ``strict``: the first invalid row fails the job instead."""
    why = first_failure(methods)
    if strict:
        who = F.coalesce(F.col("id"), F.lit("?")) if "id" in rows.columns else F.lit("?")
        return rows.where(F.when(why.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row "), who, F.lit(" invalid: "), why)).cast("boolean")))
    return rows.where(why.isNull())


def validation_counts(rows: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row ``total, written, skipped``."""
    bad = first_failure(methods).isNotNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(~bad).alias("written"), F.count_if(bad).alias("skipped"))


def _filled(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, [~X.blank(c) for c in cs])


def convert(traces: DataFrame, method: str, key: str = "row_idx") -> DataFrame:
    """Conversation rows to one-method metric rows; rows without question, answer or trace go.

    The context is the whole conversation. A null id becomes the key's text.
    """
    qa = X.question_answer(F.col("conversations"))
    flat = traces.select(key, F.coalesce("id", F.col(key).cast("string")).alias("id"), qa["question"].alias("q"), qa["answer"].alias("a"), X.format_conversation(F.col("conversations")).alias("c"), X.text(F.col("reasoning_trace")).alias("r"))
    kept = flat.where(_filled(F.col("q"), F.col("a"), F.col("r")))
    return kept.select(key, "id", *[F.create_map(F.lit(method), F.col(c)).alias(s) for s, c in zip(SECTIONS, "qacr")])


def controlled(rows: DataFrame, base: str, key: str = "sample_idx") -> DataFrame:
    """Four variants of the base method's trace, each built to move one metric.

    Long form ``key, id, method_pos, method, question, answer, context, reasoning``;
    an empty context falls back to the question; rows without question, answer or
    trace go.
    """
    at = lambda s: X.text(F.try_element_at(F.col(s), F.lit(base)))
    flat = rows.select(key, F.coalesce("id", F.col(key).cast("string")).alias("id"), *[at(s).alias(s[:-1]) for s in SECTIONS]).where(_filled(F.col("question"), F.col("answer"), F.col("reasoning")))
    r, a = F.col("reasoning"), F.col("answer")
    traces = F.array(r, F.concat(r, F.lit("\n\n"), a), X.function_word_skeleton(a), a)
    return (
        flat.select(key, "id", "question", "answer", F.when(F.col("context") != "", F.col("context")).otherwise(F.col("question")).alias("context"), F.posexplode(traces).alias("method_pos", "reasoning"))
        .withColumn("method", F.element_at(F.array(*[F.lit(m) for m in CONTROL_METHODS]), F.col("method_pos") + 1))
        .select(key, "id", "method_pos", "method", "question", "answer", "context", "reasoning")
    )


def to_wide(long: DataFrame, key: str = "sample_idx") -> DataFrame:
    """Long form back to maps in method order; null texts become empty ones.

    A method that comes twice in a sample keeps the text of its last position.
    """
    parts = F.array_sort(F.collect_list(F.struct("method_pos", "method", *[X.text(F.col(s[:-1])).alias(s[:-1]) for s in SECTIONS])))
    g = long.groupBy(key, "id").agg(parts.alias("_p"))
    last = F.filter(F.col("_p"), lambda x, i: ~F.exists(F.slice(F.col("_p"), i + 2, F.size("_p")), lambda y: y["method"] == x["method"]))
    return g.withColumn("_p", last).select(key, "id", *[F.map_from_arrays(F.col("_p.method"), F.col(f"_p.{s[:-1]}")).cast(TEXTS).alias(s) for s in SECTIONS])
