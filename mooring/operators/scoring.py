"""Scoring traces: the model boundary, the offline surrogate and the sample gate.

A scorer turns long rows into the scored frame (``schemas.SCORED``): tokens, step
ends, decimal log-likelihood of the answer without and with the trace, and the
entropy of each trace token. Everything after it is plain expressions.

The surrogate is deterministic SQL over word frequencies. Its values are *not*
those of a language model; they only have their shape.
"""

from __future__ import annotations

import sys
import traceback
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooring.functions import metrics as M
from mooring.functions import text as X
from mooring.functions.lcs import lcs_recall
from mooring.schemas import SCORED
from mooring.session import cut


class Scorer(Protocol):
    def score(self, long: DataFrame) -> DataFrame: ...


def scoreable(long: DataFrame) -> DataFrame:
    """Rows worth a model call: question, answer and trace not empty, with a token each.

    Kept in front of the scorer by hand, as no filter can be pushed through it.
    """
    full = lambda c: X.text(F.col(c)) != ""
    return long.where(full("question") & full("answer") & full("reasoning") & X.has_word(F.col("answer")) & X.has_word(F.col("reasoning")))


def entropy_context(context: Column, question: Column) -> Column:
    """What entropies are conditioned on: the context, or the question if it is blank."""
    return F.when(X.blank(context), X.text(question)).otherwise(context)


def token_counts(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., size, token, n, c``: how often each word is in the answer (n) and the trace (c).

    ``size``: words of the trace. One explode and one shuffle for both texts, each
    distinct word of a text being one row.
    """
    both = F.concat(F.transform("a", lambda w: F.concat(F.lit("a"), w)), F.transform("r", lambda w: F.concat(F.lit("r"), w)))
    # the size is worked out below the explode, else it would be once for each word
    texts = long.select(*keys, X.words(F.col("answer")).alias("a"), X.words(F.col("reasoning")).alias("r"))
    words = texts.select(*keys, F.size("r").alias("size"), both.alias("w")).select(*keys, "size", F.explode("w").alias("w"))
    mine = F.left("w", F.lit(1)) == "a"
    return words.groupBy(*keys, "size", F.substring("w", 2, 2**31 - 1).alias("token")).agg(F.count_if(mine).alias("n"), F.count_if(~mine).alias("c"))


def word_shares(long: DataFrame, *texts: str) -> DataFrame:
    """``token, share`` over the words of all texts of the columns ``texts``.

    Words are counted where they lie before they are shuffled. The result is cut
    off from its lineage, as it is looked at more than once and is the vocabulary
    only.
    """
    every = F.concat(*[X.words(F.col(c)) for c in texts])
    each = long.select(F.explode(every).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = cut(each)
    total = each.agg(F.sum("n").alias("of"))
    return each.crossJoin(F.broadcast(total)).select("token", (F.col("n") / F.col("of")).alias("share"))  # one row


#: Words that may be broadcast.
BROADCAST_WORDS = 200_000


def with_share(rows: DataFrame, shares: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """``rows`` joined with the share of their ``token``; no word is a hot key.

    A vocabulary of at most ``most`` words is broadcast. Of a larger one the words
    with a share of at least ``1 / most`` are, of which there can't be more than
    ``most`` whatever the data; the rest, none of which has more of the rows than
    that, is joined by a shuffle.
    """
    if shares.count() <= most:
        return rows.join(F.broadcast(shares), "token")
    often, rare = shares.where(F.col("share") >= 1 / most), shares.where(F.col("share") < 1 / most)
    hit = rows.join(F.broadcast(often), "token")
    return hit.unionByName(rows.join(F.broadcast(often.select("token")), "token", "left_anti").join(rare, "token"))


def likelihoods(counts: DataFrame, shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., n, base, final``: natural log-likelihood of the answer's words.

    ``base`` by their shares alone, ``final`` by the mean of their share and their
    frequency in the trace. ``counts`` of :func:`token_counts`.
    """
    j = with_share(counts.where("n > 0"), shares).withColumn("p", 0.5 * F.col("c") / F.col("size") + 0.5 * F.col("share"))
    return j.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("share")).alias("base"), F.sum(F.col("n") * F.log("p")).alias("final"))


def trace_tokens(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., pos, step, token``: the words of each trace; ``step`` counts from 1, ``pos`` from 0."""
    each = F.flatten(F.transform(X.steps(F.col("reasoning")), lambda s, i: F.transform(X.words(s), lambda w: F.struct((i + 1).alias("step"), w.alias("token")))))
    return long.select(*keys, F.posexplode(each).alias("pos", "x")).select(*keys, "pos", "x.step", "x.token")


def mean_surprisals(tokens: DataFrame, shares: DataFrame, keys: Sequence[str], segment: Column) -> DataFrame:
    """``keys..., segment, entropy``: mean of -ln share, the entropy stand-in, over the words of each segment of a trace.

    The words of a trace lie together, so a task sends on one row a segment.
    """
    return with_share(tokens.select(*keys, segment.alias("segment"), "token"), shares).groupBy(*keys, "segment").agg(F.avg(-F.log("share")).alias("entropy"))


def segment_lists(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., v``: the segments of each trace in order, as an array of ``segment, entropy``."""
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("segment", "entropy"))).alias("v"))


class SurrogateScorer:
    """Scored frame from word shares; ``keys`` identify a trace.

    Each word has the entropy of its step, the mean surprisal of the step's words.
    """

    def __init__(self, keys: Sequence[str] = ("sample_idx", "method")):
        self.keys = list(keys)

    def _parts(self, long: DataFrame) -> tuple[DataFrame, DataFrame]:
        k = self.keys
        likely = likelihoods(token_counts(long, k), word_shares(long, "answer", "reasoning"), k)
        means = mean_surprisals(trace_tokens(long, k), word_shares(long, "reasoning"), k, F.col("step"))
        return likely, segment_lists(means, k)

    def score(self, long: DataFrame) -> DataFrame:
        k = self.keys
        likely, steps = self._parts(long)
        base = long.select(*k, X.words(F.col("answer")).alias("ans_tokens"), F.transform(X.steps(F.col("reasoning")), X.words).alias("_steps"))
        base = base.select(*k, F.flatten("_steps").alias("reason_tokens"), "ans_tokens", F.transform("_steps", lambda s: F.size(s)).alias("_sizes"))
        # a step of marks only has no words and no entropy
        of_step = lambda i: F.get(F.filter("v", lambda x: x["segment"] == i + 1), F.lit(0))["entropy"]
        entropies = F.flatten(F.transform("_sizes", lambda n, i: F.array_repeat(of_step(i), n)))
        out = base.join(likely, k, "left").join(steps, k, "left")
        return out.select(*k, "reason_tokens", "ans_tokens", M.step_ends(F.col("_sizes")).alias("end_pos"), M.ln_to_log10(F.col("base")).alias("log10p_base"), M.ln_to_log10(F.col("final")).alias("log10p_final"), entropies.alias("entropies"), F.lit(None).cast("string").alias("error"))

    def records(self, long: DataFrame) -> DataFrame:
        """The metric records of :meth:`score`, without shuffling a text or a token: three narrow frames are joined."""
        k = self.keys
        likely, steps = self._parts(long)
        bits = lambda c: M.bits_per_token(M.ln_to_log10(F.col(c)), F.col("n"))
        lexical = long.select(*k, lcs_recall(X.words(F.col("answer")), X.words(F.col("reasoning"))).alias("lexical_anchoring"))
        later = F.transform(F.filter("v", lambda x: x["segment"] > 1), lambda x: x["entropy"])
        prob = likely.select(*k, M.probabilistic_anchoring(bits("base"), bits("final")).alias("Aprob"))
        entropic = steps.select(*k, M.entropy_of_means(later).alias("_e"))
        return lexical.join(prob, k, "left").join(entropic, k, "left").select(*k, "lexical_anchoring", F.coalesce("_e", F.lit(0.0)).alias("entropy_anchoring"), "Aprob")


class ModelScorer:
    """Scored frame from a causal language model, built once a Python task.

    ``make()`` returns ``score(question, answer, context, reasoning) -> dict`` with
    the fields of the scored frame (see :mod:`mooring.operators.model`). An exception
    becomes the row's ``error`` instead of failing the job; ``debug`` prints it too.
    """

    def __init__(self, make: Callable[[], Callable[[str, str, str, str], dict]], debug: bool = False):
        self.make, self.debug = make, debug

    def score(self, long: DataFrame) -> DataFrame:
        make, debug = self.make, self.debug
        names = [f.name for f in SCORED if f.name not in ("sample_idx", "method", "error")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one = make()
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    try:
                        got, error = one(r.question, r.answer, r.context, r.reasoning), None
                    except Exception as e:  # noqa: BLE001
                        got, error = {}, f"{type(e).__name__}: {e}"
                        if debug:
                            print(f"sample {r.sample_idx}, method {r.method}: {error}", file=sys.stderr)
                            traceback.print_exc()
                    rows.append({"sample_idx": r.sample_idx, "method": r.method, **{n: got.get(n) for n in names}, "error": error})
                yield pd.DataFrame(rows, columns=[f.name for f in SCORED])

        return long.select("sample_idx", "method", "question", "answer", entropy_context(F.col("context"), F.col("question")).alias("context"), "reasoning").mapInPandas(run, SCORED)


def score_records(scorer: Scorer, long: DataFrame) -> DataFrame:
    """Metric records by a scorer, on its own short way if it has one."""
    return scorer.records(long) if hasattr(scorer, "records") else records(scorer.score(long))


def records(scored: DataFrame, keys: Sequence[str] = ("sample_idx", "method")) -> DataFrame:
    """Metric records of a scored frame; rows with an error have null metrics.

    ``keys..., lexical_anchoring, entropy_anchoring, Aprob``.
    """
    n = F.size("ans_tokens")
    aprob = M.probabilistic_anchoring(M.bits_per_token(F.col("log10p_base"), n), M.bits_per_token(F.col("log10p_final"), n))
    ok = F.col("error").isNull()
    return scored.select(
        *keys,
        F.when(ok, lcs_recall(F.col("ans_tokens"), F.col("reason_tokens"))).alias("lexical_anchoring"),
        F.when(ok, M.entropy_anchoring(F.col("entropies"), F.col("end_pos"))).alias("entropy_anchoring"),
        F.when(ok, aprob).alias("Aprob"),
    )


def gate(recs: DataFrame, keys: Sequence[str] = ("sample_idx",), values: Sequence[str] = ("lexical_anchoring", "entropy_anchoring", "Aprob")) -> DataFrame:
    """Records of the samples all of whose records are finite.

    The few bad samples are subtracted, so nothing is grouped: a sample with a
    large share of all rows is one row on the other side of the join.
    """
    bad = recs.where(~M.all_finite(*[F.col(v) for v in values])).select(*keys).distinct()
    return recs.join(bad, list(keys), "left_anti")


def gate_counts(long: DataFrame, recs: DataFrame, samples: DataFrame, key: str = "sample_idx") -> DataFrame:
    """One row ``total, valid, discarded``; samples without any method are in the total only."""
    valid = gate(recs, [key]).select(key).distinct().withColumn("v", F.lit(1))
    with_method = long.select(key).distinct().withColumn("m", F.lit(1))
    j = samples.select(key).join(with_method, key, "left").join(valid, key, "left")
    return j.agg(F.count("*").alias("total"), F.count("v").alias("valid"), F.count_if(F.col("m").isNotNull() & F.col("v").isNull()).alias("discarded"))


def valid_data(samples: DataFrame, recs: DataFrame, key: str = "sample_idx") -> DataFrame:
    """The input rows of the accepted samples, untouched."""
    return samples.join(gate(recs, [key]).select(key), key, "left_semi")


def shard(rows: DataFrame, world: int, rank: int, key: str = "sample_idx") -> DataFrame:
    """Rows of one of ``world`` round-robin shards."""
    return rows.where(F.pmod(F.col(key), F.lit(world)) == rank)
