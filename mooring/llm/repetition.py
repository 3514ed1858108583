"""Repetition inside single texts (problem 4).

The repeated share of a text is the share of its letters that lie in a run of
:data:`RUN` letters which occurred earlier in it. Gradient-boosted trees estimate
it from cheap statistics of the text and tell cases from others. Their error is
measured in training, on texts left out of the trees: wherever it reaches, on both
sides of the threshold, the estimate is verified by hashing all runs of the text.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.common import TRAIN_CHARS, hash_sample, map_rows
from mooring.llm.trees import Forest, fit

RUN, LEAST_LETTERS, THRESHOLD = 30, 60, 0.33
#: Texts of each field read for training.
TRAIN_ROWS = 1500
#: Folds in which the error is measured, and what is added to it on both sides.
FOLDS, SLACK = 4, 0.08
#: Evenly spaced runs looked up in a text.
PROBES = 24
_OTHER = re.compile(r"[\W\d_]+")
#: Signs of the features: more of it never lowers (1) or never raises (-1) the estimate.
MONOTONE = [1, 1, 1, -1, -1, 0, 0]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def letters(text: str | None) -> str:
    """The letters of a text, lower-cased."""
    s = _OTHER.sub("", (text or "").lower())
    return s if s.isalpha() or not s else "".join(filter(str.isalpha, s))


def exact_share(s: str, run: int = RUN) -> float:
    """Repeated share of a string of letters; 0 if it has no two runs."""
    n = len(s)
    if n <= run:
        return 0.0
    h = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * _MIX[0]
    h ^= h >> np.uint64(29)
    width, got, offset, out = 1, run, 0, np.zeros(n - run + 1, np.uint64)
    level = 0
    while got:
        if got & 1:
            out = (out ^ h[offset : offset + n - run + 1]) * _MIX[(level % 4) + 1]
            out ^= out >> np.uint64(31)
            offset += width
        got >>= 1
        if got:
            h = h[: len(h) - width] * _MIX[level % 5] + (h[width:] ^ (h[width:] >> np.uint64(32)))
            width *= 2
            level += 1
    _, first, inv = np.unique(out, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[inv] < np.arange(len(out)))
    if not len(again):
        return 0.0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return float((np.cumsum(edge)[:n] > 0).mean())


def statistics(text: str, s: str) -> list[float]:
    """Features of a text and its letters ``s`` (at least LEAST_LETTERS of them)."""
    n = len(s)
    step = max(1, (n - RUN) // PROBES)
    at = range(n - RUN, 0, -step)
    probes = sum(s.find(s[i : i + RUN], 0, i + RUN - 1) >= 0 for i in at) / max(1, len(at))
    pieces = Counter(x for x in re.split(r"[.?!。？！\n]+", re.sub(r"[\d\s]+", " ", text.lower())) if len(x) > 12)
    total = sum(len(p) * c for p, c in pieces.items())
    twice = sum(len(p) * (c - 1) for p, c in pieces.items()) / max(1, total)
    top = max((len(p) * c for p, c in pieces.items() if c > 1), default=0) / max(1, total)
    raw = s.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / len(raw)
    words = text.lower().split()
    variety = len(set(words)) / max(1, len(words))
    return [probes, twice, top, packed, variety, math.log(n), len(raw) / n]


def loops(texts: list[str], seed: int = 5) -> list[str]:
    """Copies with a phrase, a sentence or a paragraph said again, to fill the sample."""
    rng, out = random.Random(seed), []
    for t in texts:
        if len(t) < 80:
            continue
        unit = rng.choice([lambda: rng.randrange(12, 40), lambda: rng.randrange(40, 120), lambda: len(t) // 2])()
        a = rng.randrange(0, max(1, len(t) - unit))
        times = rng.randrange(1, 12) if unit < 120 else rng.randrange(1, 3)
        out.append(t[: a + unit] + (rng.choice(["", " ", "\n"]) + t[a : a + unit]) * times + (t[a + unit :] if rng.random() < 0.7 else ""))
    return out


class Estimator(NamedTuple):
    """Trees and the band of estimates in which they may err: below ``low`` no text
    left out of the trees reached the threshold, above ``high`` each did."""

    forest: Forest
    low: float
    high: float
    error: float


def train(texts: list[str]) -> Estimator:
    """An estimator of the share, from texts and looped copies of them.

    ``error`` is the mean absolute error on texts left out. A text and its looped
    copies are in one fold, so none is known to the trees that estimate it. Without
    texts the band is everything.
    """
    xs, ys, of = [], [], []
    for i, t in enumerate(texts):
        for v in (t, *loops([t], i)):
            s = letters(v)
            if len(s) >= LEAST_LETTERS:
                xs.append(statistics(v, s))
                ys.append(exact_share(s))
                of.append(i)
    x, y, fold = np.array(xs), np.array(ys), np.array(of, dtype=int) % FOLDS
    forest = fit(x, y, MONOTONE)
    if len(set(of)) < FOLDS:
        return Estimator(forest, -np.inf, np.inf, np.inf)
    guess = np.empty(len(y))
    for f in range(FOLDS):
        guess[fold == f] = fit(x[fold != f], y[fold != f], MONOTONE).predict(x[fold == f])
    case = y >= THRESHOLD
    low = min(guess[case].min(initial=THRESHOLD), THRESHOLD) - SLACK
    high = max(guess[~case].max(initial=THRESHOLD), THRESHOLD) + SLACK
    return Estimator(forest, float(low), float(high), float(np.abs(guess - y).mean()))


def estimates(texts: list[str | None], est: Estimator) -> list[tuple[float | None, float | None]]:
    """``(estimate, verified share)`` of each text.

    The estimate is null for texts of fewer than LEAST_LETTERS letters, the verified
    share for all whose estimate is outside the band.
    """
    out: list = [(None, None)] * len(texts)
    kept = [(i, s) for i, s in ((i, letters(t)) for i, t in enumerate(texts)) if len(s) >= LEAST_LETTERS]
    if not kept:
        return out
    guess = est.forest.predict(np.array([statistics(texts[i], s) for i, s in kept]))
    for (i, s), g in zip(kept, guess):
        out[i] = (float(np.clip(g, 0, 1)), exact_share(s) if est.low <= g <= est.high else None)
    return out


def _both(fields: dict[str, DataFrame]) -> DataFrame:
    values = [df.select(F.lit(n).alias("field"), F.col("rec_id").cast("bigint").alias("rec_id"), "method", "text") for n, df in fields.items()]
    return reduce(DataFrame.unionByName, values)


def shares(fields: dict[str, DataFrame]) -> DataFrame:
    """The exact repeated share of every text: ``field, rec_id, method, share``.

    ``fields`` and the treatment of rows as in :func:`repeated`; null for texts of
    fewer than LEAST_LETTERS letters. A map over the scan.
    """

    def work(b: pa.RecordBatch) -> dict:
        own = [exact_share(s) if len(s) >= LEAST_LETTERS else None for s in map(letters, b.column(3).to_pylist())]
        return {"field": b.column(0), "rec_id": b.column(1), "method": b.column(2), "share": own}

    return map_rows(_both(fields), "field string, rec_id bigint, method string, share double", lambda: work, costly=True)


def repeated(fields: dict[str, DataFrame], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Repeated share of every text as the trees tell it: ``field, rec_id, method, estimate, verified, repeated``.

    ``fields``: name to a frame ``rec_id BIGINT, method STRING, text STRING``. Null,
    empty and short texts (fewer than LEAST_LETTERS letters) have null values and
    are not ``repeated``. ``verified``: the exact share, of every text whose
    estimate lies where the trees may err; it decides there, the estimate elsewhere.
    Whole texts count however long; repeated rows come out as often as they went
    in; other columns are dropped. No shuffle but that of the bounded sample.
    """
    both = _both(fields)
    kept = both.where(F.length("text").between(LEAST_LETTERS, TRAIN_CHARS)).withColumn("_k", F.xxhash64("rec_id", "method"))
    est = train(sorted({r.text for r in hash_sample(kept.select("field", "_k", "text"), "_k", train_rows, by="field").collect()}))

    def make():
        def work(b: pa.RecordBatch) -> dict:
            texts = b.column(3).to_pylist()
            rows = [x for i in range(0, len(texts), 1000) for x in estimates(texts[i : i + 1000], est)]
            estimate, verified = zip(*rows) if rows else ((), ())
            return {"field": b.column(0), "rec_id": b.column(1), "method": b.column(2), "estimate": estimate, "verified": verified}

        return work

    out = map_rows(both, "field string, rec_id bigint, method string, estimate double, verified double", make, costly=True)
    return out.withColumn("repeated", F.coalesce(F.coalesce("verified", "estimate") >= THRESHOLD, F.lit(False)))


def found(told: DataFrame) -> DataFrame:
    """``field, rec_id, method`` of the texts whose repeated share reaches the threshold."""
    return told.where("repeated").select("field", "rec_id", "method")
