"""Mergeable percentiles of very large columns (problem 1).

A sketch is a hierarchy of compactors: level ``h`` holds values that stand for
``2**h`` stored ones each. A level over its capacity is sorted and every other
value, the odd or the even ones by a random bit, moves one level up. Sketches
merge levelwise. Capacities fall by 2/3 a level below the top one, which has
``k`` values.

Error: for each percentile asked, the *rank* of the answer is off by at most
``rank_error(k)`` of the number of finite values with probability 0.99, however
the rows were split and merged (proof there). Up to ``k`` values the answer is exact.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Capacity of the top level.
K = 8192
#: Parts of a group that become one at each level of merging.
FAN_IN = 64
#: Values a task may hold before it sends its sketches on half-filled, and merged ones it hands out at once.
OPEN_VALUES, OUT_VALUES = 1 << 22, 1 << 20
#: Parts finished sketches of a group are spread over before they are merged.
SPREAD_PARTS = FAN_IN**2
#: Rows grouped at once when sketches are built.
TAKE_ROWS = 1 << 17
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
_HEAD = struct.Struct("<qiI")


def rank_error(k: int = K) -> float:
    """Bound on the rank error of one percentile (share of the values), at 99 %.

    A compaction of level ``h`` leaves the estimated rank of any point as it is, or
    moves it by ``2**h`` up or down with equal chance, independently of the others.
    With ``H`` the top level in the end, level ``h < H`` had a capacity of at least
    ``k (2/3)**(H-h)`` at all times, so it was compacted at most ``n / (2**h
    capacity)`` times, as no more than the weight ``n`` passes it and each
    compaction takes a full level of weight ``2**h`` a value. The squares of all
    moves sum to at most ``(n/k) 2**H ((3/4) + (3/4)**2 + ...) = 3 (n/k) 2**H``.
    Level ``H`` exists because more than ``k`` values of weight ``2**(H-1)`` stood
    on the level below, so ``2**H < 2n/k``: the sum is below ``6 (n/k)**2``.
    Merging changes none of these counts. By Hoeffding's inequality the moves add
    up to more than ``sqrt(2 ln(2/0.01) 6) n/k`` with a chance of at most 0.01.
    """
    return math.sqrt(12 * math.log(2 / 0.01)) / k


class Sketch:
    """One compactor hierarchy over finite doubles."""

    __slots__ = ("k", "levels", "n", "state")

    def __init__(self, k: int = K, seed: int = 0):
        self.k, self.levels, self.n, self.state = k, [np.empty(0)], 0, (seed & 0xFFFFFFFF) or 1

    def _capacity(self, level: int) -> int:
        return max(8, int(np.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - level))))

    def _bit(self) -> int:
        x = self.state
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        self.state = x
        return (x >> 11) & 1

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            own = self.levels[h]
            if len(own) > self._capacity(h):
                own = np.sort(own)
                keep = own[len(own) & ~1 :]
                up = own[: len(own) & ~1][self._bit() :: 2]
                self.levels[h] = keep
                if h + 1 == len(self.levels):
                    self.levels.append(up)
                    h = -1  # a new top level lowers every capacity below it
                else:
                    self.levels[h + 1] = np.concatenate([self.levels[h + 1], up])
            h += 1

    def update(self, values: np.ndarray) -> None:
        """Adds finite values, any number at once."""
        self.n += len(values)
        for at in range(0, len(values), 8 * self.k):
            self.levels[0] = np.concatenate([self.levels[0], values[at : at + 8 * self.k]])
            self._compress()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
        for h, own in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], own])
        self.state = zlib.crc32(struct.pack("<II", self.state, other.state)) or 1
        self._compress()

    def quantiles(self, ps: Sequence[float]) -> np.ndarray:
        """The least held value whose estimated rank reaches ``p * n``, for each p."""
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 2**h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        ranks = np.cumsum(w[order])
        at = np.searchsorted(ranks, np.maximum(1, np.ceil(np.asarray(ps) * ranks[-1])))
        return v[order][np.minimum(at, len(v) - 1)]

    def held(self) -> int:
        return sum(map(len, self.levels))

    def pack(self) -> bytes:
        sizes = np.array([len(x) for x in self.levels], dtype="<i4")
        return _HEAD.pack(self.n, self.k, self.state) + struct.pack("<i", len(sizes)) + sizes.tobytes() + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Sketch:
        n, k, state = _HEAD.unpack_from(raw)
        (levels,) = struct.unpack_from("<i", raw, _HEAD.size)
        at = _HEAD.size + 4
        sizes = np.frombuffer(raw, "<i4", levels, at)
        values = np.frombuffer(raw, "<f8", -1, at + 4 * levels)
        out = cls(k)
        out.n, out.state, out.levels = n, state, np.split(values, np.cumsum(sizes)[:-1])
        return out


def _same(key: tuple) -> tuple:
    """A key that equals itself even if it has NaN in it."""
    return tuple("NaN" if x != x else x for x in key)


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their keys (all columns of ``table``), and where each key starts."""
    code = np.zeros(table.num_rows, np.int64)
    for c in table.columns:
        c = c.combine_chunks()
        own = pc.fill_null(c.dictionary_encode().indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False) + 1
        _, code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)
    order = np.argsort(code, kind="stable")
    return order, np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1]) if len(order) else np.empty(0, np.int64)


def _partial(n_keys: int, fields: list[str], k: int, schema: pa.Schema):
    """Arrow batches of keys and doubles to ``(keys, field, part, n_rows, sketch)``, bounded in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(*key, field, part, n, s.pack()) for key, field, n, s in held.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def take(some: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(some)
            order, starts = _rows(t.select(range(n_keys)))
            values = [c.to_numpy().astype("float64") if not c.null_count else pc.fill_null(c, float("nan")).to_numpy() for c in t.columns[n_keys:]]
            for a, b in zip(starts, [*starts[1:], len(order)]):
                at = order[a:b]
                key = tuple(t.column(i)[int(at[0])].as_py() for i in range(n_keys))
                for field, v in zip(fields, values):
                    cell = held.get((_same(key), field))
                    if cell is None:
                        cell = held[_same(key), field] = [key, field, 0, Sketch(k, zlib.crc32(repr((part, key, field)).encode()))]
                    cell[2] += len(at)
                    own = v[at]
                    cell[3].update(own[np.isfinite(own)])

        some, n = [], 0
        for batch in batches:
            some.append(batch)
            n += batch.num_rows
            if n >= TAKE_ROWS:
                take(some)
                some, n = [], 0
                if sum(8 + x[3].held() for x in held.values()) > OPEN_VALUES:
                    yield out()
        if n:
            take(some)
        if held:
            yield out()

    return run


def _merge(n_keys: int, schema: pa.Schema):
    """Sorted rows ``keys..., field, part, n_rows, sketch`` to one for each run of equal keys, field and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        own, at, n, raw, sketch, size = None, None, 0, b"", None, 0

        def close() -> None:
            nonlocal size
            if own is not None:
                done.append((*at, n, raw if sketch is None else sketch.pack()))
                size += len(done[-1][-1]) // 8

        def out() -> pa.RecordBatch:
            nonlocal size
            rows, done[:], size = list(done), [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for *key, more, blob in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(key)
                if _same(key) == own:
                    sketch = sketch or Sketch.unpack(raw)
                    sketch.merge(Sketch.unpack(blob))
                    n += more
                else:
                    close()
                    own, at, n, raw, sketch = _same(key), key, more, blob, None
                if size >= OUT_VALUES:
                    yield out()
        close()
        if done:
            yield out()

    return run


def merge_sketches(parts: DataFrame, keys: Sequence[str], n_parts: int | None = None) -> DataFrame:
    """Sketches merged to one a (keys, field), by a tree of fan-in FAN_IN.

    ``parts`` has the columns of :func:`sketches`; ``keys`` may be fewer than
    those it was built with: results of days or runs merge to that of the whole.
    ``n_parts``: the number of different ``part`` values; without it (finished
    sketches, whose ``part`` says nothing) the sketches of a group are numbered
    anew by their content, so a group of very many is merged by many tasks too.
    """
    keys = list(keys)
    part = F.col("part") if n_parts is not None else F.pmod(F.xxhash64("n_rows", "sketch"), F.lit(SPREAD_PARTS)).cast("int")
    parts = parts.select(*keys, "field", part.alias("part"), "n_rows", "sketch")
    span, schema = SPREAD_PARTS if n_parts is None else n_parts, parts.schema
    merge = _merge(len(keys) + 2, to_arrow_schema(schema))
    while True:
        span = -(-span // FAN_IN)
        # the old part and the content order the sketches, so a rerun merges them alike
        parts = parts.withColumn("_from", F.col("part")).withColumn("part", F.floor(F.col("part") / F.lit(FAN_IN)).cast("int"))
        parts = parts.repartition(*keys, "field", "part").sortWithinPartitions(*keys, "field", "part", "_from", "n_rows", F.xxhash64("sketch")).drop("_from").mapInArrow(merge, schema)
        if span <= 1:
            return parts


def sketches(df: DataFrame, keys: Sequence[str], fields: Sequence[str], k: int = K) -> DataFrame:
    """One sketch for each (keys, field): ``keys..., field, part, n_rows, sketch BINARY``.

    Every stored row counts once, repeated rows too; null keys are a group of
    their own; null, NaN and infinite values count in ``n_rows`` only. Built
    where the rows lie; only sketches (at most about 3 k doubles) are shuffled,
    so a group with a third of all rows costs its merging task no more than any
    other. An empty table gives no rows; other columns are not read.
    """
    keys, fields = list(keys), list(fields)
    narrow = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(fields)])
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keys)] + [T.StructField("field", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("n_rows", T.LongType()), T.StructField("sketch", T.BinaryType())])
    parts = narrow.mapInArrow(_partial(len(keys), fields, k, to_arrow_schema(schema)), schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keys)})
    return merge_sketches(parts, keys, narrow.rdd.getNumPartitions())


def percentiles(merged: DataFrame, keys: Sequence[str], ps: Sequence[float] = PERCENTILES) -> DataFrame:
    """``keys..., field, n_rows, n_finite, p, value, max_rank_error`` of merged sketches.

    A group without a finite value has one row a percentile with a null value.
    """
    keys, ps = list(keys), list(ps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, field, n_rows, raw in pdf[[*keys, "field", "n_rows", "sketch"]].itertuples(index=False, name=None):
                s = Sketch.unpack(raw)
                vs = s.quantiles(ps) if s.n else [None] * len(ps)
                rows += [(*key, field, n_rows, s.n, p, v, 0.0 if s.n <= s.k else rank_error(s.k)) for p, v in zip(ps, vs)]
            yield pd.DataFrame(rows, columns=[*keys, "field", "n_rows", "n_finite", "p", "value", "max_rank_error"])

    schema = T.StructType([merged.schema[c] for c in keys] + [merged.schema["field"]] + [T.StructField(n, t) for n, t in (("n_rows", T.LongType()), ("n_finite", T.LongType()), ("p", T.DoubleType()), ("value", T.DoubleType()), ("max_rank_error", T.DoubleType()))])
    return merged.mapInPandas(run, schema)


#: Parts the estimates and the values of a group are spread over to be compared.
CHECK_PARTS = 16


def rank_check(df: DataFrame, estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Estimates against exact ranks: ``keys..., field, p, n_finite, value, within``.

    ``within``: the share of finite values below the estimate and the share up to
    it enclose ``p`` up to the stated error, and none is missing. Each finite value
    is placed among the estimates of its group once, and only counts of places are
    grouped. Groups are spread by the value's hash, so a hot one is many tasks.
    """
    keys = list(keys)
    fields = [r[0] for r in estimates.select("field").distinct().collect()]  # as many as columns were asked for
    est = estimates.groupBy(*keys, "field", "n_finite", "max_rank_error").agg(F.array_sort(F.collect_list(F.struct("p", "value"))).alias("e"))
    est = est.select(*[F.col(c).alias(f"e{i}") for i, c in enumerate(keys)], F.col("field").alias("ef"), "n_finite", "max_rank_error", "e", F.explode(F.sequence(F.lit(0), F.lit(CHECK_PARTS - 1))).alias("es"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields] or [F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("x"))])
    values = df.select(*keys, F.explode(each).alias("_v")).select(*keys, "_v.field", "_v.x").where(~F.isnan("x") & (F.abs("x") != float("inf")))
    counts = values.groupBy(*keys, "field", "x").agg(F.count("*").alias("n")).withColumn("s", F.pmod(F.xxhash64("x"), F.lit(CHECK_PARTS)).cast("int"))
    cond = (F.col("field") == F.col("ef")) & (F.col("s") == F.col("es"))
    for i, c in enumerate(keys):
        cond = cond & F.col(c).eqNullSafe(F.col(f"e{i}"))
    own = [*keys, "field", "n_finite", "max_rank_error", "e"]
    placed = counts.join(est, cond).withColumns({"lo": F.size(F.filter("e", lambda y: y["value"] <= F.col("x"))), "hi": F.size(F.filter("e", lambda y: y["value"] < F.col("x")))})
    g = placed.groupBy(*own, "lo", "hi").agg(F.sum("n").alias("n")).groupBy(*own).agg(F.collect_list(F.struct("lo", "hi", "n")).alias("c"))
    total = lambda test: F.aggregate(F.filter("c", test), F.lit(0).cast("bigint"), lambda a, y: a + y["n"])
    g = g.select(*own, total(lambda y: F.lit(True)).alias("n"), "c", F.posexplode("e").alias("i", "y"))
    low, high = total(lambda y: y["lo"] <= F.col("i")) / F.col("n"), total(lambda y: y["hi"] <= F.col("i")) / F.col("n")
    slack = F.col("max_rank_error") + 1.0 / F.col("n")
    return g.select(*keys, "field", F.col("y.p").alias("p"), "n_finite", F.col("y.value").alias("value"), ((F.col("n") == F.col("n_finite")) & (low <= F.col("y.p") + slack) & (high >= F.col("y.p") - slack)).alias("within"))
