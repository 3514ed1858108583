"""Filling containers of fixed capacity with items, best fit with few open bins (problem 7).

Every task packs the items of its own input online: at most ``OPEN_BINS`` bins
are open, kept in a bitset keyed by free space, so the tightest bin that still
takes an item is one shift and one lowest-bit search away; when no bin takes it
and all are in use, the fullest is closed. What is left in open bins at the end
of the tasks goes, as items, through the same step again in ever fewer tasks
(:data:`FAN_IN` to one), so the space a split of the data wastes vanishes while
no task ever sees more than ``FAN_IN * OPEN_BINS`` bins' worth of left-over items.
Every level packs online by the same rule, with the same number of open bins.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.llm.common import arrow_schema
from mooring.session import cut

#: Bins open at once in a task.
OPEN_BINS = 64
#: Tasks whose left-over items one task of the next level packs.
FAN_IN = 32


class Bins:
    """Bounded-space best fit over integer sizes, holding what lies in open bins.

    ``add`` and ``finish`` return final bins as ``(serial, items)``. A bin is
    final when it is full or closed to make room. An item larger than the
    capacity must be cut before. An item of size 0 is final at once: it goes to the
    bin that became final last; before there is one, the fullest closes for it.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.next, self.last = 0, 0, None
        self.at: dict[int, deque[int]] = {}  # free space: bins, oldest first
        self.held: dict[int, list] = {}  # bin: items

    def _take(self, free: int) -> int:
        bins = self.at[free]
        one = bins.popleft()
        if not bins:
            del self.at[free]
            self.bits &= ~(1 << free)
        return one

    def _fullest(self) -> int:
        return self._take((self.bits & -self.bits).bit_length() - 1)

    def _final(self, one: int) -> tuple[int, list]:
        self.last = one
        return one, self.held.pop(one)

    def add(self, item, size: int) -> list[tuple[int, list]]:
        out = []
        if not size:
            if self.last is None:
                if self.bits:
                    out.append(self._final(self._fullest()))
                else:
                    self.last, self.next = self.next, self.next + 1
            return [*out, (self.last, [item])]
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            one = self._take(free)
        else:
            if len(self.held) >= self.limit:
                out.append(self._final(self._fullest()))
            one, free = self.next, self.capacity
            self.next += 1
            self.held[one] = []
        self.held[one].append(item)
        if free == size:
            out.append(self._final(one))
        else:
            self.at.setdefault(free - size, deque()).append(one)
            self.bits |= 1 << (free - size)
        return out

    def finish(self) -> list[tuple[int, list]]:
        """The bins still open, fullest first; none is left."""
        out = [(b, self.held[b]) for free in sorted(self.at) for b in self.at[free]]
        self.at, self.held, self.bits = {}, {}, 0
        return out


def _level(rows, open_bins: int, level: int, task: int, keep: bool) -> Iterator[tuple]:
    """Packs the items of one task; ``keep``: nothing goes on to another level."""
    packers: dict[int, Bins] = {}
    for row in rows:
        spec, _, _, size, capacity = row
        b = packers.get(spec) or packers.setdefault(spec, Bins(capacity, open_bins))
        for one, items in b.add(row, size):
            for x in items:
                yield (*x, f"{level}-{task}-{one}", True)
    for b in packers.values():
        for one, items in b.finish():
            for x in items:
                yield (*x, f"{level}-{task}-{one}", keep)


_OUT = ["spec_id", "key", "piece", "size", "capacity", "container", "final"]


def _regroup(open_bins: int, level: int, keep: bool):
    """Packs the left-over items of one group, in the order of the bins they lay in, so a rerun packs them alike."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["spec_id", "container", "key", "piece"], kind="stable")
        rows = pdf[_OUT[:5]].itertuples(index=False, name=None)
        return pd.DataFrame(list(_level(rows, open_bins, level, int(key[1]), keep)), columns=_OUT)

    return run


def pack(sizes: DataFrame, key: str, key_type: str, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN) -> DataFrame:
    """Assigns items to containers.

    ``sizes``: ``spec_id INT, <key>, size INT, capacity INT``, one row an item.
    Gives ``spec_id, <key>, piece INT, first INT, size INT, container STRING``:
    an item over the capacity becomes full pieces and a rest, ``piece`` counting
    from 0 and ``first`` being the offset in the item; any other is whole.
    Null sizes count as 0; repeated items are packed as often as they come.
    Containers are named by level, task and serial number, unique in a spec.
    """
    schema = f"spec_id int, key {key_type}, piece int, size int, capacity int, container string, final boolean"
    arrow = arrow_schema(schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def pieces():
            for b in batches:
                for spec, k, size, capacity in zip(*(c.to_pylist() for c in b.columns)):
                    size = size or 0
                    for i in range(max(1, -(-size // capacity))):
                        yield spec, k, i, min(capacity, size - i * capacity), capacity

        placed = _level(pieces(), open_bins, 0, TaskContext.get().partitionId(), False)
        while rows := list(islice(placed, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    start = sizes.select("spec_id", F.col(key).alias("key"), "size", "capacity")
    n = start.rdd.getNumPartitions()
    done = cut(start.mapInArrow(first, schema))
    final, level = done.where("final"), 1
    left = done.where(~F.col("final"))
    while True:
        last = n <= fan_in**level
        group = F.lit(0) if last else F.floor(F.split("container", "-")[1].cast("int") / F.lit(fan_in))
        done = left.groupBy("spec_id", group.cast("int").alias("task")).applyInPandas(_regroup(open_bins, level, last), schema)
        if last:
            out = final.unionByName(done)
            break
        done = cut(done)
        final, left, level = final.unionByName(done.where("final")), done.where(~F.col("final")), level + 1
    return out.select("spec_id", F.col("key").alias(key), "piece", (F.col("piece") * F.col("capacity")).alias("first"), "size", "container")


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, containers, tokens, least_containers, fill``: how full the containers are."""
    used = packed.groupBy("spec_id", "container").agg(F.sum("size").alias("used"))
    return (
        used.groupBy("spec_id")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .join(F.broadcast(specs.select("spec_id", F.col("capacity_tokens").alias("capacity"))), "spec_id")
        .select("spec_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"), (F.col("fullest") <= F.col("capacity")).alias("sound"))
    )


def invariants(packed: DataFrame, specs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``spec_id, capacity, items, pieces_whole, unsplit, within, filled``: does a packing keep its promises?

    ``pieces_whole``: the pieces of each item are numbered from 0 without a gap and
    all but the last are full; ``unsplit``: no item is cut that fits a container;
    ``within``: no container holds more than its capacity; ``filled``: at most 2 %
    and two containers more than the least number are used.
    """
    each = packed.groupBy("spec_id", key).agg(F.count("*").alias("n"), F.countDistinct("piece").alias("kinds"), F.max("piece").alias("last"), F.sum("size").alias("tokens"))
    caps = specs.select("spec_id", F.col("capacity_tokens").alias("capacity"))  # a few rows
    items = each.join(F.broadcast(caps), "spec_id").groupBy("spec_id", "capacity").agg(
        F.count("*").alias("items"),
        F.every((F.col("n") == F.col("kinds")) & (F.col("last") + 1 == F.col("n")) & (F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)) == F.col("n"))).alias("pieces_whole"),
        F.every((F.col("n") == 1) | (F.col("tokens") > F.col("capacity"))).alias("unsplit"),
    )
    full = fill(packed, specs).select("spec_id", F.col("sound").alias("within"), (F.col("containers") <= 1.02 * F.col("least_containers") + 2).alias("filled"))
    return items.join(full, "spec_id")


def pack_corpus(docs: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packs texts, sized in tokens of each spec's tokenizer, into its containers.

    ``specs``: ``spec_id INT, tokenizer STRING, capacity_tokens INT``, a few rows,
    read on the driver. A text is tokenized once for each distinct tokenizer,
    in the same pass over the scan that packs it. Null and empty texts have size
    0 and still get a container. See :func:`pack` for the columns.
    """
    from mooring.llm.tokens import TOKENIZERS, encode, encoder

    folder = folder or TOKENIZERS
    todo = [(int(r.spec_id), r.tokenizer, int(r.capacity_tokens)) for r in specs.select("spec_id", "tokenizer", "capacity_tokens").orderBy("spec_id").collect()]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"spec_id int, key {kind}, size int, capacity int"
    arrow = arrow_schema(schema)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = {t: pa.array([len(encode(x, encoder(t, folder))) for x in texts], pa.int32()) for t in {t for _, t, _ in todo}}
            for spec, t, capacity in todo:
                yield pa.RecordBatch.from_arrays([pa.array([spec] * len(texts), pa.int32()), b.column(0), sizes[t], pa.array([capacity] * len(texts), pa.int32())], schema=arrow)

    items = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(sized, schema).withColumnRenamed("key", key)
    return pack(items, key, kind, open_bins)
