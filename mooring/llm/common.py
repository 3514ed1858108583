"""Shared pieces: Arrow batch mapping and bounded, layout-independent samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.session import spread


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; made on the driver, as parsing needs the session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], costly: bool = False) -> DataFrame:
    """``mapInArrow`` whose function is built once a task.

    ``costly``: a small scan of few splits is spread over the cores first.

    ``make()`` runs on the worker and returns ``batch -> {column: values}``;
    columns come out in the order of ``schema``.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            got = work(batch)
            if got is not None:
                yield pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type) for v, f in ((got[f.name], f) for f in arrow)], schema=arrow)

    return (spread(df) if costly else df).mapInArrow(run, schema)


#: Texts of more characters are not read for training, so that a sample of N rows
#: is bounded in bytes too. They are scored like any other.
TRAIN_CHARS = 20_000


def sample_hashes(df: DataFrame, key: str, limit: int, by: str | None = None) -> DataFrame:
    """``[by,] _hash``: at most ``limit`` key hashes (for each value of ``by``, if given).

    Kept is the least hash in each of ``limit`` hash buckets, so the choice is the
    same for any partitioning. Only hashes are aggregated, with partial
    aggregation, so no value of ``by`` is a hot spot. Null keys never come.
    """
    h = F.xxhash64(F.col(key))
    own = [by] if by else []
    return df.where(F.col(key).isNotNull()).groupBy(*own, F.pmod(h, F.lit(limit)).alias("_bucket")).agg(F.min(h).alias("_hash")).select(*own, "_hash")


def sampled_rows(df: DataFrame, key: str, hashes: DataFrame, by: str | None = None) -> DataFrame:
    """One row of ``df`` for each of the hashes of :func:`sample_hashes`, whatever the number of rows with its key.

    Of rows with equal keys the one whose content hashes least is taken, after
    partial aggregation in each task. The hashes broadcast are as many as were
    asked for (``limit`` for each value of ``by``).
    """
    own = [by] if by else []
    cols = df.columns
    near = df.withColumn("_hash", F.xxhash64(F.col(key))).join(F.broadcast(hashes), [*own, "_hash"], "left_semi")
    content = F.xxhash64(*[F.map_entries(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
    return near.groupBy(*own, "_hash").agg(F.min_by(F.struct(*cols), content).alias("_row")).select("_row.*")


def hash_sample(df: DataFrame, key: str, limit: int, by: str | None = None) -> DataFrame:
    """At most ``limit`` rows (for each value of ``by``, if given), the same for any partitioning.

    Rows with null keys never come, and rows with equal keys give one row.
    """
    return sampled_rows(df, key, sample_hashes(df, key, limit, by), by)
