"""Resumable generation as a stream of requests.

Each micro-batch drops what is already done, generates and appends. The append
of a batch is a folder named by its id, overwritten if the batch is tried again
after a failure, so every output is kept exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mooring.operators import generation as G
from mooring.schemas import RAW_GENERATION, REQUEST
from mooring.session import cut
from mooring.sources import files


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """All raw rows of the folder; ``seq`` is their batch, in which keys are unique."""
    if not files.names(spark, folder, "batch=*"):
        return spark.createDataFrame([], RAW_GENERATION).withColumn("seq", F.lit(None).cast("bigint"))
    return spark.read.option("basePath", folder).schema(RAW_GENERATION.simpleString()[7:-1].replace(":", " ") + ", batch bigint").parquet(f"{folder}/batch=*").withColumnRenamed("batch", "seq")


def generate_stream(requests: DataFrame, folder: str, make: Callable[[], G.Generator], checkpoint: str, chunk: int = 256) -> StreamingQuery:
    """Starts the query: available requests are generated in micro-batches, then it ends."""

    def one(batch: DataFrame, batch_id: int) -> None:
        own = cut(batch.dropDuplicates(["row_idx", "method"]))
        low, high = own.agg(F.min("row_idx"), F.max("row_idx")).first()
        if low is None:
            return
        # outputs are stored by row, so only files and row groups that may have the batch's rows are read
        done = read_raw(batch.sparkSession, folder).where((F.col("seq") < batch_id) & F.col("row_idx").between(low, high)).select("row_idx", "method")
        made = G.generate(G.pending(own, done), make, chunk)
        cut(made).repartitionByRange("row_idx").sortWithinPartitions("row_idx").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Requests that arrive as JSON-lines files."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).json(folder)


def window_summary(records: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Streaming counts and means of metric records by method and window of ``scored_at``.

    Rows later than the watermark are left out by Spark.
    """
    return (
        records.withColumn("scored_at", F.col("scored_at").cast("timestamp")).withWatermark("scored_at", late)
        .groupBy("method", F.window("scored_at", window).alias("w"))
        .agg(F.count("*").alias("n"), F.avg(F.when(~F.isnan("aprob") & (F.abs("aprob") < float("inf")), F.col("aprob"))).alias("mean_aprob"))
        .select("method", F.col("w.start").alias("start"), "n", "mean_aprob")
    )
