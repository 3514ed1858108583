"""Session defaults, table access and durable lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every job wants; a cluster's own settings win because they are only
#: applied through the builder of a session that does not exist yet.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("mooring")
    for k, v in {**DEFAULTS, "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``, and it is an error if it doesn't;
    only a local master (tests) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mooring-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder.

    Unlike ``cache`` or a local checkpoint it survives the loss of executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than the cluster has cores on as many partitions as cores, before costly work on its rows.

    Only such a table, which is at most a split a core, is moved; any other stays as
    it is split. ``scan`` must be without shuffles, so that counting its splits runs
    nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once an application.

    Python functions reach the workers by name, so the package must be importable
    there; where it isn't installed, Spark hands out an archive of its sources.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = repository_root()
    archive = os.path.join(tempfile.mkdtemp(prefix="mooring-"), "mooring.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in sorted(os.walk(os.path.join(root, "mooring"))):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def repository_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
