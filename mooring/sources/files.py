"""Small files and folders in whatever file system Spark reads (local, HDFS, object store)."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def names(spark: SparkSession, folder: str, glob: str) -> list[str]:
    """Names in ``folder`` that match, sorted."""
    p, fs = _at(spark, folder)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, glob)) if fs.exists(p) else None
    return sorted(x.getPath().getName() for x in found or [])


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    p, fs = _at(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} can't become {new}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file anew, with the folders above it."""
    p, fs = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole; a missing one is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(str(path), wholetext=True).first()[0]
