"""Small file operations through Hadoop's file system, so any store Spark reads works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class FileExists(RuntimeError):
    """The file to create is already there."""


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct entries of a folder; empty when there is no folder."""
    fs, target = _open(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def changed(spark: SparkSession, path: str) -> dict[str, float]:
    """Time of the last change, in seconds, of each direct entry of a folder; none when there is no folder."""
    fs, target = _open(spark, path)
    found = fs.listStatus(target) if fs.exists(target) else []
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in found}


def create(spark: SparkSession, path: str, text: str) -> None:
    """Write a new small file; fail if the name is taken."""
    fs, target = _open(spark, path)
    if fs.exists(target):
        raise FileExists(path)
    try:
        out = fs.create(target, False)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise FileExists(path) from error
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read(spark: SparkSession, path: str) -> str:
    fs, target = _open(spark, path)
    source = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
    finally:
        source.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _open(spark, path)
    fs.delete(target, True)
