"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from larkspur import files

CHECKPOINT_KEY = "spark.checkpoint.dir"
FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where the package is installed on the cluster or was given to
    ``spark-submit --py-files``.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="larkspur-code-"), "larkspur_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's checkpoint folder.

    Only a local session without the setting gets a temporary folder; on a
    cluster a machine-local folder would not be visible to other executors.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="larkspur-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the scratch folder of this application."""
    return f"{_application_scratch(spark)}/{purpose}-{uuid.uuid4().hex}"


def _application_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/larkspur/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application staged; call it once its results are written elsewhere."""
    files.remove(spark, _application_scratch(spark))


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` in so many partitions where a number is given, for a costly step on an input that comes in few splits."""
    return df if partitions is None or df.isStreaming else df.repartition(partitions)


def stage(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Expensive or nondeterministic columns (embeddings, random ids) are then
    computed once, however many outputs are derived from them, and a lost
    executor re-reads files instead of calling the embedder again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Remove tables made by ``stage`` that nothing reads again."""
    for df in staged:
        for name in df.inputFiles()[:1]:
            files.remove(df.sparkSession, unquote(name.rsplit("/", 1)[0]))


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, shuffle files go when the query that wrote them ends, not when the driver next collects its garbage."""
    before = spark.conf.get(FREE_KEY, None)
    spark.conf.set(FREE_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_KEY)
        else:
            spark.conf.set(FREE_KEY, before)
