"""Writers: datasets, several stores at once, checkpoints, metrics, documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur import files, schemas


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents ``name, text`` as a table; one file per document would swamp the file system."""
    documents.write.mode(mode).parquet(path)


def write_metrics(metrics: DataFrame, root: str, step: str) -> str:
    """Metrics of one step as JSON below a folder named after the step and the time."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S.%f")
    path = f"{root.rstrip('/')}/step-{step}-{stamp}"
    metrics.coalesce(1).write.json(path)
    return path


def write_sinks(
    batch: DataFrame, sinks: dict[str, Callable[[DataFrame], object]], batch_id: str = "0",
    reports: dict[str, object] | None = None,
) -> DataFrame:
    """Write one staged batch to every sink and report each outcome as a row.

    The writes run side by side and do not affect each other; an error is
    reported, never raised. A sink that refused rows (``rejected_rows`` of what
    its writer returned) has not succeeded. What the writers returned is put
    into ``reports``, by sink, where that is given. An empty batch writes
    nothing and counts as a success.
    """
    spark, size = batch.sparkSession, batch.count()

    def attempt(entry: tuple[str, Callable[[DataFrame], object]]):
        name, write = entry
        if size == 0:
            return batch_id, name, True, "", 0
        try:
            report = write(batch)
        except Exception as error:
            lines = str(error).splitlines() or [""]
            return batch_id, name, False, f"{type(error).__name__}: {lines[0]}".removesuffix(": "), size
        if reports is not None:
            reports[name] = report
        refused = getattr(report, "rejected_rows", 0)
        return batch_id, name, not refused, f"refused {refused} of {size} rows" if refused else "", size

    with ThreadPoolExecutor(max_workers=max(1, len(sinks))) as pool:
        rows = list(pool.map(attempt, sinks.items()))
    return spark.createDataFrame(rows, schemas.SINK_STATUS)


class Checkpoint:
    """Keys already processed, as an append-only table."""

    KEYS_PER_DOCUMENT = 100_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, collection: str, keys: DataFrame, run_id: str) -> None:
        rows = keys.select(
            F.lit(collection).alias("collection"), F.col("key").cast("string").alias("key"),
            F.current_timestamp().alias("processed_at"), F.lit(run_id).alias("run_id"),
        )
        rows.write.mode("append").partitionBy("collection").parquet(self.path)

    def _table(self) -> DataFrame:
        if not files.exists(self.spark, self.path):
            return self.spark.createDataFrame([], schemas.CHECKPOINT)
        return self.spark.read.schema(schemas.CHECKPOINT).parquet(self.path)

    def keys(self, collection: str) -> DataFrame:
        """Distinct processed keys of a collection; none when nothing was recorded."""
        return self._table().filter(F.col("collection") == collection).select("key").distinct()

    def pending(self, collection: str, objects: DataFrame, column: str = "key") -> DataFrame:
        """Objects whose key is not recorded. Spark broadcasts a record of few bytes, so that contents do not move."""
        done = self._table().filter(F.col("collection") == collection).select(F.col("key").alias(column))
        return objects.join(done, column, "left_anti")

    def import_json(self, collection: str, path: str, run_id: str = "import") -> None:
        """Take over keys from JSON documents; a missing or damaged document counts as empty."""
        self.append(collection, read_key_documents(self.spark, path), run_id)

    def export_json(self, collection: str, path: str) -> None:
        """Sorted keys as JSON documents of at most ``KEYS_PER_DOCUMENT`` keys each."""
        key_documents(self.keys(collection), self.KEYS_PER_DOCUMENT).write.text(path)


def read_key_documents(spark: SparkSession, path: str) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], "key string")
    keys = F.col("processed_keys")
    # A file is either one document over several lines or one document per line.
    shape = "processed_keys array<string>, last_updated double"
    whole = F.from_json(F.col("value"), shape)["processed_keys"]
    lines = F.flatten(F.transform(
        F.split("value", "\n"),
        lambda line: F.coalesce(F.from_json(line, shape)["processed_keys"], F.array().cast("array<string>"))))
    documents = spark.read.text(path, wholetext=True)
    found = documents.select(F.when(F.size(lines) > 0, lines).otherwise(whole).alias("processed_keys"))
    return found.select(F.explode(keys).alias("key")).distinct()


def key_documents(keys: DataFrame, per_document: int) -> DataFrame:
    """Rows ``value``: JSON documents with the keys in order, range-partitioned over the tasks."""
    now = datetime.now(timezone.utc).timestamp()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held.extend(batch.column(0).to_pylist())
            while len(held) >= per_document:
                yield document(held[:per_document])
                held = held[per_document:]
        if held:
            yield document(held)

    def document(part: list[str]) -> pa.RecordBatch:
        text = json.dumps({"processed_keys": part, "last_updated": now})
        return pa.record_batch([pa.array([text])], names=["value"])

    return keys.select("key").orderBy("key").mapInArrow(write, "value string")
