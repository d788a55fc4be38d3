"""Text and image ingestion: objects to vectors in one or more collections."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.errors import is_retriable
from larkspur.functions.payload import object_uri, point_id
from larkspur.operators.collections import CollectionStore, WriteReport
from larkspur.operators.embedding import (
    IMAGE_POLICY, TEXT_POLICY, EmbedderFactory, EmbedPolicy, embed_column, embed_images,
)
from larkspur.operators.metrics import summarize_run
from larkspur.operators.sinks import Checkpoint, write_sinks
from larkspur.session import stage
from larkspur.sources.objects import check_images, decode_text

UPSERT_FAILED = "Upsert failed"


@dataclass(frozen=True)
class Target:
    """A collection that receives the points."""

    store: CollectionStore
    collection: str
    n_buckets: int = 64


@dataclass(frozen=True)
class IngestReport:
    results: DataFrame
    sinks: DataFrame
    summary: DataFrame


def text_points(embedded: DataFrame, bucket: str, id_mode: str = "deterministic") -> DataFrame:
    """Points with the text payload columns."""
    uri = object_uri(F.lit(bucket), F.col("key"))
    return embedded.select(
        point_id(uri, id_mode).alias("id"), "vector", F.col("key").alias("s3_key"),
        F.lit(bucket).alias("s3_bucket"), uri.alias("s3_uri"), "text",
    )


def _sink(target: Target, dim: int, batch: tuple[str, int] | None):
    def write(points: DataFrame) -> WriteReport:
        target.store.create(target.collection, dim, n_buckets=target.n_buckets)
        return target.store.upsert(target.collection, points, batch=batch, staged=True)

    return write


def _commonest_size(points: DataFrame) -> int | None:
    """The vector size of a collection that does not exist yet; nothing where there is no point."""
    sizes = points.groupBy(F.size("vector").alias("dim")).count()
    first = sizes.orderBy(F.desc("count"), "dim").first()
    return first and first["dim"]


def _deliver(
    outcomes: DataFrame, points: DataFrame, targets: dict[str, Target], require: str, checkpoint: Checkpoint | None,
    name: str, run_id: str, started: float, batch: tuple[str, int] | None,
) -> IngestReport:
    """Write points to the targets, then derive one result row per key and record the successes.

    A point counts as stored by a target whose write ended and did not refuse it.
    """
    if require not in ("any", "all"):
        raise ValueError("require must be 'any' or 'all'")
    dim = _commonest_size(points)
    reports: dict[str, WriteReport] = {}
    sinks = {n: _sink(t, dim or 1, batch) for n, t in targets.items()}
    status = write_sinks(points, sinks if dim else {n: lambda _: None for n in targets}, run_id, reports)
    wrote = len(reports) if dim else len(targets)
    needed = min(1, len(targets)) if require == "any" else len(targets)

    refused = [r.rejected.select("id", F.lit(n).alias("sink"), "reason") for n, r in reports.items()
               if isinstance(r, WriteReport) and r.rejected_rows]
    results = outcomes.withColumn("_stored", F.lit(wrote)).withColumn("_reason", F.lit(None).cast("string"))
    if refused:
        every = reduce(DataFrame.unionByName, refused).groupBy("id").agg(
            F.count_distinct("sink").alias("_lost"), F.min("reason").alias("_why"))
        keys = points.select(F.col("s3_key").alias("key"), "id").join(every, "id").groupBy("key").agg(
            F.max("_lost").alias("_lost"), F.min("_why").alias("_why"))
        results = results.join(keys, "key", "left").withColumn(
            "_stored", F.col("_stored") - F.coalesce("_lost", F.lit(0))).withColumn("_reason", F.col("_why"))
    embedded, stored = F.col("success"), F.col("_stored") >= needed
    results = results.select(
        "key",
        (embedded & stored).alias("success"),
        F.when(~embedded, F.col("error_message")).when(~stored, F.lit(UPSERT_FAILED)).otherwise(F.lit("")).alias("error_message"),
        F.coalesce("cause", F.when(embedded & ~stored, F.col("_reason"))).alias("cause"),
    )
    if checkpoint is not None and dim:
        checkpoint.append(name, results.filter("success"), run_id)
    summary = summarize_run(results, time.monotonic() - started)
    return IngestReport(results, status, summary)


def ingest_documents(
    objects: DataFrame,
    bucket: str,
    embedder: str | EmbedderFactory,
    targets: dict[str, Target],
    checkpoint: Checkpoint | None = None,
    name: str = "documents",
    policy: EmbedPolicy = TEXT_POLICY,
    require: str = "any",
    id_mode: str = "deterministic",
    run_id: str | None = None,
    batch: tuple[str, int] | None = None,
) -> IngestReport:
    """Embed text objects (``key, content`` or ``key, text``) and upsert them into every target.

    Keys in the checkpoint are skipped. Each object is embedded once: the
    outcome is staged and points, failures and counts are read from there.
    """
    started, run_id = time.monotonic(), run_id or uuid.uuid4().hex
    todo = checkpoint.pending(name, objects) if checkpoint is not None else objects
    if "content" in todo.columns:
        decoded = decode_text(todo.select("key", "content"))
    else:
        decoded = todo.select("key", F.lit(True).alias("success"), "text", F.lit(None).cast("string").alias("error_message"))
    readable = decoded.filter("success").select("key", "text")
    unreadable = decoded.filter(~F.col("success")).select(
        "key", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<float>").alias("vector"),
        "success", "error_message", F.lit(None).cast("string").alias("cause"), F.lit(None).cast("int").alias("batch_size"))
    outcomes = stage(embed_column(readable, "text", embedder, policy=policy).unionByName(unreadable), "ingest")
    points = text_points(outcomes.filter("success"), bucket, id_mode)
    if id_mode == "random":  # both targets must receive the same ids
        points = stage(points, "points")
    return _deliver(outcomes, points, targets, require, checkpoint, name, run_id, started, batch)


def ingest_images(
    objects: DataFrame,
    bucket: str,
    embedder: str | EmbedderFactory,
    targets: dict[str, Target],
    checkpoint: Checkpoint | None = None,
    name: str = "images",
    policy: EmbedPolicy = IMAGE_POLICY,
    require: str = "any",
    run_id: str | None = None,
) -> IngestReport:
    """Check image objects (``key, content``), embed the valid ones and upsert them into every target."""
    started, run_id = time.monotonic(), run_id or uuid.uuid4().hex
    todo = checkpoint.pending(name, objects) if checkpoint is not None else objects
    checked = check_images(todo.select("key", "content"))
    good = checked.filter("success").select("key", "format", "content")
    bad = checked.filter(~F.col("success")).select("key", "format", "success", "error_message", F.col("reason").alias("cause"))
    embedded = embed_images(good, "content", embedder, policy=policy).drop("content")
    outcomes = stage(embedded.unionByName(bad, allowMissingColumns=True), "ingest-images")
    uri = object_uri(F.lit(bucket), F.col("key"))
    points = outcomes.filter("success").select(
        point_id(uri).alias("id"), "vector", F.col("key").alias("s3_key"), F.lit(bucket).alias("s3_bucket"),
        uri.alias("s3_uri"), "format")
    return _deliver(outcomes, points, targets, require, checkpoint, name, run_id, started, None)


def retriable_keys(failures: DataFrame, code: Column, http_status: Column) -> DataFrame:
    """Keys of the failures that may succeed on another attempt."""
    return failures.filter(is_retriable(code, http_status)).select("key").distinct()


def retry_failures(
    failures: DataFrame, objects: DataFrame, bucket: str, embedder: str | EmbedderFactory,
    targets: dict[str, Target], code: str = "code", http_status: str = "http_status", **options,
) -> IngestReport:
    """Ingest again the objects whose failure is retriable."""
    again = retriable_keys(failures, F.col(code), F.col(http_status))
    return ingest_documents(objects.join(again, "key", "left_semi"), bucket, embedder, targets, **options)
