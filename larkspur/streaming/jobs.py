"""Incremental ingestion and upserts with Structured Streaming."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkspur import files
from larkspur.operators.collections import CollectionStore, WriteReport
from larkspur.operators.embedding import EmbedderFactory
from larkspur.plans.ingest import IngestReport, Target, ingest_documents
from larkspur.sources.listing import register_objects

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def object_stream(spark: SparkSession, path: str, files_per_trigger: int = 10_000, glob: str | None = None,
                  grace_seconds: float = 0.0) -> DataFrame:
    """New objects below a path as ``key, content``, objects of zero bytes included.

    Prefixes are listed by tasks. A batch holds what changed since the one before, so ``files_per_trigger`` has no part
    in it; ``grace_seconds`` leaves the newest changes to the next batch where the store's clock may lag.
    """
    register_objects(spark)
    found = spark.readStream.format("objects").option("grace", grace_seconds).load(path)
    if glob:
        names = re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        found = found.filter(F.col("key").rlike(f"(^|/){names}$"))
    return found.select(F.col("path").alias("key"), "content")


def point_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, wait: bool) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query


def _batch_key(spark: SparkSession, checkpoint: str, name: str) -> str:
    """A name that only batches of this checkpoint's query have: another stream, or a new checkpoint, starts afresh."""
    return f"{name}:{json.loads(files.read(spark, f'{checkpoint.rstrip('/')}/metadata'))['id']}"


def ingest_stream(
    objects: DataFrame, bucket: str, embedder: str | EmbedderFactory, targets: dict[str, Target],
    checkpoint: str, stream_name: str = "ingest", wait: bool = True,
    on_report: Callable[[IngestReport, int], None] | None = None, **options,
) -> StreamingQuery:
    """Ingest a stream of text objects batch by batch.

    The stream's own checkpoint remembers the files already read; the query's id
    and the batch number are recorded in the collections, so a replayed batch
    changes nothing. ``on_report`` gets every batch's report, failed keys included.
    """

    def each(batch: DataFrame, number: int) -> None:
        key = _batch_key(batch.sparkSession, checkpoint, stream_name)
        report = ingest_documents(batch, bucket, embedder, targets, batch=(key, number), **options)
        if on_report:
            on_report(report, number)

    return _run(objects, each, checkpoint, wait)


def upsert_stream(
    points: DataFrame, store: CollectionStore, name: str, checkpoint: str, order_by: str | None = None,
    stream_name: str = "points", enrich: Callable[[DataFrame], DataFrame] | None = None, wait: bool = True,
    on_report: Callable[[WriteReport, int], None] | None = None,
) -> StreamingQuery:
    """Upsert a stream of points; ``enrich`` may join each batch to static tables first.

    ``on_report`` gets every batch's report. Without it a batch with refused rows stops the stream after its good rows
    are stored, so that none is lost unseen.
    """

    def each(batch: DataFrame, number: int) -> None:
        key = _batch_key(batch.sparkSession, checkpoint, stream_name)
        report = store.upsert(name, enrich(batch) if enrich else batch, order_by, batch=(key, number))
        if on_report:
            on_report(report, number)
        elif report.rejected_rows:
            raise ValueError(f"batch {number}: {report.rejected_rows} rows refused; pass on_report to receive them")

    return _run(points, each, checkpoint, wait)


def first_arrivals(keys: DataFrame, column: str = "key", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each key once. With an event time, state is kept only for the delay.

    Repeats inside an Arrow batch are dropped before the shuffle by key, so a
    key that holds most rows does not travel.
    """
    place = keys.columns.index(column)

    def first_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column(place).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            _, first = np.unique(seen, return_index=True)
            yield batch.take(pa.array(np.sort(first)))

    thinned = keys.mapInArrow(first_in_batch, keys.schema)
    if event_time is None:
        return thinned.dropDuplicates([column])
    return thinned.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([column])


class _Lifetime(StatefulProcessor):
    """Per key the time of the row passed on last, forgotten when its lifetime is over."""

    def __init__(self, event_time: str, lifetime_us: int, columns: list[str]):
        self.event_time, self.lifetime, self.columns = event_time, lifetime_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(self.event_time, kind="stable")
        times = batch[self.event_time].dt.as_unit("us").astype("int64").to_numpy()
        last = self.last.get()[0] if self.last.exists() else None
        chosen, at = [], 0
        while at < len(times):
            if last is None or times[at] >= last + self.lifetime:
                chosen.append(at)
                last = int(times[at])
            # The next row that can pass is the first one after the lifetime.
            at = max(at + 1, int(np.searchsorted(times, last + self.lifetime)))
        if chosen:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            self.handle.registerTimer((last + self.lifetime) // 1000 + 1)
        yield batch.iloc[chosen][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def arrivals_with_lifetime(rows: DataFrame, column: str, event_time: str, lifetime_seconds: float, delay: str = "1 day") -> DataFrame:
    """The first row of each key, and again the first one at least a lifetime after the row passed on last.

    Times are event times. The state of a key is one number, and a timer clears it when the watermark has passed the end
    of its lifetime, so state does not grow with the keys ever seen. Rows of one time pass in the order they come in. What
    passes depends on the row before, so the rows of one key go through one task. Sets the session's state store to
    RocksDB, which timers need.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    marked = rows.withWatermark(event_time, delay)
    processor = _Lifetime(event_time, round(lifetime_seconds * 1_000_000), rows.columns)
    return marked.groupBy(column).transformWithStateInPandas(processor, rows.schema, "Append", "EventTime")


def stream_progress(query: StreamingQuery) -> DataFrame:
    """Rows per finished batch of a stream: ``batch_id, rows, seconds, rows_per_second``."""
    spark = SparkSession.getActiveSession()
    seen = [
        (int(p["batchId"]), int(p["numInputRows"]), p["durationMs"].get("triggerExecution", 0) / 1000.0)
        for p in query.recentProgress if p["numInputRows"]
    ]
    rows = spark.createDataFrame(seen, "batch_id bigint, rows bigint, seconds double")
    rate = F.when(F.col("seconds") > 0, F.round(F.col("rows") / F.col("seconds"), 1)).otherwise(F.lit(0.0))
    return rows.withColumn("rows_per_second", rate)
