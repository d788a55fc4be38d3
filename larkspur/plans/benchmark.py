"""Search benchmarks: latency and recall against exact results."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from larkspur.operators.collections import CollectionStore
from larkspur.operators.embedding import EmbedderFactory, embed_column
from larkspur.operators.metrics import latency_stats, recall_at_k
from larkspur.operators.search import Layout, search_batch
from larkspur.operators.sinks import write_metrics
from larkspur.session import stage

SearchFunction = Callable[[DataFrame], DataFrame]


def embed_queries(lines: DataFrame, embedder: str | EmbedderFactory) -> DataFrame:
    """``query_id, vector`` of query lines; a line that cannot be embedded is an error."""
    embedded = stage(embed_column(lines, "query", embedder), "queries")
    if embedded.filter(~F.col("success")).limit(1).count():
        raise ValueError("some queries could not be embedded")
    return embedded.select("query_id", "vector")


def run_benchmark(
    queries: DataFrame, searches: dict[str, SearchFunction], exact: DataFrame | None, k: int = 10,
    rounds: int = 3, metrics_root: str | None = None,
) -> DataFrame:
    """One row per engine: ``engine, topk, queries, lat_ms_avg, lat_ms_p50, lat_ms_p95, batch_ms_avg, recall``.

    Spark answers a batch of queries in one job; the latency of a query is
    its share of the batch. The first, warm-up run is not timed.
    """
    spark = queries.sparkSession
    n = queries.count()
    rows, tables = [], []
    for name, search in searches.items():
        found = stage(search(queries), f"benchmark-{name}")
        for _ in range(rounds):
            started = time.perf_counter()
            search(queries).write.format("noop").mode("overwrite").save()
            batch_ms = (time.perf_counter() - started) * 1000.0
            rows.append((name, batch_ms, batch_ms / max(1, n)))
        recall = recall_at_k(found, exact, k).first().recall if exact is not None else None
        tables.append((name, k, n, recall))
    timings = spark.createDataFrame(rows, "engine string, batch_ms double, query_ms double")
    stats = latency_stats(timings, "query_ms", ["engine"])
    batches = timings.groupBy("engine").agg(F.avg("batch_ms").alias("batch_ms_avg"))
    info = spark.createDataFrame(tables, "engine string, topk int, queries bigint, recall double")
    out = info.join(stats, "engine").join(batches, "engine").select(
        "engine", "topk", "queries", "lat_ms_avg", "lat_ms_p50", "lat_ms_p95", "batch_ms_avg", "recall")
    if metrics_root:
        write_metrics(out, metrics_root, "search")
    return out


def run_update_benchmark(
    store: CollectionStore, name: str, inserts: DataFrame, deletes: DataFrame, queries: DataFrame,
    search: Callable[[DataFrame, DataFrame], DataFrame] | None = None, k: int = 10, layout: Layout = Layout(),
) -> DataFrame:
    """Insert, delete, search again and compare with exact results on the updated rows.

    ``search`` gets the updated rows and the queries. Without it the collection's index is searched, which must have been
    built before. One row ``upsert_ms, delete_ms, points, queries, hits, recall``.
    """
    started = time.perf_counter()
    store.upsert(name, inserts)
    middle = time.perf_counter()
    store.delete(name, deletes)
    ended = time.perf_counter()
    current = store.read(name)
    metric = store.manifest(name).metric
    exact = search_batch(current, queries, k, metric, layout)
    if search:
        found = search(current, queries)
    else:
        index = store.index(name)
        if index is None:
            raise ValueError(f"collection {name!r} has no current index to search")
        found = index.search(queries, k, layout=layout)
    return recall_at_k(found, exact, k).select(
        F.lit((middle - started) * 1000).alias("upsert_ms"), F.lit((ended - middle) * 1000).alias("delete_ms"),
        F.lit(current.count()).alias("points"), "*")
