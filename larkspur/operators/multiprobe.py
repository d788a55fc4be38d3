"""Hashing with one copy of the rows: a query looks into the buckets that its vector nearly falls into."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur import files
from larkspur.functions.vectors import resolve_metric
from larkspur.operators.ivf import LIST, _plane, _unit
from larkspur.operators.scoring import QueryBlock, matrix
from larkspur.operators.search import Layout, QueryFilters, for_each_block, rank_results, scan_top_k

#: All buckets are put in order for each query, so there are at most two to the power of this many.
MAX_BITS = 14


class MultiProbeIndex:
    """Rows stored once, partitioned by the signs of ``bits`` projections.

    The projections are of a vector (its direction, for cosine) less the mean of all rows, so the signs divide them evenly. A bucket differs from the
    query's own in some signs; the sum of the squared projections with these signs is how far the query would have to
    move to fall into it, and buckets are probed by that sum, the query's own first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = json.loads(files.read(spark, f"{path}/model.json"))
        self.metric, self.bits, self.seed, self.filters = meta["metric"], meta["bits"], meta["seed"], meta["filters"]
        self.mean = np.array(meta["mean"])
        self.stored = spark.read.parquet(f"{path}/rows")

    @classmethod
    def build(cls, rows: DataFrame, path: str, metric: str = "cosine", bits: int = 8, id_column: str = "id",
              vector: str = "vector", filter_columns: list[str] | None = None, seed: int = 42) -> MultiProbeIndex:
        """Hash every row and write it to its bucket below ``path``; large buckets are split by measured size."""
        if not 1 <= bits <= MAX_BITS:
            raise ValueError(f"bits must be between 1 and {MAX_BITS}")
        metric, spark, filters = resolve_metric(metric), rows.sparkSession, filter_columns or []
        usable = rows.filter(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector).alias("vector"), *filters)
        mean = _mean(usable, metric)
        if mean is None:
            raise ValueError("cannot index an empty collection")

        @F.arrow_udf("int")
        def hashed(vectors: pa.Array) -> pa.Array:
            return pa.array(_own_bucket(_projected(matrix(vectors).astype(np.float64), mean, bits, seed, metric)))

        placed = usable.withColumn(LIST, hashed("vector"))
        placed.hint("rebalance", LIST).sortWithinPartitions(LIST, "id").write.partitionBy(LIST).parquet(f"{path}/rows")
        files.create(spark, f"{path}/model.json", json.dumps(
            {"metric": metric, "bits": bits, "seed": seed, "mean": mean.tolist(), "filters": filters}))
        return cls(spark, path)

    def probes(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` buckets nearest to each vector, nearest first, equal ones by number."""
        cost = _projected(vectors.astype(np.float64), self.mean, self.bits, self.seed, self.metric)
        numbers = np.arange(1 << self.bits)
        signs = numbers[:, None] >> np.arange(self.bits - 1, -1, -1) & 1
        out = np.empty((len(vectors), min(n, len(numbers))), np.int64)
        step = max(1, 4_000_000 // len(numbers))
        for low in range(0, len(vectors), step):
            part = cost[low:low + step]
            squared = part ** 2
            # Signs that differ cost their square: all where the bucket has 1 and the query not, and the other way round.
            is_one = part >= 0
            moved = np.where(is_one, 0, squared) @ signs.T + np.where(is_one, squared, 0) @ (1 - signs).T
            out[low:low + step] = np.argsort(np.round(moved, 9), axis=1, kind="stable")[:, :out.shape[1]]
        return out

    def search(self, queries: DataFrame, k: int = 10, probes: int = 32, layout: Layout | None = None) -> DataFrame:
        """Best ``k`` rows of the ``probes`` nearest buckets of each query, by exact score; all buckets give exact results."""
        layout = layout or Layout()
        query_type, id_type = queries.schema["query_id"].dataType, self.stored.schema["id"].dataType

        def search_block(block: QueryBlock) -> DataFrame:
            asked = self.probes(block.vectors, probes) if len(block) else np.zeros((0, 1), int)
            wanted = np.unique(asked).tolist()
            filters = QueryFilters(block)
            pruned = self.stored if len(wanted) == 1 << self.bits else self.stored.filter(F.col(LIST).isin(wanted))
            rows = pruned.filter(filters.scan_condition(layout)).select("id", "vector", LIST, *filters.columns(layout))

            def plan(queries_in_task: QueryBlock):
                own = QueryFilters(queries_in_task)
                order = np.argsort(asked, axis=None, kind="stable")
                owners, numbers = order // asked.shape[1], asked.ravel()[order]

                def groups(batch: pa.RecordBatch):
                    held = batch.column(2).to_numpy(zero_copy_only=False)
                    allowed = own.mask(batch)
                    for number in np.unique(held):
                        low, high = np.searchsorted(numbers, [number, number + 1])
                        yield np.flatnonzero(held == number), owners[low:high], allowed

                return groups

            return rank_results(scan_top_k(rows, block, k, self.metric, query_type, id_type, plan), k)

        return for_each_block(queries, search_block)


def _mean(rows: DataFrame, metric: str) -> np.ndarray | None:
    """Mean vector, added up in the tasks."""

    def add_up(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                points = matrix(batch.column(0)).astype(np.float64)
                own = (_unit(points) if metric == "cosine" else points).sum(axis=0)
                total, n = own if total is None else total + own, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "total"])

    parts = rows.select("vector").mapInArrow(add_up, "n bigint, total array<double>").select("n", F.posexplode("total").alias("at", "x"))
    summed = parts.groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("at").collect()
    return np.array([r.x / r.n for r in summed]) if summed else None


def _projected(points: np.ndarray, mean: np.ndarray, bits: int, seed: int, metric: str) -> np.ndarray:
    points = _unit(points) if metric == "cosine" else points
    planes = np.stack([_plane(seed, 0, b, len(mean)) for b in range(bits)], axis=1)
    return (points - mean) @ planes


def _own_bucket(projected: np.ndarray) -> np.ndarray:
    bits = projected.shape[1]
    return ((projected >= 0) << np.arange(bits - 1, -1, -1)).sum(axis=1).astype(np.int32)
