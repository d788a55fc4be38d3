"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.inputs import TASK_ROWS, stage_narrow
from larkspur.session import ship, stage

#: Edges that a task contracts at a time before they are shuffled.
LOCAL_EDGES = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns ``id``, ``component`` (smallest id reachable) for every id that has an edge in columns ``a``, ``b``.

    Null ends and loops are ignored; direction and repeats do not matter. Tasks first replace the edges they read by
    stars with the same components. Each round then points the larger neighbours of a node, and after that its smaller
    ones, to the smallest, which needs a minimum per node and a join on it. Both join sides are files, so Spark can
    split the key of a large star. Rounds are written to the shared folder, until the edges are a forest of stars.
    """
    ship(edges.sparkSession)
    loose = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    loose = stage(loose, "edges")
    n = loose.count()
    current = stage(_contracted(loose.coalesce(max(1, -(-n // LOCAL_EDGES)))), "edges")
    while not _stars(current, n):
        current = stage_narrow(_small_star(_large_star(current, n), n), "edges", 2 * n)
    roots = current.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return current.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars over the edges of each task, some ``LOCAL_EDGES`` at a time."""
    kind = edges.schema["hi"].dataType.simpleString()

    def stars(high: list, low: list) -> dict:
        parent: dict = {}

        def find(x):
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for x, y in zip(high, low):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        return {x: find(x) for x in parent}

    def run(batches):
        high, low = [], []

        def flush():
            found = [(x, root) for x, root in stars(high, low).items() if x != root]
            types = schema.types
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], types[i]) for i in (0, 1)], ["hi", "lo"])

        schema = None
        for batch in batches:
            schema = schema or batch.schema
            high += batch.column(0).to_pylist()
            low += batch.column(1).to_pylist()
            if len(high) >= LOCAL_EDGES:
                yield flush()
                high, low = [], []
        if high:
            yield flush()

    return edges.mapInArrow(run, f"hi {kind}, lo {kind}")


def _stars(edges: DataFrame, n: int) -> bool:
    """Whether no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    odd = nodes.where("up > 1 OR (up = 1 AND down = 1)").coalesce(max(1, -(-2 * n // TASK_ROWS)))
    return not odd.agg(F.count("*")).first()[0]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    least = stage_narrow(least, "stars", 2 * n)
    return stage_narrow(edges.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")), "edges", n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = stage_narrow(edges.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u"), "stars", n)
    joined = edges.join(least, F.col("hi") == F.col("u"))
    moved = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    kept = least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(kept).distinct()
