"""Approximate search: inverted file, product quantisation and hashing.

The inverted file stores the collection partitioned by nearest centroid, so a
probe is Parquet partition pruning. Training and index take every row.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from larkspur import files
from larkspur.functions.vectors import l2_normalise, resolve_metric
from larkspur.operators.centroid_tree import CentroidTree
from larkspur.operators.scoring import QueryBlock, TopK, matrix, pair_scores, sortable, without_spare_copies
from larkspur.operators.search import (
    Layout, QueryFilters, for_each_block, rank_results, scan_top_k, share,
)
from larkspur.session import stage

# Centroids and codebooks are held by every task.
MAX_MODEL_BYTES = 256 * 1024 * 1024
LIST = "ivf_list"


def train_centroids(vectors: DataFrame, column: str, n_clusters: int, seed: int, max_iter: int = 10) -> np.ndarray:
    """Centroids found by MLlib k-means; fewer than asked for when there are fewer distinct rows."""
    features = vectors.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, n_clusters), seed=seed, maxIter=max_iter, initSteps=2).fit(features)
    return np.array(model.clusterCenters())


def _check_model_size(cells: int) -> None:
    if cells * 8 > MAX_MODEL_BYTES:
        raise ValueError("centroids would not fit in the memory of a task; use fewer lists")


def _nearest(points: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the ``n`` nearest centroids per row, nearest first."""
    out = np.empty((len(points), n), dtype=np.int32)
    lengths = (centroids ** 2).sum(axis=1)
    step = max(1, 4_000_000 // len(centroids))
    for lo in range(0, len(points), step):
        squared = lengths - 2.0 * points[lo:lo + step] @ centroids.T
        if n == 1:
            out[lo:lo + step, 0] = squared.argmin(axis=1)
        else:
            out[lo:lo + step] = np.argsort(squared, axis=1, kind="stable")[:, :n]
    return out


def _lists_near(points: np.ndarray, centroids: np.ndarray | CentroidTree, n: int) -> np.ndarray:
    return centroids.nearest(points, n) if isinstance(centroids, CentroidTree) else _nearest(points, centroids, n)


def _save_matrix(spark: SparkSession, values: np.ndarray, path: str) -> None:
    """A matrix of checked size as a table of numbered rows."""
    rows = pa.table({"row": pa.array(range(len(values))), "cells": pa.array(list(values), type=pa.list_(pa.float64()))})
    spark.createDataFrame(rows).write.parquet(path)


def _load_matrix(spark: SparkSession, path: str) -> np.ndarray:
    return matrix(spark.read.parquet(path).orderBy("row").select("cells").toArrow().column(0).combine_chunks())


def _unit(points: np.ndarray) -> np.ndarray:
    length = np.sqrt((points ** 2).sum(axis=1, keepdims=True))
    return points / np.where(length > 0, length, 1.0)


class IvfIndex:
    """Collection rows grouped by nearest centroid."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, metric: str, filters: list[str],
                 pq: PqModel | None = None, state: dict | None = None, tree: CentroidTree | None = None):
        self.spark, self.path, self.centroids, self.tree = spark, path, centroids, tree
        self.metric, self.filters, self.pq = metric, filters, pq
        # Folders of rows, the version that added each and the lists of it that count; folders of ids that left a list.
        self.state = state or {"parts": [{"folder": "lists", "added": 0, "lists": None}], "gone": [], "synopsis": None, "counted": []}
        self._rows: DataFrame | None = None

    @property
    def n_lists(self) -> int:
        return len(self.centroids)

    @classmethod
    def build(cls, rows: DataFrame, path: str, n_lists: int = 64, metric: str = "cosine",
              id_column: str = "id", vector: str = "vector", filter_columns: list[str] | None = None,
              seed: int = 42, pq: PqModel | None = None, centroids: np.ndarray | None = None,
              tree: CentroidTree | None = None) -> IvfIndex:
        """Train, assign every row to its list and write the lists below ``path``.

        Given ``centroids``, one row for each list, are used as they are and nothing is trained. With a ``tree`` they are
        its leaves, and lists are found by way of its upper level.

        The rebalance hint splits a list that holds a large share of the rows
        over several tasks and files, by measured size. With a quantiser the
        rows carry their code as well, for ``search_codes``; a quantiser of
        residuals codes what is left of a vector without its list's centroid.
        """
        spark, metric = rows.sparkSession, resolve_metric(metric)
        filters = filter_columns or []
        usable = rows.filter(F.col(vector).isNotNull()).select(
            F.col(id_column).alias("id"), F.col(vector).alias("vector"), *filters)
        total = usable.count()
        if total == 0:
            raise ValueError("cannot index an empty collection")
        by_direction = metric in ("cosine", "ip")
        if tree is not None:
            centroids = tree.leaves
        if centroids is None:
            shaped = l2_normalise(F.col("vector")) if by_direction else F.col("vector")
            training = stage(usable.select(shaped.alias("vector")), "training")  # read many times over
            centroids = train_centroids(training, "vector", min(n_lists, total), seed)
        _check_model_size(centroids.size)

        index = cls(spark, path, centroids, metric, filters, pq, tree=tree)
        assigned = index._assign(usable)
        if pq is not None:
            assigned = index._coded(assigned)
            pq.save(spark, f"{path}/pq")
        index._write_lists(assigned, "lists")
        _save_matrix(spark, centroids, f"{path}/centroids")
        if tree is not None:
            _save_matrix(spark, tree.upper, f"{path}/upper")
            _save_matrix(spark, tree.groups[:, None].astype(float), f"{path}/groups")
        index._write_synopsis()
        files.create(spark, f"{path}/model.json", json.dumps(
            {"metric": metric, "filters": filters, "pq": pq is not None, "tree": tree is not None, "state": index.state}))
        return index

    def _write_synopsis(self) -> None:
        """How many rows of each list have each value of the filter columns that are strings."""
        schema, folder = self.rows().schema, f"synopsis-{uuid.uuid4().hex[:8]}"
        names = [c for c in self.filters if schema[c].dataType == T.StringType()]
        counts = self.spark.createDataFrame([], "name string, value string, list int, n bigint")
        for name in names:
            own = self.rows().groupBy(F.col(name).alias("value"), F.col(LIST).alias("list")).agg(F.count("*").alias("n"))
            counts = counts.unionByName(own.select(F.lit(name).alias("name"), "value", "list", "n"))
        counts.sortWithinPartitions("name", "value").write.parquet(f"{self.path}/{folder}")
        self.state = {**self.state, "synopsis": folder, "counted": names}

    def _coded(self, assigned: DataFrame) -> DataFrame:
        return pq_encode(assigned, self.pq, centroids=self.centroids if self.pq.residual else None)

    def _assign(self, rows: DataFrame) -> DataFrame:
        by_direction = self.metric in ("cosine", "ip")
        shared = self.spark.sparkContext.broadcast(self.tree or self.centroids)

        @F.arrow_udf("int")
        def nearest(vectors: pa.Array) -> pa.Array:
            points = matrix(vectors).astype(np.float64)
            return pa.array(_lists_near(_unit(points) if by_direction else points, shared.value, 1)[:, 0])

        return rows.withColumn(LIST, nearest(F.col("vector")))

    @classmethod
    def open(cls, spark: SparkSession, path: str, state: dict | None = None) -> IvfIndex:
        meta = json.loads(files.read(spark, f"{path}/model.json"))
        pq = PqModel.load(spark, f"{path}/pq") if meta["pq"] else None
        centroids, tree = _load_matrix(spark, f"{path}/centroids"), None
        if meta["tree"]:
            tree = CentroidTree(_load_matrix(spark, f"{path}/upper"), centroids,
                                _load_matrix(spark, f"{path}/groups")[:, 0].astype(int))
        return cls(spark, path, centroids, meta["metric"], meta["filters"], pq, state or meta["state"], tree)

    def rows(self) -> DataFrame:
        """All current rows; the files never change, so they are listed once."""
        if self._rows is None:
            self._rows = self._current()
        return self._rows

    # Changes ----------------------------------------------------------------

    def _current(self) -> DataFrame:
        """Rows of all parts without those that left their list in a later version than the one that added them.

        Both sides are partitioned by list, so a search reads the changes of the lists it probes only.
        """
        base, gone = self.spark.read.parquet(f"{self.path}/lists"), self.state["gone"]
        parts = [self._part(p, base).withColumn("_added", F.lit(p["added"])) for p in self.state["parts"]]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if gone:
            schema = T.StructType([base.schema["id"], T.StructField("version", T.LongType()), T.StructField("left", T.StringType()),
                                   T.StructField(LIST, T.IntegerType())])
            left = self.spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/{g}" for g in gone))
            left = left.groupBy(F.col(LIST).alias("_list"), F.col("id").alias("_id")).agg(F.max("version").alias("_left"))
            rows = rows.join(left, (F.col(LIST) == F.col("_list")) & (F.col("id") == F.col("_id")) & (F.col("_added") < F.col("_left")),
                             "left_anti")
        return rows.drop("_added")

    def _part(self, part: dict, base: DataFrame) -> DataFrame:
        where = f"{self.path}/{part['folder']}"
        paths = [where] if part["lists"] is None else [f"{where}/{LIST}={n}" for n in part["lists"]]
        return self.spark.read.schema(base.schema).option("basePath", where).parquet(*paths)

    def _lists_of(self, folder: str) -> set[int]:
        names = files.names(self.spark, f"{self.path}/{folder}")
        return {int(n.split("=")[1]) for n in names if n.startswith(f"{LIST}=")}

    def _write_lists(self, rows: DataFrame, folder: str) -> None:
        rows.hint("rebalance", LIST).sortWithinPartitions(LIST, "id").write.partitionBy(LIST).parquet(f"{self.path}/{folder}")

    def changed(self, added: DataFrame | None, left: DataFrame | None, version: int) -> dict:
        """The state after a version that added rows ``id, vector, ...`` and took away the ``id, vector`` in ``left``.

        Rows go to the list of their vector, and what left is noted under the list it was in, so nothing of the index is
        read. A row that stays under its id with another vector is in both.
        """
        state = {**self.state, "parts": list(self.state["parts"]), "gone": list(self.state["gone"])}
        if added is not None or left is not None:
            state["synopsis"] = None  # counted again when the changes are folded in
        if added is not None:
            base = self.spark.read.parquet(f"{self.path}/lists").drop(LIST)
            given = [(F.col(f.name) if f.name in added.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                     for f in base.schema.fields if f.name != "code"]
            rows = self._assign(added.select(*given))
            if self.pq is not None:
                rows = self._coded(rows)
            folder = f"added-{version:08d}-{uuid.uuid4().hex[:8]}"
            self._write_lists(rows.select(*base.columns, LIST), folder)
            state["parts"].append({"folder": folder, "added": version, "lists": None})
        if left is not None:
            folder = f"left={version:08d}-{uuid.uuid4().hex[:8]}"
            noted = self._assign(left.select("id", "vector"))
            self._write_lists(noted.select("id", F.lit(version).cast("bigint").alias("version"), LIST), folder)
            state["gone"].append(folder)
        return state

    def changes(self) -> int:
        """Rows added and taken away since the lists were last written."""
        noted = [f"{self.path}/{p['folder']}" for p in self.state["parts"] if p["added"] and not p.get("folded")]
        noted += [f"{self.path}/{g}" for g in self.state["gone"]]
        return sum(self.spark.read.schema("id string").parquet(n).count() for n in noted)

    def folded(self, version: int) -> dict:
        """The state with all changes written into their lists; lists without a change stay where they are."""
        fresh = [p for p in self.state["parts"] if p["added"] and not p.get("folded")]
        touched = set().union(*(self._lists_of(p["folder"]) for p in fresh), *(self._lists_of(g) for g in self.state["gone"]))
        if not touched:
            return self.state
        folder = f"folded-{version:08d}-{uuid.uuid4().hex[:8]}"
        self._write_lists(self.rows().filter(F.col(LIST).isin(sorted(touched))), folder)
        parts = []
        for part in self.state["parts"]:
            if part in fresh:
                continue
            kept = sorted((self._lists_of(part["folder"]) if part["lists"] is None else set(part["lists"])) - touched)
            if kept:
                parts.append({**part, "lists": kept})
        written = sorted(self._lists_of(folder))
        if written or not parts:
            parts.append({"folder": folder, "added": version, "lists": None, "folded": True})
        after = IvfIndex(self.spark, self.path, self.centroids, self.metric, self.filters, self.pq,
                         {**self.state, "parts": parts, "gone": []}, self.tree)
        after._write_synopsis()
        return after.state

    # Search -----------------------------------------------------------------

    def probes(self, vectors: np.ndarray, nprobe: int) -> np.ndarray:
        points = _unit(vectors) if self.metric in ("cosine", "ip") else vectors
        return _lists_near(points.astype(np.float64), self.tree or self.centroids, min(nprobe, self.n_lists))

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 8, layout: Layout | None = None) -> DataFrame:
        """Best ``k`` rows among the ``nprobe`` lists nearest to each query.

        Lists no query probes are pruned from the scan. With ``nprobe`` equal
        to the number of lists the result is exact.
        """
        layout = layout or Layout()
        query_type, id_type = queries.schema["query_id"].dataType, self.rows().schema["id"].dataType

        def search_block(block: QueryBlock) -> DataFrame:
            rows, _, plan = self._probed(block, self._probes_of(block, nprobe), layout, "vector")
            return rank_results(scan_top_k(rows, block, k, self.metric, query_type, id_type, plan), k)

        return for_each_block(queries, search_block)

    def search_filled(self, queries: DataFrame, k: int = 10, nprobe: int = 8, layout: Layout | None = None) -> DataFrame:
        """The same under selective filters: lists are probed until ``k`` rows pass the query's filters, or all are.

        Of a query with a species only lists that hold it are probed, at least ``nprobe`` of them, and as many of the
        nearest as it takes to hold ``k`` rows of it. Both come from the counts written with the index. Queries that still
        lack rows, by another filter or because rows left since, are searched again in four times as many lists.
        """
        layout = layout or Layout()
        query_type, id_type = queries.schema["query_id"].dataType, self.rows().schema["id"].dataType

        def search_block(block: QueryBlock) -> DataFrame:
            counts, done, pending, lists = self._counts_of(block, layout), [], np.arange(len(block)), nprobe
            while True:
                part, lists = block.take(pending), min(lists, self.n_lists)
                probes, complete = self._holding(part, counts, k, lists)
                rows, _, plan = self._probed(part, probes, layout, "vector")
                found = rank_results(scan_top_k(rows, part, k, self.metric, query_type, id_type, plan), k)
                if lists == self.n_lists or complete.all():
                    return reduce(DataFrame.unionByName, [*done, found])
                found = stage(found, "filled")
                # At most one row for each query of the block.
                full = {r.query_id for r in found.groupBy("query_id").count().where(F.col("count") >= k).collect()}
                ended = complete | np.array([i in full for i in part.ids.tolist()], dtype=bool)
                keys = self.spark.createDataFrame([(i,) for i in part.ids[ended].tolist()], f"query_id {query_type.simpleString()}")
                done.append(found.join(F.broadcast(keys), "query_id", "left_semi").select(found.columns))
                pending, lists = pending[~ended], 4 * lists
                if not len(pending):
                    return reduce(DataFrame.unionByName, done)

        return for_each_block(queries, search_block)

    def _counts_of(self, block: QueryBlock, layout: Layout):
        """Rows with the queries' species by species and list, where these are counted and rows have not changed since."""
        wanted = sorted(set(QueryFilters(block).species) - {""})
        if not wanted or self.state["synopsis"] is None or layout.species not in self.state["counted"]:
            return None
        known = self.spark.createDataFrame([(w,) for w in wanted], "value string")
        stored = self.spark.read.parquet(f"{self.path}/{self.state['synopsis']}").where(F.col("name") == layout.species)
        table = stored.join(F.broadcast(known), "value", "left_semi").select("value", "list", "n").toArrow()
        codes = {w: i for i, w in enumerate(wanted)}
        keys = np.array([codes[v] for v in table.column("value").to_pylist()], np.int64) * self.n_lists
        keys = keys + table.column("list").to_numpy() if len(keys) else keys
        order = np.argsort(keys)
        return codes, keys[order], table.column("n").to_numpy()[order]

    def _holding(self, block: QueryBlock, counts, k: int, lists: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists to probe for each query, filled up with -1, and whether they are all that can hold rows for it.

        Where nothing is counted for a query these are the nearest ``lists``. Otherwise the nearest that hold its species,
        ``lists`` at least, and as many as it takes to hold ``k`` rows.
        """
        if counts is None:
            return self._probes_of(block, lists), np.full(len(block), lists == self.n_lists)
        codes, keys, numbers = counts
        own = np.array([codes.get(s, -1) for s in QueryFilters(block).species], np.int64)
        named, width = own >= 0, lists
        while True:
            probes = self._probes_of(block, width)
            wanted = own[:, None] * self.n_lists + probes
            held = np.zeros(probes.shape, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                held = np.where(keys[at] == wanted, numbers[at], 0)
            held[~named] = 1
            before, rank = np.cumsum(held, axis=1) - held, np.cumsum(held > 0, axis=1) - (held > 0)
            enough = np.where(named[:, None], (rank >= lists) & (before >= k), rank >= lists)
            if width == self.n_lists or enough[named].any(axis=1).all():
                break
            width = min(self.n_lists, 4 * width)
        complete = (named | (lists == self.n_lists)) & (width == self.n_lists) & ~((held > 0) & enough).any(axis=1)
        return np.where((held > 0) & ~enough, probes, -1), complete

    def _probes_of(self, block: QueryBlock, nprobe: int) -> np.ndarray:
        return self.probes(block.vectors, nprobe) if len(block) else np.zeros((0, 1), dtype=int)

    def search_codes(self, queries: DataFrame, k: int = 10, nprobe: int = 8, refine: int = 4,
                     layout: Layout | None = None) -> DataFrame:
        """The same by compressed score: only ids and codes of the probed lists are read.

        The best ``k * refine`` rows per query are scored again with the full
        vectors, unless ``refine`` is 0.
        """
        if self.pq is None:
            raise ValueError("this index was built without a quantiser")
        layout = layout or Layout()
        query_type, id_type = queries.schema["query_id"].dataType, self.rows().schema["id"].dataType
        width = k * max(1, refine)

        def search_block(block: QueryBlock) -> DataFrame:
            rows, lists, plan = self._probed(block, self._probes_of(block, nprobe), layout, "code")
            centroids = self.centroids if self.pq.residual else None
            found = rank_results(_scan_codes(rows, block, self.pq, width, query_type, id_type, plan, centroids), width)
            return _refined(found, queries, lists, self.metric, k) if refine else found

        return for_each_block(queries, search_block)

    def _probed(self, block: QueryBlock, probes: np.ndarray, layout: Layout, column: str):
        """Rows ``id, column, list, ...`` of the probed lists (not -1), those lists, and who probes which."""
        wanted = [int(n) for n in np.unique(probes) if n >= 0]
        stored = self.rows()
        pruned = stored if len(wanted) == self.n_lists else stored.filter(F.col(LIST).isin(wanted))
        filters = QueryFilters(block)
        rows = pruned.filter(filters.scan_condition(layout)).select("id", column, LIST, *filters.columns(layout))

        def plan(queries_in_task: QueryBlock):
            filters = QueryFilters(queries_in_task)
            flat = probes.ravel()
            order = np.argsort(flat, kind="stable")
            owners = np.repeat(np.arange(len(queries_in_task)), probes.shape[1])[order]
            sorted_lists = flat[order]

            def groups(batch: pa.RecordBatch):
                # Rows of one list at a time; a scan of codes also asks for its number.
                numbers = batch.column(2).to_numpy(zero_copy_only=False)
                allowed = filters.mask(batch)
                for number in np.unique(numbers):
                    lo, hi = np.searchsorted(sorted_lists, [number, number + 1])
                    group = np.flatnonzero(numbers == number), owners[lo:hi], allowed
                    yield (*group, int(number)) if column == "code" else group

            return groups

        return rows, pruned, plan


class PqModel:
    """Codebooks of a product quantiser: one set of centroids per slice of the vector.

    With a ``rotation`` vectors are turned before they are sliced. A ``residual`` model codes vectors less the centroid of
    their list.
    """

    def __init__(self, codebooks: list[np.ndarray], metric: str, rotation: np.ndarray | None = None, residual: bool = False):
        self.codebooks, self.metric = codebooks, metric
        self.rotation, self.residual = rotation, residual
        self.width = codebooks[0].shape[1]

    @classmethod
    def train(cls, rows: DataFrame, dim: int, subspaces: int = 8, n_codes: int = 64, metric: str = "l2",
              vector: str = "vector", seed: int = 42, centroids: np.ndarray | None = None, rotations: int = 0) -> PqModel:
        """Train one codebook per slice on all rows; the fits run side by side.

        With ``centroids`` the model is one of residuals to the nearest of them. With ``rotations`` vectors are turned:
        first so that the slices share the spread evenly, then, so many times less one, to bring vectors nearest to their
        decoded codes. Both come from sums of outer products, one square matrix of the dimension added up in the tasks.
        """
        metric = resolve_metric(metric)
        if metric == "l1":
            raise ValueError("product quantisation supports ip, cosine and l2")
        if dim % subspaces:
            raise ValueError(f"{subspaces} subspaces do not divide {dim} dimensions")
        if not 2 <= n_codes <= 256:
            raise ValueError("n_codes must be between 2 and 256")
        width = dim // subspaces
        usable = rows.filter(F.col(vector).isNotNull()).select(F.col(vector).alias("vector"))
        total = usable.count()
        codes = max(2, min(n_codes, total))
        _check_model_size(subspaces * codes * width)
        _check_model_size(dim * dim)
        if centroids is not None:
            usable = usable.select(_residual(rows.sparkSession, centroids, metric == "cosine")("vector").alias("vector"))
        elif metric == "cosine":
            usable = usable.select(l2_normalise(F.col("vector")).alias("vector"))
        training = stage(usable, "training")  # read many times over
        rotation = _evenly_spread(_cross_products(training, None, dim), subspaces) if rotations else None
        for turn in range(max(1, rotations)):
            turned = training if rotation is None else training.select(_turned(rows.sparkSession, rotation)("vector").alias("vector"))

            def fit(number: int) -> np.ndarray:
                part = turned.select(F.slice("vector", number * width + 1, width).alias("part"))
                return train_centroids(part, "part", codes, seed + number, 10 if turn + 1 >= rotations else 3)

            with ThreadPoolExecutor(max_workers=min(8, subspaces)) as pool:
                model = cls(list(pool.map(fit, range(subspaces))), metric, rotation, centroids is not None)
            if turn + 1 < rotations:
                left, _, right = np.linalg.svd(_cross_products(training, model, dim))
                rotation = left @ right
        return model

    @classmethod
    def of_points(cls, points: np.ndarray, subspaces: int, metric: str) -> PqModel:
        """Codebooks made of the slices of given points, at most 256 of them."""
        metric = resolve_metric(metric)
        return cls(np.split(_unit(points) if metric == "cosine" else points, subspaces, axis=1), metric)

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the codebooks, stacked, with the number of codes of each."""
        _save_matrix(spark, np.concatenate(self.codebooks), f"{path}/codes")
        if self.rotation is not None:
            _save_matrix(spark, self.rotation, f"{path}/rotation")
        files.create(spark, f"{path}/model.json", json.dumps(
            {"metric": self.metric, "codes": [len(book) for book in self.codebooks], "residual": self.residual,
             "rotated": self.rotation is not None}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PqModel:
        meta = json.loads(files.read(spark, f"{path}/model.json"))
        ends = np.cumsum(meta["codes"])[:-1]
        rotation = _load_matrix(spark, f"{path}/rotation") if meta["rotated"] else None
        return cls(np.split(_load_matrix(spark, f"{path}/codes"), ends), meta["metric"], rotation, meta["residual"])

    def encode_matrix(self, points: np.ndarray) -> np.ndarray:
        """Codes of vectors, or of the residuals that a model of residuals is given."""
        points = _unit(points) if self.metric == "cosine" and not self.residual else points
        points = points if self.rotation is None else points @ self.rotation
        parts = [
            _nearest(points[:, i * self.width:(i + 1) * self.width], book)[:, 0]
            for i, book in enumerate(self.codebooks)
        ]
        return np.stack(parts, axis=1).astype(np.uint8)

    def decode_matrix(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, turned back."""
        turned = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.codebooks)], axis=1)
        return turned if self.rotation is None else turned @ self.rotation.T

    def tables(self, queries: np.ndarray, centroid: np.ndarray | None = None) -> np.ndarray:
        """Score of every code of every slice per query, ``(slices, codes, queries)``; of residuals to ``centroid`` if given.

        A scalar product with the centroid is the same for all rows of its list and is left to the caller.
        """
        queries = _unit(queries) if self.metric == "cosine" else queries
        if centroid is not None and self.metric == "l2":
            queries = queries - centroid
        queries = queries if self.rotation is None else queries @ self.rotation
        size = max(len(b) for b in self.codebooks)
        out = np.zeros((len(self.codebooks), size, len(queries)), dtype=np.float32)
        for i, book in enumerate(self.codebooks):
            part = queries[:, i * self.width:(i + 1) * self.width]
            if self.metric == "l2":
                out[i, :len(book)] = 2.0 * book @ part.T - (book ** 2).sum(axis=1)[:, None] - (part ** 2).sum(axis=1)
            else:
                out[i, :len(book)] = book @ part.T
        return out

    def list_scores(self, queries: np.ndarray, centroid: np.ndarray) -> np.ndarray | float:
        """What the centroid of a list adds to the score of its rows, per query."""
        if self.metric == "l2":
            return 0.0
        return (_unit(queries) if self.metric == "cosine" else queries) @ centroid


def _doubles(points: np.ndarray) -> pa.Array:
    offsets = np.arange(len(points) + 1, dtype=np.int32) * points.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(points, np.float64).ravel()))


def _turned(spark: SparkSession, rotation: np.ndarray):
    shared = spark.sparkContext.broadcast(rotation)

    @F.arrow_udf("array<double>")
    def turn(vectors: pa.Array) -> pa.Array:
        return _doubles(matrix(vectors).astype(np.float64) @ shared.value)

    return turn


def _residual(spark: SparkSession, centroids: np.ndarray, by_direction: bool):
    shared = spark.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<double>")
    def less(vectors: pa.Array) -> pa.Array:
        points = matrix(vectors).astype(np.float64)
        points = _unit(points) if by_direction else points
        return _doubles(points - shared.value[_nearest(points, shared.value)[:, 0]])

    return less


def _evenly_spread(products: np.ndarray, subspaces: int) -> np.ndarray:
    """The main directions of the vectors, dealt to the slices so that the products of their spreads are alike."""
    spreads, directions = np.linalg.eigh(products)
    width = len(products) // subspaces
    slices: list[list[int]] = [[] for _ in range(subspaces)]
    weights = np.zeros(subspaces)
    for at in np.argsort(-spreads, kind="stable").tolist():
        free = [i for i in range(subspaces) if len(slices[i]) < width]
        chosen = min(free, key=lambda i: (weights[i], i))
        slices[chosen].append(at)
        weights[chosen] += np.log(max(spreads[at], spreads[-1] * 1e-12, 1e-300))
    return directions[:, [at for own in slices for at in own]]


def _cross_products(rows: DataFrame, model: PqModel | None, dim: int) -> np.ndarray:
    """Sum over all rows of the outer product of vector and decoded code before turning back, one matrix from each task.

    Without a model, of the vector with itself.
    """
    shared = rows.sparkSession.sparkContext.broadcast(None if model is None else (model.codebooks, model.metric, model.rotation))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Training vectors are already unit or residual: they are coded as they are.
        own, total = shared.value and PqModel(*shared.value, residual=True), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                points = matrix(batch.column(0)).astype(np.float64)
                codes = own and own.encode_matrix(points)
                total += points.T @ (points if own is None else np.concatenate(
                    [book[codes[:, i]] for i, book in enumerate(own.codebooks)], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), _doubles(total)], ["row", "cells"])

    parts = rows.mapInArrow(add_up, "row bigint, cells array<double>").select("row", F.posexplode("cells").alias("at", "cell"))
    summed = parts.groupBy("row", "at").agg(F.sum("cell").alias("cell")).toArrow()
    out = np.zeros((dim, dim))
    out[summed.column("row").to_numpy(), summed.column("at").to_numpy()] = summed.column("cell").to_numpy()
    return out


def pq_encode(rows: DataFrame, model: PqModel, vector: str = "vector", out: str = "code",
              centroids: np.ndarray | None = None) -> DataFrame:
    """Add the code of each vector as a binary column of one byte per slice.

    With ``centroids`` the code is that of the residual to the centroid of the row's list.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model.codebooks, model.metric, model.rotation, model.residual, centroids))

    def coded(points: np.ndarray, lists: np.ndarray | None) -> pa.Array:
        codebooks, metric, rotation, residual, centroids = shared.value
        if lists is not None:
            points = (_unit(points) if metric == "cosine" else points) - centroids[lists]
        codes = PqModel(codebooks, metric, rotation, residual).encode_matrix(points)
        wide = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
        return wide.cast(pa.binary())

    @F.arrow_udf("binary")
    def encode(vectors: pa.Array) -> pa.Array:
        return coded(matrix(vectors).astype(np.float64), None)

    @F.arrow_udf("binary")
    def encode_residual(vectors: pa.Array, lists: pa.Array) -> pa.Array:
        return coded(matrix(vectors).astype(np.float64), lists.to_numpy(zero_copy_only=False))

    code = encode(F.col(vector)) if centroids is None else encode_residual(F.col(vector), F.col(LIST))
    return rows.filter(F.col(vector).isNotNull()).withColumn(out, code)


def search_pq(coded: DataFrame, queries: DataFrame, model: PqModel, k: int = 10, refine: int = 4,
              vectors: DataFrame | None = None, code: str = "code") -> DataFrame:
    """Best ``k`` rows by compressed score.

    ``coded`` has ``id, code``. With ``vectors`` (``id, vector``) the best
    ``k * refine`` rows per query are scored again with the full vectors.
    """
    slim = coded.select("id", F.col(code).alias("code"))
    query_type, id_type = queries.schema["query_id"].dataType, slim.schema["id"].dataType
    width = k * refine if vectors is not None else k

    def everything(block: QueryBlock):
        every = np.arange(len(block))
        return lambda batch: [(np.arange(batch.num_rows), every, None)]

    def search_block(block: QueryBlock) -> DataFrame:
        return rank_results(_scan_codes(slim, block, model, width, query_type, id_type, everything), width)

    found = for_each_block(queries, search_block)
    return found if vectors is None else _refined(found, queries, vectors, model.metric, k)


def _scan_codes(rows: DataFrame, block: QueryBlock, model: PqModel, k: int, query_type, id_type, plan,
                centroids: np.ndarray | None = None) -> DataFrame:
    """Per-task top-k by compressed score over ``rows(id, code, ...)``; ``plan`` as in ``scan_top_k``."""
    shared = share(rows.sparkSession, (block, model.codebooks, model.metric, model.rotation, model.residual, centroids))
    arrow_query, arrow_id = to_arrow_type(query_type), to_arrow_type(id_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, codebooks, metric, rotation, residual, centroids = shared.value
        model_in_task = PqModel(codebooks, metric, rotation, residual)
        top, groups = TopK(len(queries), k), plan(queries)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = sortable(batch.column(0))
            fixed = batch.column(1).cast(pa.binary(len(codebooks)))
            codes = np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * len(codebooks):][:len(fixed) * len(codebooks)]
            codes = codes.reshape(batch.num_rows, -1)
            for row_idx, query_idx, allowed, *number in groups(batch):
                centroid = None if centroids is None else centroids[number[0]]
                _score_codes(model_in_task, top, ids, codes, queries.vectors, row_idx, query_idx, allowed, centroid)
        yield from top.batches(queries.ids, arrow_query, arrow_id)

    return rows.mapInArrow(scan, f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double")


def _score_codes(model: PqModel, top: TopK, ids, codes, vectors, row_idx, query_idx, allowed, centroid=None) -> None:
    if top.crowded and allowed is None:
        row_idx = without_spare_copies(codes, ids, row_idx, top.k)
    if not len(row_idx):
        return
    step = max(1, min(1024, 4_000_000 // len(row_idx)))
    for lo in range(0, len(query_idx), step):
        block = query_idx[lo:lo + step]
        tables = model.tables(vectors[block], centroid)
        scores = np.zeros((len(row_idx), len(block)), dtype=np.float32)
        for i in range(codes.shape[1]):
            scores += tables[i][codes[row_idx, i]]
        scores = scores.T
        if centroid is not None:
            scores = scores + np.reshape(model.list_scores(vectors[block], centroid), (-1, 1)).astype(np.float32)
        if allowed is not None:
            scores = np.where(allowed(row_idx, block), scores, -np.inf)
        bar = top.floor[block].astype(np.float32)
        if len(row_idx) > top.k:
            cut = len(row_idx) - top.k
            bar = np.maximum(bar, np.partition(scores, cut, axis=1)[:, cut])
        q, r = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
        top.note_crowd(len(q), len(block))
        top.add(block[q], scores[q, r].astype(float), ids[row_idx[r]])


def _refined(found: DataFrame, queries: DataFrame, vectors: DataFrame, metric: str, k: int) -> DataFrame:
    """Score the found candidates again with the full vectors and keep the best ``k``."""
    full = vectors.select("id", F.col("vector").alias("_row"))
    wanted = queries.select("query_id", F.col("vector").alias("_query"))
    pairs = full.join(stage(found.select("query_id", "id"), "candidates"), "id").join(wanted, "query_id")

    @F.arrow_udf("double")
    def exact(query: pa.Array, row: pa.Array) -> pa.Array:
        return pa.array(pair_scores(matrix(query), matrix(row), metric))

    scored = pairs.select("query_id", "id", exact(F.col("_query").cast("array<double>"), F.col("_row")).alias("score"))
    return rank_results(scored, k)


def _plane(seed: int, table: int, bit: int, dim: int) -> np.ndarray:
    """A fixed random direction: every coordinate comes from the md5 of its numbers, so anyone can repeat it."""
    names = (f"{seed}:{table}:{bit}:{i}" for i in range(dim))
    return np.array([int(hashlib.md5(n.encode()).hexdigest()[:8], 16) / 2**32 - 0.5 for n in names])


class LshIndex:
    """Random projection hashing: a query is compared with the rows that share a bucket with it.

    A table hashes a vector to the signs of ``bits`` projections. Every row is stored once for each table, partitioned
    by table and bucket, so a search reads only the buckets that some query falls into.
    """

    def __init__(self, spark: SparkSession, path: str, metric: str, tables: int, bits: int, seed: int):
        self.spark, self.path, self.metric = spark, path, metric
        self.tables, self.bits, self.seed = tables, bits, seed
        self.stored = spark.read.parquet(path)

    @classmethod
    def build(cls, rows: DataFrame, path: str, metric: str = "cosine", tables: int = 5, bits: int = 5,
              id_column: str = "id", vector: str = "vector", seed: int = 42) -> LshIndex:
        """Hash every row and write it to its buckets below ``path``; large buckets are split by measured size."""
        metric = resolve_metric(metric)
        usable = rows.filter(F.col(vector).isNotNull()).select(
            F.col(id_column).alias("id"), F.col(vector).alias("vector"))

        @F.arrow_udf("array<int>")
        def hashed(vectors: pa.Array) -> pa.Array:
            points = matrix(vectors).astype(np.float64)
            numbers = _buckets(points, tables, bits, seed)
            offsets = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * tables)
            return pa.ListArray.from_arrays(offsets, pa.array(numbers.ravel()))

        copies = usable.withColumn("buckets", hashed("vector")).select("*", F.posexplode("buckets").alias("t", "b"))
        placed = copies.withColumn(LIST, F.col("t") * (1 << bits) + F.col("b")).drop("t", "b")
        placed.hint("rebalance", LIST).sortWithinPartitions(LIST, "id").write.partitionBy(LIST).parquet(path)
        return cls(rows.sparkSession, path, metric, tables, bits, seed)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Best ``k`` of the rows that share at least one bucket with the query, by exact score.

        A row that shares several buckets is scored in the first of these tables only. Candidate pairs are never rows,
        so a crowded bucket costs no more than reading it.
        """
        query_type, id_type = queries.schema["query_id"].dataType, self.stored.schema["id"].dataType
        tables, bits, seed = self.tables, self.bits, self.seed

        def search_block(block: QueryBlock) -> DataFrame:
            asked = _buckets(block.vectors.astype(np.float64), tables, bits, seed) if len(block) else np.zeros((0, tables), int)
            lists = asked + (np.arange(tables) << bits)
            rows = self.stored.filter(F.col(LIST).isin(np.unique(lists).tolist())).select("id", "vector", LIST, "buckets")

            def plan(queries_in_task: QueryBlock):
                def groups(batch: pa.RecordBatch):
                    numbers = batch.column(2).to_numpy(zero_copy_only=False)
                    own = matrix(batch.column(3)).astype(np.int64)
                    for number in np.unique(numbers).tolist():
                        table = number >> bits

                        def first_shared(r: np.ndarray, q: np.ndarray, table=table) -> np.ndarray:
                            before = np.zeros((len(q), len(r)), dtype=bool)
                            for t in range(table):
                                before |= asked[q, t][:, None] == own[r, t][None, :]
                            return ~before

                        yield np.flatnonzero(numbers == number), np.flatnonzero(lists[:, table] == number), first_shared

                return groups

            return rank_results(scan_top_k(rows, block, k, self.metric, query_type, id_type, plan), k)

        return for_each_block(queries, search_block)


def _buckets(points: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """Bucket of every point in every table."""
    planes = np.stack([_plane(seed, t, b, points.shape[1]) for t in range(tables) for b in range(bits)], axis=1)
    signs = (points @ planes >= 0).reshape(len(points), tables, bits)
    return (signs << np.arange(bits - 1, -1, -1)).sum(axis=2).astype(np.int32)
