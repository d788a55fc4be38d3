"""Exact top-k search of a collection for one or many queries, with filters."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.functions.predicates import all_of, in_box, in_dates, in_months, month_number, species_is
from larkspur.functions.vectors import resolve_metric
from larkspur.operators.scoring import QueryBlock, Scorer, TopK, matrix, score_rows, sortable
from larkspur.session import scratch_path, stage

# A block of queries is held in memory by every task, so its size is checked;
# more queries than this are searched block after block.
MAX_BLOCK_QUERIES = 16384
MAX_BLOCK_BYTES = 64 * 1024 * 1024
MAX_PUSHED_VALUES = 1000

FILTER_COLUMNS = (
    "species", "latitude_min", "latitude_max", "longitude_min", "longitude_max",
    "start_date", "end_date", "months",
)


@dataclass(frozen=True)
class Layout:
    """Column names of a collection."""

    id: str = "id"
    vector: str = "vector"
    species: str | None = "species"
    latitude: str | None = "location.lat"
    longitude: str | None = "location.lon"
    date: str | None = "observed_on"


def filter_condition(layout: Layout, filters: dict | None) -> Column:
    """One condition from a dictionary of filters; absent or empty entries do not filter."""
    f = filters or {}
    unknown = set(f) - set(FILTER_COLUMNS)
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    conditions = []
    if f.get("species"):
        conditions.append(species_is(F.col(layout.species), f["species"]))
    box = [f.get(n) for n in ("latitude_min", "latitude_max", "longitude_min", "longitude_max")]
    if all(b is not None for b in box):
        conditions.append(in_box(F.col(layout.latitude), F.col(layout.longitude), *box))
    if f.get("start_date") is not None or f.get("end_date") is not None:
        conditions.append(in_dates(F.col(layout.date), f.get("start_date"), f.get("end_date")))
    if f.get("months"):
        conditions.append(in_months(F.col(layout.date), f["months"]))
    return all_of(*conditions)


def rank_results(candidates: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query as ``query_id, rank, id, score``; ties go to the smaller id.

    Spark keeps at most ``k`` rows per query in each task before the shuffle.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")


# Queries ---------------------------------------------------------------------


def _block_of(table: pa.Table) -> QueryBlock:
    columns = {}
    for name in table.column_names:
        if name in FILTER_COLUMNS:
            columns[name] = np.array(table.column(name).to_pylist(), dtype=object)
    vectors = table.column("vector").combine_chunks()
    data = matrix(vectors) if len(vectors) else np.zeros((0, 1))
    return QueryBlock(sortable(table.column("query_id").combine_chunks()), data, columns)


def _query_columns(queries: DataFrame) -> DataFrame:
    extra = [c for c in FILTER_COLUMNS if c in queries.columns]
    return queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *extra)


def _blocks(staged: DataFrame) -> int:
    """How many blocks hold the queries, each of at most so many queries and so many bytes."""
    n, width = staged.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    per_block = max(1, min(MAX_BLOCK_QUERIES, MAX_BLOCK_BYTES // (8 * width + 256)))
    # Dealt by hash, blocks come out somewhat uneven.
    return 1 if n <= per_block else 1 + 2 * n // per_block


def for_each_block(queries: DataFrame, search_block) -> DataFrame:
    """Run ``search_block(QueryBlock)`` over all queries.

    The queries are evaluated once, into the scratch folder, so that an embedder that does not repeat itself is asked
    once. Their number and width bound the blocks before any vector comes to the driver; each block is searched in its
    own pass, and where there are several their results are written, so neither the driver nor a task holds more than
    one block.
    """
    spark = queries.sparkSession
    staged = stage(_query_columns(queries), "queries")
    n_blocks = _blocks(staged)
    if n_blocks == 1:
        return search_block(_block_of(staged.toArrow()))
    part = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")
    stored = stage(staged.withColumn("block", part).repartition("block"), "blocks", ["block"])
    results = scratch_path(spark, "results")
    for number in range(n_blocks):
        table = stored.filter(F.col("block") == number).drop("block").toArrow()
        if table.num_rows or number == 0:
            with released_values():
                search_block(_block_of(table)).write.mode("append").parquet(results)
    return spark.read.parquet(results)


_held_values: list[list] = []


@contextmanager
def released_values():
    """Release the values shared with the tasks while the body ran."""
    _held_values.append([])
    try:
        yield
    finally:
        for value in _held_values.pop():
            value.unpersist()


def share(spark, value):
    """Broadcast a value of checked size."""
    shared = spark.sparkContext.broadcast(value)
    if _held_values:
        _held_values[-1].append(shared)
    return shared


# Filters carried by the queries ------------------------------------------------


def _day_numbers(values: np.ndarray, missing: float) -> np.ndarray:
    return np.array([missing if v is None else float(np.datetime64(v, "D").astype(int)) for v in values])


class QueryFilters:
    """Filters that differ from query to query, applied as a mask over a block of pairs."""

    def __init__(self, block: QueryBlock):
        n = len(block)
        get = lambda name: block.columns.get(name, np.full(n, None, dtype=object))
        self.species = np.array(["" if s is None else s for s in get("species")], dtype=object)
        bounds = [get(f"{axis}_{side}") for axis in ("latitude", "longitude") for side in ("min", "max")]
        self.boxed = np.array([all(b[i] is not None for b in bounds) for i in range(n)], dtype=bool)
        self.box = [np.array([float(b[i]) if self.boxed[i] else 0.0 for i in range(n)]) for b in bounds]
        start, end = get("start_date"), get("end_date")
        self.dated = np.array([start[i] is not None or end[i] is not None for i in range(n)], dtype=bool)
        self.start, self.end = _day_numbers(start, -np.inf), _day_numbers(end, np.inf)
        self.months = np.ones((n, 13), dtype=bool)
        self.monthly = np.zeros(n, dtype=bool)
        for i, names in enumerate(get("months")):
            if names is not None and len(names):
                self.monthly[i] = True
                self.months[i] = False
                self.months[i, [month_number(m) for m in names]] = True

    @property
    def needs_species(self) -> bool:
        return bool((self.species != "").any())

    @property
    def needs_location(self) -> bool:
        return bool(self.boxed.any())

    @property
    def needs_date(self) -> bool:
        return bool(self.dated.any() or self.monthly.any())

    def columns(self, layout: Layout) -> list[Column]:
        """Only the columns some query filters on are read."""
        out = []
        if self.needs_species:
            out.append(F.col(layout.species).cast("string").alias("_species"))
        if self.needs_location:
            out.append(F.col(layout.latitude).cast("double").alias("_lat"))
            out.append(F.col(layout.longitude).cast("double").alias("_lon"))
        if self.needs_date:
            out.append(F.col(layout.date).cast("date").alias("_date"))
        return out

    def scan_condition(self, layout: Layout) -> Column:
        """What every query demands, as one condition the scan can prune by."""
        parts = []
        if len(self.species) and (self.species != "").all():
            names = sorted(set(self.species))
            if len(names) <= MAX_PUSHED_VALUES:
                parts.append(F.col(layout.species).cast("string").isin(names))
        if len(self.boxed) and self.boxed.all():
            parts.append(F.col(layout.latitude).between(float(self.box[0].min()), float(self.box[1].max())))
        if len(self.dated) and self.dated.all():
            first, last = self.start.min(), self.end.max()
            if np.isfinite(first):
                parts.append(F.col(layout.date) >= F.lit(np.datetime64(int(first), "D").item()))
            if np.isfinite(last):
                parts.append(F.col(layout.date) <= F.lit(np.datetime64(int(last), "D").item()))
        return all_of(*parts)

    def mask(self, batch: pa.RecordBatch):
        """A function giving the permitted pairs of (queries, rows) for this batch, or None."""
        names = batch.schema.names
        tests = []
        if "_species" in names:
            encoded = batch.column(names.index("_species")).dictionary_encode()
            known = {name: code for code, name in enumerate(encoded.dictionary.to_pylist())}
            wanted = np.array([-2 if s == "" else known.get(s, -3) for s in self.species])
            codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            tests.append(lambda r, q: (wanted[q] == -2)[:, None] | (wanted[q][:, None] == codes[r][None, :]))
        if "_lat" in names:
            lat = batch.column(names.index("_lat")).to_numpy(zero_copy_only=False).astype(float)
            lon = batch.column(names.index("_lon")).to_numpy(zero_copy_only=False).astype(float)
            tests.append(lambda r, q: self._in_box(lat[r], lon[r], q))
        if "_date" in names:
            raw = batch.column(names.index("_date"))
            days = raw.cast(pa.int32()).to_numpy(zero_copy_only=False).astype(float)
            stamps = raw.to_numpy(zero_copy_only=False).astype("datetime64[M]")
            missing = np.isnat(stamps)
            month = np.where(missing, 0, stamps.astype("int64") % 12 + 1).astype(int)
            tests.append(lambda r, q: self._in_dates(days[r], month[r], missing[r], q))
        if not tests:
            return None

        def allowed(r: np.ndarray, q: np.ndarray) -> np.ndarray:
            out = tests[0](r, q)
            for test in tests[1:]:
                out = out & test(r, q)
            return out

        return allowed

    def _in_box(self, lat: np.ndarray, lon: np.ndarray, q: np.ndarray) -> np.ndarray:
        lat_min, lat_max, lon_min, lon_max = (b[q][:, None] for b in self.box)
        inside = (lat >= lat_min) & (lat <= lat_max)
        plain = (lon >= lon_min) & (lon <= lon_max)
        wrapped = (lon >= lon_min) | (lon <= lon_max)
        return ~self.boxed[q][:, None] | (inside & np.where(lon_min <= lon_max, plain, wrapped))

    def _in_dates(self, days, month, missing, q: np.ndarray) -> np.ndarray:
        known = ~missing[None, :]
        in_range = (days >= self.start[q][:, None]) & (days <= self.end[q][:, None]) & known
        in_month = self.months[q][:, month] & known
        return (~self.dated[q][:, None] | in_range) & (~self.monthly[q][:, None] | in_month)


# Search ------------------------------------------------------------------------


def scan_top_k(rows: DataFrame, block: QueryBlock, k: int, metric: str, query_type, id_type, plan) -> DataFrame:
    """Per-task top-k over ``rows(id, vector, ...)``.

    ``plan(block)`` is called in the task and returns a function giving, for a
    batch, the groups ``(rows, queries, mask)`` to score.
    """
    shared = share(rows.sparkSession, block)
    arrow_query, arrow_id = to_arrow_type(query_type), to_arrow_type(id_type)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        if not len(queries):
            for _ in batches:
                pass
            return
        scorer, top = Scorer(queries.vectors, metric), TopK(len(queries), k)
        groups = plan(queries)
        for batch in batches:
            if batch.num_rows:
                ids = sortable(batch.column(0))
                scorer.prepare(matrix(batch.column(1), queries.dim))
                for row_idx, query_idx, allowed in groups(batch):
                    score_rows(scorer, top, ids, row_idx, query_idx, allowed)
        yield from top.batches(queries.ids, arrow_query, arrow_id)

    schema = f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double"
    return rows.mapInArrow(search, schema)


def _all_pairs(block: QueryBlock):
    every = np.arange(len(block))
    filters = QueryFilters(block)
    return lambda batch: [(np.arange(batch.num_rows), every, filters.mask(batch))]


def search_batch(
    collection: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    layout: Layout = Layout(),
) -> DataFrame:
    """Exact best ``k`` rows for each query: ``query_id, rank, id, score``.

    ``queries`` has ``query_id, vector`` and any of the filter columns, which
    then apply to that query alone.
    """
    query_type = queries.schema["query_id"].dataType
    return for_each_block(queries, lambda block: search_block(collection, block, query_type, k, metric, layout))


def search_block(collection: DataFrame, block: QueryBlock, query_type: T.DataType, k: int, metric: str,
                 layout: Layout) -> DataFrame:
    """Exact search for one bounded block of queries."""
    metric = resolve_metric(metric)
    if k < 1:
        raise ValueError("k must be at least 1")
    filters = QueryFilters(block)
    id_type = collection.select(layout.id).schema[0].dataType
    rows = (
        collection.filter(F.col(layout.vector).isNotNull()).filter(filters.scan_condition(layout))
        .select(F.col(layout.id).alias("id"), F.col(layout.vector).alias("vector"), *filters.columns(layout))
    )
    return rank_results(scan_top_k(rows, block, k, metric, query_type, id_type, _all_pairs), k)


def search(
    collection: DataFrame,
    vector,
    k: int = 10,
    metric: str = "cosine",
    filters: dict | None = None,
    layout: Layout = Layout(),
) -> DataFrame:
    """Best ``k`` rows for one vector: ``rank, id, score``.

    The filters are plain conditions on the collection, so they reach the
    Parquet scan and rows they reject are never scored.
    """
    chosen = collection.filter(filter_condition(layout, filters))
    block = QueryBlock(np.zeros(1, dtype=np.int64), np.array([[float(v) for v in vector]]))
    return search_block(chosen, block, T.LongType(), k, metric, layout).drop("query_id")


def search_exact(collection: DataFrame, vector, k: int = 10, metric: str = "cosine",
                 layout: Layout = Layout()) -> DataFrame:
    """Best ``k`` rows of the whole collection for one vector."""
    return search(collection, vector, k, metric, None, layout)


def with_payload(results: DataFrame, collection: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """Add payload columns to search results.

    The results are staged, so Spark knows their bytes and broadcasts them where they are few: the payload is then read
    in one scan without moving the collection. Vectors are not read.
    """
    payload = collection.select(F.col(id_column).alias("id"), *[c for c in columns if c != id_column])
    return payload.join(stage(results, "results"), "id").select(*results.columns, *[c for c in columns if c != "id"])


def result_page(results: DataFrame, page: int, size: int = 50, limit: int = 200) -> DataFrame:
    """Rows of one page (from 0) of the first ``limit`` results."""
    first = page * size
    return results.filter((F.col("rank") > first) & (F.col("rank") <= min(first + size, limit)))


def with_total(results: DataFrame) -> DataFrame:
    """Add the number of rows returned for the query."""
    return results.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
