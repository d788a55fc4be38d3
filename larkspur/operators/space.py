"""A layout of collections by place and time, so that box and date filters open few files."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.functions.predicates import month_number
from larkspur.operators.search import Layout, filter_condition, search

#: Bits of a cell's latitude and longitude, and of the finer key that orders rows inside a cell.
CELL_BITS, KEY_BITS = 3, 8
#: Months after which times share cells again (a multiple of twelve), and months of a cell.
PERIOD, CELL_MONTHS = 96, 3
CELL = "cell"
#: The cell of rows without a place or a date.
NOWHERE = -1


def _step(value: Column, low: float, high: float, bits: int) -> Column:
    """In which of ``2 ** bits`` equal parts of a range a value lies; values outside count to the first and last."""
    n = 1 << bits
    part = F.floor((value.cast("double") - low) / (high - low) * n)
    return F.greatest(F.least(part, F.lit(n - 1)), F.lit(0)).cast("bigint")


def _month(date: Column) -> Column:
    day = date.cast("date")
    return F.pmod(F.year(day) * 12 + F.month(day) - 1, F.lit(PERIOD)).cast("bigint")


def _interleaved(parts: list[tuple[Column, int]]) -> Column:
    """One number of the bits of several, the highest bits of all first."""
    deepest = max(bits for _, bits in parts)
    taken = [(value, bits - 1 - level) for level in range(deepest) for value, bits in parts if level < bits]
    bits = [F.shiftleft(F.shiftright(value, at).bitwiseAND(F.lit(1)), len(taken) - 1 - k) for k, (value, at) in enumerate(taken)]
    return reduce(Column.__add__, bits)


def space_key(latitude: Column, longitude: Column, date: Column, bits: int = KEY_BITS) -> Column:
    """A Z-order key of place and month: rows near each other in all three have keys near each other. Null for a null."""
    return _interleaved([(_step(latitude, -90, 90, bits), bits), (_step(longitude, -180, 180, bits), bits),
                         (_month(date), (PERIOD - 1).bit_length())])


def cell_of(latitude: Column, longitude: Column, date: Column) -> Column:
    """The cell of a place and a date: its parts of latitude, longitude and the period, as one number."""
    place = _step(latitude, -90, 90, CELL_BITS) * (1 << CELL_BITS)
    cell = (place + _step(longitude, -180, 180, CELL_BITS)) * (PERIOD // CELL_MONTHS) + F.floor(_month(date) / CELL_MONTHS)
    return F.coalesce(cell, F.lit(NOWHERE)).cast("int")


def write_clustered(rows: DataFrame, path: str, layout: Layout = Layout()) -> None:
    """Write rows partitioned by cell and ordered by ``space_key``; the rebalance hint splits large cells, joins small ones."""
    place = F.col(layout.latitude), F.col(layout.longitude), F.col(layout.date)
    keyed = rows.withColumns({CELL: cell_of(*place), "_key": space_key(*place)})
    keyed.hint("rebalance", CELL).sortWithinPartitions(CELL, "_key").drop("_key").write.partitionBy(CELL).parquet(path)


def cells_for(filters: dict | None) -> list[int] | None:
    """The cells that can hold a row which passes the filters; None where these name neither a box nor a time."""
    f = filters or {}
    box = [f.get(n) for n in ("latitude_min", "latitude_max", "longitude_min", "longitude_max")]
    boxed = all(b is not None for b in box)
    start, end = f.get("start_date"), f.get("end_date")
    dated = start is not None or end is not None or bool(f.get("months"))
    if not boxed and not dated:
        return None
    n = 1 << CELL_BITS
    lats, lons = np.ones(n, bool), np.ones(n, bool)
    if boxed:
        lat, lon = np.arange(n) * 180 / n - 90, np.arange(n) * 360 / n - 180

        def meets(lows, size: float, low: float, high: float) -> np.ndarray:
            # The outermost parts also hold what lies beyond them.
            ends = np.where(np.arange(n) == n - 1, np.inf, lows + size)
            return (ends >= low) & (np.where(np.arange(n) == 0, -np.inf, lows) <= high)

        lats = meets(lat, 180 / n, box[0], box[1])
        west, east = box[2], box[3]
        lons = meets(lon, 360 / n, west, east) if west <= east else (
            meets(lon, 360 / n, west, np.inf) | meets(lon, 360 / n, -np.inf, east))
    months = np.ones(PERIOD, bool)
    if start is not None and end is not None:
        first, last = (np.datetime64(str(d)[:10], "M").astype(int) + 1970 * 12 for d in (start, end))
        if last - first < PERIOD:
            months[:] = False
            months[np.arange(first, max(first, last) + 1) % PERIOD] = True
    if f.get("months"):
        named = np.zeros(12, bool)
        named[[month_number(m) - 1 for m in f["months"]]] = True
        months &= np.tile(named, PERIOD // 12)
    times = months.reshape(-1, CELL_MONTHS).any(axis=1)
    grid = lats[:, None, None] & lons[None, :, None] & times[None, None, :]
    # Rows without a place pass a filter of times only, rows without a date one of places only.
    return np.flatnonzero(grid.ravel()).tolist() + ([] if boxed and dated else [NOWHERE])


def read_clustered(spark: SparkSession, path: str, filters: dict | None = None, layout: Layout = Layout()) -> DataFrame:
    """The rows that pass the filters; only the files of cells that can hold one are opened."""
    rows, cells = spark.read.parquet(path), cells_for(filters)
    if cells is not None:
        rows = rows.filter(F.col(CELL).isin(cells))
    return rows.filter(filter_condition(layout, filters))


def search_clustered(spark: SparkSession, path: str, vector, k: int = 10, metric: str = "cosine", filters: dict | None = None,
                     layout: Layout = Layout()) -> DataFrame:
    """Best ``k`` rows for one vector among those that pass the filters: ``rank, id, score``."""
    return search(read_clustered(spark, path, filters, layout), vector, k, metric, None, layout)
