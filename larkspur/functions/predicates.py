"""Filter predicates; they reach the Parquet scan as pushed filters where possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Month names offered by the search form.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def month_number(name: str) -> int:
    if name not in MONTHS:
        raise ValueError(f"unknown month {name!r}; use one of {', '.join(MONTHS)}")
    return MONTHS.index(name) + 1


def species_is(column: Column, species: str | None) -> Column | None:
    return column == F.lit(species) if species else None


def in_box(
    lat: Column,
    lon: Column,
    lat_min: float | None,
    lat_max: float | None,
    lon_min: float | None,
    lon_max: float | None,
) -> Column | None:
    """Inclusive box, applied only when all four bounds are given.

    A box with ``lon_min > lon_max`` crosses the antimeridian. Null coordinates
    match no box.
    """
    if any(b is None for b in (lat_min, lat_max, lon_min, lon_max)):
        return None
    lat_ok = lat.between(lat_min, lat_max)
    if lon_min <= lon_max:
        return lat_ok & lon.between(lon_min, lon_max)
    return lat_ok & ((lon >= lon_min) | (lon <= lon_max))


def in_dates(column: Column, start=None, end=None) -> Column | None:
    """Inclusive date range, open where a side is missing."""
    parts = []
    if start is not None:
        parts.append(column >= F.lit(start).cast("date"))
    if end is not None:
        parts.append(column <= F.lit(end).cast("date"))
    return reduce(lambda a, b: a & b, parts) if parts else None


def in_months(column: Column, months: list[str] | None) -> Column | None:
    if not months:
        return None
    return F.month(column).isin([month_number(m) for m in months])


def all_of(*conditions: Column | None) -> Column:
    """All given conditions must hold; none means everything passes."""
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, present) if present else F.lit(True)


def is_blank(text: Column) -> Column:
    from larkspur.functions.text import strip

    return text.isNull() | (strip(text) == "")


def query_problem(text: Column, limit: Column, largest: int = 100) -> Column:
    """Why a search request cannot be answered, null where it can: rows with a reason are failures, not errors."""
    return F.when(is_blank(text), F.lit("the query has no text")).when(
        limit.isNull() | ~limit.between(1, largest), F.concat(F.lit("the limit is not from 1 to "), F.lit(largest).cast("string")))
