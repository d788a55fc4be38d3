"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.inputs import numbered


def _score(key: Column, shard, weight) -> Column:
    """A weight's share of an exponential draw that key and shard decide; the larger wins."""
    draw = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + 0.5) / float(1 << 53)
    return -weight / F.log(draw)


def rendezvous(key: Column, weights: Sequence[float], grown: float | None = None) -> tuple[Column, Column]:
    """The shard of ``key`` among ``len(weights)``, and its shard if one more of weight ``grown`` is added.

    Every shard draws a score for the key that does not depend on the other shards, so an added shard can only win keys
    for itself and a removed one loses only its own. Shares are in proportion to the weights. Equal scores go to the
    smaller number. All in column expressions: no shuffle, no state.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    values = F.array(*(F.lit(float(w)) for w in weights))
    drawn = F.transform(values, lambda w, i: F.struct(_score(key, i.cast("int"), w).alias("score"), (-i).alias("shard")))
    best = F.array_max(drawn)
    n = len(weights)
    added = F.struct(_score(key, F.lit(n), F.lit(float(grown or 1.0))).alias("score"), F.lit(-n).alias("shard"))
    return (-best["shard"]).cast("int"), (-F.greatest(best, added)["shard"]).cast("int")


def shard_rows(rows: DataFrame, key: str, weights: Sequence[float], grown: float | None = None,
               content: str | None = None) -> DataFrame:
    """``rows`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless from 0 within the shard).

    Rows of one key share a shard, whatever else they hold. A null key is replaced by a hash of column ``content``, or
    of nothing, so such rows do not all meet in one shard. Columns of the result's names are replaced; an empty table
    gives an empty result. Slots are numbered by chunks, so a shard of any size is spread over tasks.
    """
    name = F.col(f"`{key}`").cast("string")
    if content is not None:
        name = F.coalesce(name, F.concat(F.lit("null:"), F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256)))
    shard, more = rendezvous(name, weights, grown)
    return numbered(rows.withColumn("shard", shard).withColumn("grown_shard", more), "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; each task writes its rows of every shard, so no shard passes through one task."""
    sharded.write.partitionBy("shard").parquet(path)
